"""Queries of the service's routes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import api
from docquarry import sources as so
from docquarry.functions import text as tx
from docquarry.operators import answering as aw
from docquarry.operators.library import Library
from docquarry.plans import answering, search
from docquarry.plans import views as v
from docquarry.sources import storage

SQL: dict[str, str] = {}
RUN: dict = {}


def query(sql: str | None = None):
    def add(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark, sf):
    return v.corpus(spark, sf).select("chunk_id", F.col("source").alias("document_id"), (F.col("chunk_id") % 5).alias("page_number"), F.col("lang").alias("section"), "text")


def _evidence(spark, sf):
    titles = v.corpus(spark, sf).select(F.col("source").alias("document_id")).distinct().withColumn("title", F.concat(F.lit("Title of "), "document_id"))
    return api.evidence_for(search.bm25_topk(spark, sf), _chunks(spark, sf), titles)


def _questions(spark, sf, kind="question_answering"):
    return v.questions(spark, sf).select("query_id", F.substr("text", F.lit(1), F.lit(120)).alias("question"), F.lit(kind).alias("query_type"))


_EVIDENCE = f"""{v.QUESTIONS}, {v.BM25}, best AS ({search._TOP.format('scored', 8)}), ev AS (SELECT query_id, rank AS citation_id, source AS document_id, 'Title of ' || source AS document_title, chunk_id % 5 AS page_number, lang AS section, c.text FROM best JOIN corpus c USING (chunk_id)),
qs AS (SELECT item_id AS query_id, left(text, 120) AS question FROM benchmark)"""
_BLOCKS = answering._BLOCKS


def _prompt(task: str, ask: str, lead: str) -> str:
    return f"md5({ask} || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || e || chr(10) || chr(10) || '{lead}:')"


_ANSWERS = f"""se AS (SELECT query_id, citation_id, unnest(range(0, len(s))) AS i, unnest(s) AS sentence FROM (SELECT query_id, citation_id, {v.SENTENCES.format('text')} AS s FROM {{0}})),
so AS (SELECT query_id, citation_id, i, sentence, len(list_intersect({v.GROUNDING_WORDS.format('question')}, {v.GROUNDING_WORDS.format('sentence')})) AS n FROM se JOIN qs USING (query_id)),
an AS (SELECT query_id, regexp_replace(sentence, '[.!?]+$', '') || ' [' || citation_id || '].' AS answer FROM so QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, citation_id, i) = 1),
tx AS (SELECT query_id, string_agg({_BLOCKS}, chr(10) || chr(10) ORDER BY citation_id) AS e, count(*) AS n_evidence FROM {{0}} GROUP BY 1)"""


@query(f"WITH {_EVIDENCE}, {_ANSWERS.replace('{0}', 'ev')} SELECT query_id, n_evidence, md5(answer) AS answer_md5, {_prompt('qa', chr(39) + 'QUESTION: ' + chr(39) + ' || question', 'ANSWER')} AS prompt_md5 FROM tx JOIN an USING (query_id) JOIN qs USING (query_id)")
def api_query(spark, sf):
    """Questions to answers: retrieved, numbered, prompted, answered."""
    got = api.query(_questions(spark, sf), _evidence(spark, sf))
    return got.select("query_id", F.size("evidence").alias("n_evidence"), F.md5("answer").alias("answer_md5"), F.md5("prompt").alias("prompt_md5"))


_FEW = "few AS (SELECT ev.* FROM ev WHERE document_id IN ('src' || (query_id % 20), 'src' || ((query_id + 1) % 20), 'src' || ((query_id + 2) % 20), 'src3'))"


@query(f"WITH {_EVIDENCE}, {_FEW}, {_ANSWERS.replace('{0}', 'few')} SELECT query_id, n_evidence, md5(answer) AS answer_md5 FROM tx JOIN an USING (query_id)")
def api_compare(spark, sf):
    """Questions on some papers each."""
    q = F.col("query_id")
    source = lambda n: F.concat(F.lit("src"), ((q + n) % 20).cast("string"))
    wanted = v.questions(spark, sf).select("query_id", F.explode(F.array_distinct(F.array(source(0), source(1), source(2), F.lit("src3")))).alias("document_id"))
    got = api.compare(_questions(spark, sf, "compare_papers"), _evidence(spark, sf), wanted).filter(F.size("evidence") > 0)
    return got.select("query_id", F.size("evidence").alias("n_evidence"), F.md5("answer").alias("answer_md5"))


@query(f"""WITH {_EVIDENCE}, hits AS (SELECT best.*, c.source AS document_id, c.lang || '-' || c.source AS section, left(c.text, 30) AS text FROM best JOIN corpus c USING (chunk_id)), f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, document_id) AS r FROM hits), cp AS (SELECT * FROM f QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY r) <= 7),
s AS (SELECT query_id, section, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS p, count(*) OVER (PARTITION BY query_id) AS many FROM cp GROUP BY 1, 2),
cl AS (SELECT cp.*, CASE WHEN many > 6 AND p >= 6 THEN 'Other' ELSE section END AS cluster FROM cp JOIN s USING (query_id, section)), tx AS (SELECT query_id, cluster, count(*) AS n, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS e FROM cl GROUP BY 1, 2)
SELECT query_id, cluster, n, {_prompt('literature_review', answering._sql_filled(aw.TASKS['literature_review'][0], "question || ' — ' || cluster"), 'SUBSECTION')} AS prompt_md5 FROM tx JOIN qs USING (query_id)""")
def api_review(spark, sf):
    """Reviews: the first papers' chunks by cluster, a prompt for each."""
    docs = v.corpus(spark, sf).select("chunk_id", F.col("source").alias("document_id"), F.concat("lang", F.lit("-"), "source").alias("section"), F.substr("text", F.lit(1), F.lit(30)).alias("text"))
    ranked = search.bm25_topk(spark, sf).filter("rank <= 8").join(docs, "chunk_id")
    got = api.literature_review(_questions(spark, sf), ranked, most=7)
    return got.select("query_id", "cluster", "n", F.md5("prompt").alias("prompt_md5"))


@query(f"WITH {answering._PAIRS} SELECT conv_id, CASE WHEN block IS NULL THEN 'UNSUPPORTED' WHEN overlap >= 0.7 THEN 'SUPPORTED' WHEN overlap >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status, count(*) AS n FROM fx GROUP BY ALL")
def api_verify(spark, sf):
    claims, blocks = answering._numbered(spark, sf)
    rows = claims.select(F.col("conv_id").alias("request_id"), F.struct("turn", "pos").alias("claim_no"), "text", tx.citation_ids(F.col("text")).alias("citation_ids"))
    got = api.verify(rows, blocks.withColumnRenamed("conv_id", "request_id"))
    return got.groupBy(F.col("request_id").alias("conv_id"), "status").agg(F.count("*").alias("n"))


@query(f"WITH {_EVIDENCE}, {_ANSWERS.replace('{0}', 'ev')} SELECT query_id, {_prompt('conflict_detection', answering._sql_text(aw.TASKS['conflict_detection'][0]), 'CONFLICTS')} AS prompt_md5 FROM tx")
def api_conflicts(spark, sf):
    return api.conflicts(_questions(spark, sf), _evidence(spark, sf)).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("SELECT true AS evaluated, 'toxic' AS variant, round(avg(quality), 6) AS mrr FROM labels")
def api_evaluation(spark, sf):
    """Two result files of evaluations: the first known value, the last variant."""
    path = storage.folder(spark, "results")
    labels = v.table(spark, sf, "labels")
    so.write_result(labels.agg(F.lit("quality").alias("variant"), F.round(F.avg("quality"), 6).alias("mrr")), path + "/a", "2024-01-01")
    so.write_result(labels.agg(F.lit("toxic").alias("variant"), F.round(F.avg("toxic"), 6).alias("mrr")), path + "/b", "2024-01-02")
    return api.evaluation(spark, path, "variant string, mrr double", ["mrr"], ["variant"])


@query("SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty file' WHEN doc_id % 10 = 3 THEN 'not a document' ELSE 'uploaded' END AS outcome, count(*) AS n, count(DISTINCT substr(sha1(coalesce(text, '')), 1, 8) || '_f' || doc_id) AS ids FROM documents GROUP BY 1")
def api_upload(spark, sf):
    n = F.col("doc_id")
    files = v.table(spark, sf, "documents").select(F.concat(F.lit("f"), n.cast("string"), F.when(n % 10 == 3, ".exe").otherwise(".pdf")).alias("name"), F.col("text").alias("content"), n.alias("uploaded_at"))
    return api.upload(files).groupBy(F.coalesce("error_message", "status").alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("ids"))


@query("SELECT count(DISTINCT source) AS num_indexed_documents, count(*) AS num_indexed_chunks, 'ok' AS status, 'degraded' AS before FROM documents")
def api_index(spark, sf):
    """Chunks indexed, papers registered, and what the service says of itself before and after."""
    chunks = _chunks(spark, sf)
    papers = chunks.select("document_id").distinct().select("document_id", F.lit("t").alias("title"), F.lit("f").alias("filename"), F.lit(1).alias("num_chunks"), F.lit("indexed").alias("status"), F.lit(1).alias("uploaded_at"))
    library = Library(spark, storage.folder(spark, "library"))
    before = api.health(None, library.catalogue).select(F.col("status").alias("before"))
    api.index(library, papers, chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "document_id", "text"))
    now = Library(spark, library.path)
    return api.health(now.index, now.catalogue).crossJoin(F.broadcast(before))
