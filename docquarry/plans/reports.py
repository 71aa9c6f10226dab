"""Queries of score summaries, comparisons, splits and counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import evaluation as ev
from docquarry.operators import reports as rp
from docquarry.operators import sampling as sa
from docquarry.plans import search
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


# Scores of every document as if it were an answer, with gaps. The same text in Spark and SQL.
_SCORE = """doc_id AS qid, lang AS type, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(doc_id * 37 % 101 AS DOUBLE) / 100 END AS faithfulness,
CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id * 53 % 101 AS DOUBLE) / 100 END AS p, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id * 71 % 101 AS DOUBLE) / 100 END AS r,
doc_id % 3 <> 0 AS retrieved, doc_id % 5 < 2 AS passed_old, doc_id % 4 < 2 AS passed_new"""
_SCORES = f"""s0 AS (SELECT {_SCORE} FROM documents), scores AS (SELECT *, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM s0)"""


def _scores(spark, sf):
    rows = v.table(spark, sf, "documents").selectExpr(*[x.strip() for x in _split(_SCORE)])
    return rows.withColumn("f1", rp.f1(F.col("p"), F.col("r")))


def _split(text: str) -> list[str]:
    """Commas outside brackets part columns."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


_METRICS = ("faithfulness", "p", "r", "f1")


@query(f"WITH {_SCORES} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 3) AS mean, count({m}) AS n_scored, count(*) - count({m}) AS n_failed FROM scores" for m in _METRICS))
def score_summary(spark, sf):
    return rp.scored(_scores(spark, sf), list(_METRICS))


@query(f"""WITH {_SCORES} SELECT 'type' AS slice, type AS value, count(*) AS n, round(avg(faithfulness), 3) AS faithfulness, round(avg(f1), 3) AS f1 FROM scores GROUP BY type
UNION ALL SELECT 'retrieved', retrieved::VARCHAR, count(*), round(avg(faithfulness), 3), round(avg(f1), 3) FROM scores GROUP BY retrieved""")
def score_slices(spark, sf):
    """Means by type and by whether the source was retrieved."""
    return rp.slices(_scores(spark, sf), ["faithfulness", "f1"], ["type", "retrieved"])


@query(f"""WITH {_SCORES}, o AS (SELECT qid, passed_old AS a FROM scores WHERE qid % 10 <> 1), n AS (SELECT qid, passed_new AS b FROM scores WHERE qid % 10 <> 2)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (b IS NULL) AS only_old, count(*) FILTER (a IS NULL) AS only_new, count(*) FILTER (a) AS passed_before,
count(*) FILTER (a IS NOT NULL AND coalesce(b, false)) AS passed_after, count(*) FILTER (a = false AND coalesce(b, false)) AS gained, count(*) FILTER (a AND NOT coalesce(b, false)) AS lost FROM o FULL JOIN n USING (qid)""")
def gained_lost(spark, sf):
    rows = _scores(spark, sf)
    old, new = rows.filter("qid % 10 <> 1").withColumnRenamed("passed_old", "ok"), rows.filter("qid % 10 <> 2").withColumnRenamed("passed_new", "ok")
    return rp.compared(old, new, "qid", "ok")


@query(f"WITH {_SCORES} SELECT a.qid, b.f1, a.faithfulness, c.passed_old AS present FROM (SELECT * FROM scores WHERE qid % 2 = 0) a JOIN (SELECT * FROM scores WHERE qid % 3 = 0) b USING (qid) JOIN (SELECT * FROM scores WHERE qid % 5 <> 0) c USING (qid)")
def arms_zipped(spark, sf):
    """Three tables of one variant's scores by question."""
    rows = _scores(spark, sf)
    arms = {"pr": rows.filter("qid % 3 = 0").select("qid", "f1"), "faith": rows.filter("qid % 2 = 0").select("qid", "faithfulness"), "vals": rows.filter("qid % 5 <> 0").select("qid", F.col("passed_old").alias("present"))}
    return rp.zipped(arms, "qid")


@query("SELECT *, row_number() OVER (ORDER BY n DESC, cause) AS place FROM (SELECT CASE event_type WHEN 'view' THEN 'incomplete' ELSE event_type END AS cause, count(*) AS n FROM events GROUP BY 1)")
def cause_histogram(spark, sf):
    rows = v.table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "incomplete").otherwise(F.col("event_type")).alias("cause"))
    return rp.histogram(rows, "cause")


_ANSWERS = """doc_id, source AS config, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'test' END AS split, n_chars % 41 AS answer_words, CAST(doc_id % 5 AS DOUBLE) / 4 AS sentence_coverage, doc_id % 2 = 0 AS cites_any,
doc_id % 4 = 0 AS valid_ids, doc_id % 6 = 0 AS passes_checker, doc_id % 9 AS num_citations"""


@query(f"""WITH a AS (SELECT {_ANSWERS} FROM documents) SELECT config, count(*) AS n, count(*) FILTER (cites_any) AS cites_any, count(*) FILTER (valid_ids) AS valid_ids, count(*) FILTER (passes_checker) AS passes_checker,
count(*) FILTER (split = 'val' AND passes_checker) AS val_passes, count(*) FILTER (split = 'val') AS val_n, count(*) FILTER (split = 'test' AND passes_checker) AS test_passes, count(*) FILTER (split = 'test') AS test_n,
round(avg(sentence_coverage), 4) AS avg_sentence_coverage, round(avg(answer_words), 1) AS avg_answer_words, round(avg(num_citations), 2) AS avg_citations FROM a GROUP BY config""")
def config_comparison(spark, sf):
    return rp.configurations(v.table(spark, sf, "documents").selectExpr(*_split(_ANSWERS)))


_PAPERS = """doc_id AS document_id, CASE WHEN text IS NULL THEN 'failed' WHEN n_chars < 200 THEN 'scanned_needs_ocr' ELSE 'indexed' END AS status, CAST(1 + n_chars % 7 AS BIGINT) AS n_pages, CAST(n_chars % 19 AS BIGINT) AS n_text,
CAST(n_chars % 3 AS BIGINT) AS n_table, CAST(n_chars % 2 AS BIGINT) AS n_figure"""


@query(f"""WITH p AS (SELECT {_PAPERS} FROM documents) SELECT count(*) AS files, sum(n_pages)::BIGINT AS n_pages, sum(n_text)::BIGINT AS n_text, sum(n_table)::BIGINT AS n_table, sum(n_figure)::BIGINT AS n_figure, sum(n_text + n_table + n_figure)::BIGINT AS n_chunks,
count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'scanned_needs_ocr') AS scanned_needs_ocr, count(*) FILTER (status = 'failed') AS failed FROM p""")
def ingest_summary(spark, sf):
    return rp.ingested(v.table(spark, sf, "documents").selectExpr(*_split(_PAPERS)))


_TASKED = "lang AS task, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split"


@query(f"WITH t AS (SELECT {_TASKED} FROM documents) SELECT coalesce(task, 'TOTAL') AS task, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, count(*) AS total FROM t GROUP BY ROLLUP (task)")
def split_matrix(spark, sf):
    return rp.split_matrix(v.table(spark, sf, "documents").selectExpr(*_split(_TASKED)), "task", "split")


@query("SELECT event_type AS run, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1")
def eval_perplexity(spark, sf):
    return v.table(spark, sf, "events").groupBy(F.col("event_type").alias("run")).agg(F.round(rp.perplexity(F.col("value") / 100), 6).alias("perplexity"))


@query("SELECT count(DISTINCT source) AS papers, count(DISTINCT text) AS texts, count(*) AS questions FROM documents")
def distinct_counts(spark, sf):
    return v.table(spark, sf, "documents").agg(F.countDistinct("source").alias("papers"), F.countDistinct("text").alias("texts"), F.count("*").alias("questions"))


@query("SELECT (SELECT count(DISTINCT source) FROM documents) AS num_indexed_documents, (SELECT count(*) FROM documents) AS num_indexed_chunks, CASE WHEN (SELECT count(*) FROM documents) > 0 THEN 'ok' ELSE 'degraded' END AS status")
def health(spark, sf):
    """Documents and chunks that the kept index can find, and whether there are any."""
    chunks = v.lexical(spark, sf).chunk_ids.agg(F.count("*").alias("num_indexed_chunks"))
    docs = v.table(spark, sf, "documents").agg(F.countDistinct("source").alias("num_indexed_documents"))
    return docs.crossJoin(F.broadcast(chunks)).withColumn("status", F.when(F.col("num_indexed_chunks") > 0, "ok").otherwise("degraded"))


@query(f"WITH {v.STATUSES} SELECT round(avg((status = 'SUPPORTED')::INT), 6) AS supported, round(avg((status NOT IN ('SUPPORTED', 'PARTIALLY_SUPPORTED'))::INT), 6) AS bad, count(*) AS n FROM statuses WHERE status <> 'NOT_VERIFIED'")
def base_rates(spark, sf):
    rows = v.statuses(spark, sf).filter("status <> 'NOT_VERIFIED'")
    good = F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED")
    return rows.agg(F.round(rp.share(F.col("status") == "SUPPORTED"), 6).alias("supported"), F.round(rp.share(~good), 6).alias("bad"), F.count("*").alias("n"))


@query(f"""WITH {v.STATUSES} SELECT count(*) AS total_claims, round(avg((status = 'SUPPORTED')::INT) FILTER (status <> 'NOT_VERIFIED'), 6) AS faithfulness, 'Computed from claim verification, not from a judge.' AS note FROM statuses""")
def generation_summary(spark, sf):
    claims = v.statuses(spark, sf).withColumn("citation_ids", F.array(F.lit(1)))
    return ev.citation_metrics(claims).select("total_claims", "faithfulness", F.lit("Computed from claim verification, not from a judge.").alias("note"))


_BEST = f"{v.QUESTIONS}, {v.BM25}, best AS ({search._TOP.format('scored', 20)})"


@query(f"""WITH {_BEST}, b AS (SELECT query_id, source AS document_id, min(rank) AS best FROM best JOIN corpus USING (chunk_id) GROUP BY 1, 2)
SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank, (document_id = 'src' || (query_id % 20))::INT::BIGINT AS hit FROM b""")
def paper_hits(spark, sf):
    """Papers (sources) at their best chunk's rank; the right one is named by the question's number."""
    sources = v.corpus(spark, sf).select("chunk_id", F.col("source").alias("document_id"))
    relevant = v.questions(spark, sf).select("query_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")).alias("document_id"))
    return rp.paper_hits(search.bm25_topk(spark, sf).join(sources, "chunk_id"), relevant)


@query(f"""WITH {_BEST}, r AS (SELECT query_id, chunk_id, source AS document_id, chunk_id % 5 AS page_number, rank FROM best JOIN corpus USING (chunk_id)),
l AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN item_id * 3 END AS chunk_id, 'src' || (item_id % 20) AS document_id, item_id % 5 AS page_number FROM benchmark)
SELECT r.query_id, r.chunk_id, rank, (CASE WHEN l.chunk_id IS NOT NULL THEN l.chunk_id = r.chunk_id ELSE l.document_id = r.document_id AND l.page_number = r.page_number END)::INT::BIGINT AS hit FROM r JOIN l USING (query_id)""")
def relevance_levels(spark, sf):
    """Even questions are judged by chunk, odd ones by document and page."""
    pages = v.corpus(spark, sf).select("chunk_id", F.col("source").alias("document_id"), (F.col("chunk_id") % 5).alias("page_number"))
    q = F.col("query_id")
    labels = v.questions(spark, sf).select("query_id", F.when(q % 2 == 0, q * 3).alias("chunk_id"), F.concat(F.lit("src"), (q % 20).cast("string")).alias("document_id"), (q % 5).alias("page_number"))
    return rp.relevant_hits(search.bm25_topk(spark, sf).join(pages, "chunk_id"), labels).select("query_id", "chunk_id", "rank", "hit")


@query("SELECT round(median(value) / 1000, 1) AS median_s FROM events")
def latency_seconds(spark, sf):
    return v.table(spark, sf, "events").agg(F.round(F.median("value") / 1000, 1).alias("median_s"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '—' ELSE (doc_id * 37 % 101)::VARCHAR || '%' END AS shown FROM documents")
def percent_format(spark, sf):
    return _scores(spark, sf).select(F.col("qid").alias("doc_id"), rp.percent(F.col("faithfulness")).alias("shown"))


@query("""WITH i AS (SELECT doc_id AS qid, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'suspect' ELSE 'broken' END AS verdict, n_chars % 100 AS badness FROM documents)
SELECT *, row_number() OVER (ORDER BY badness DESC, qid) AS place FROM i WHERE verdict <> 'ok' QUALIFY place <= 10""")
def worst_items(spark, sf):
    n = F.col("doc_id") % 4
    rows = v.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.when(n == 0, "ok").when(n == 1, "suspect").otherwise("broken").alias("verdict"), (F.col("n_chars") % 100).alias("badness"))
    return rp.worst(rows, "badness", "qid", 10)


@query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def keep_first(spark, sf):
    rows = v.table(spark, sf, "documents").filter("text is not null").select("text", "doc_id")
    return rp.first_of(rows, ["text"], "doc_id")


_QUESTION = "CASE WHEN doc_id % 3 = 0 THEN upper(source) || ' ' || lang ELSE '  ' || source || ' ' || lang || ' ' END"


@query(f"SELECT doc_id, question FROM (SELECT doc_id, {_QUESTION} AS question FROM documents) QUALIFY row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY doc_id) = 1")
def question_dedupe(spark, sf):
    rows = v.table(spark, sf, "documents").select("doc_id", F.expr(_QUESTION).alias("question"))
    return rp.distinct_questions(rows, "question", "doc_id")


_LEAKY = "CASE WHEN doc_id % 7 = 0 THEN 'val' WHEN doc_id % 7 = 1 THEN 'test' ELSE 'train' END"


@query(f"""WITH t AS (SELECT DISTINCT source, {_LEAKY} AS split FROM documents) SELECT a.split AS a, b.split AS b, count(*) AS shared FROM t a JOIN t b ON a.source = b.source AND a.split < b.split GROUP BY 1, 2""")
def split_overlap(spark, sf):
    """Splits made by document leak by source: how many sources two splits share."""
    return rp.overlaps(v.table(spark, sf, "documents").selectExpr("source", f"{_LEAKY} AS split"), "source", "split")


@query("SELECT conv_id, turn, role, row_number() OVER (ORDER BY turn, conv_id) - 1 AS place FROM conversations")
def page_order(spark, sf):
    """Rows in order of page, then chunk."""
    from docquarry.operators import order as od

    return od.placed(v.turns(spark, sf).select("turn", "conv_id", "role"), "turn", "conv_id")


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 5")
def smoke_limit(spark, sf):
    """The first five questions: a smoke run."""
    return v.table(spark, sf, "benchmark").orderBy("item_id").limit(5)


@query("SELECT conv_id, turn, role, text, 'user' AS half FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, role, text, 'assistant' FROM conversations WHERE role = 'assistant'")
def union_halves(spark, sf):
    rows = v.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    halves = [rows.filter(F.col("role") == r).withColumn("half", F.lit(r)) for r in ("user", "assistant")]
    return halves[0].unionByName(halves[1])


_FRESH = f"""fresh AS (SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), n AS (SELECT count(*) AS all_rows FROM fresh),
q AS (SELECT lang, greatest(1, round_even(40.0 * count(*) / any_value(all_rows), 0)) AS quota FROM fresh, n GROUP BY lang)"""


@query(f"""WITH {_FRESH} SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {v.DRAW.format("'33|' || doc_id::VARCHAR")}, doc_id) AS place FROM fresh) JOIN q USING (lang) WHERE place <= quota""")
def frozen_sample(spark, sf):
    """Questions that weren't used before, by type in proportion; drawn once, written, and the same ever after: what is
    asked for later, of other rows and by another seed, is what was drawn first."""
    docs = v.table(spark, sf, "documents").select("doc_id", "lang")
    fresh = docs.join(v.table(spark, sf, "labels"), "doc_id", "left_anti")
    path = storage.folder(spark, "frozen")
    sa.frozen(sa.proportional(fresh, "lang", "doc_id", 40, seed=33), path)
    return sa.frozen(sa.proportional(docs, "lang", "doc_id", 9, seed=1), path)


@query(f"""WITH c AS (SELECT source, unnest(['summarize', 'limitations']) AS kind, 0 AS n FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT source, 'qa', unnest(range(0, 2)) FROM (SELECT source FROM documents WHERE n_chars >= 1500 AND lang <> 'es'))
SELECT kind, count(*) AS candidates, count(DISTINCT source) AS papers FROM c GROUP BY 1""")
def candidate_expansion(spark, sf):
    """Papers by task, and long chunks outside one section by question index."""
    docs = v.table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("section"), "n_chars")
    got = sa.candidates(docs, seed=(F.col("n_chars") >= 1500) & (F.col("section") != "es"), papers=("summarize", "limitations"), questions=2)
    return got.groupBy("kind").agg(F.count("*").alias("candidates"), F.countDistinct("document_id").alias("papers"))


@query("""WITH d AS (SELECT DISTINCT source, lang FROM documents), k AS (SELECT lang, count(*) AS n FROM d GROUP BY 1)
SELECT task, sum(pool)::BIGINT AS pool FROM (SELECT 'single' AS task, (SELECT count(DISTINCT source) FROM documents WHERE lang IN ('en', 'fr')) AS pool
UNION ALL SELECT 'pair', n * (n - 1) // 2 FROM k WHERE lang = 'de' UNION ALL SELECT 'group', n // 4 + (n % 4 >= 3)::INT FROM k WHERE lang = 'es') GROUP BY 1""")
def task_pools(spark, sf):
    """Pools of single papers, pairs and groups, of the papers that have a task's sections."""
    docs = v.table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("section"))
    pools = sa.pools(docs, {"single": ("one", ["en", "fr"]), "pair": ("pair", ["de"]), "group": ("group", ["es"])}, group=4, least=3)
    return pools.groupBy("task").agg(F.sum("pool").alias("pool"))


@query(f"""WITH d AS (SELECT doc_id, source FROM documents WHERE n_chars > 300), q AS (SELECT item_id, 'src' || (item_id % 20) AS source FROM benchmark)
SELECT item_id, d.doc_id FROM q JOIN d ON d.source = 'src' || ((item_id % 20 + 1 + item_id % 19) % 20) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY {v.DRAW.format("'5|' || item_id::VARCHAR || '|' || d.doc_id::VARCHAR")}, d.doc_id) = 1""")
def negative_context(spark, sf):
    """For each question a chunk of a document that isn't its own: another document first, then one of its chunks."""
    docs = v.table(spark, sf, "documents").filter("n_chars > 300").select("doc_id", "source")
    other = (F.col("item_id") % 20 + 1 + F.col("item_id") % 19) % 20
    asked = v.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("src"), other.cast("string")).alias("source"))
    drawn = asked.join(docs, "source").withColumn("__d", ev.draw(F.lit(5), F.col("item_id"), F.col("doc_id")))
    first = F.row_number().over(Window.partitionBy("item_id").orderBy("__d", "doc_id"))
    return drawn.withColumn("__n", first).filter("__n = 1").select("item_id", "doc_id")
