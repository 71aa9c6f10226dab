"""Queries of retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import retrieval as rt
from docquarry.plans import views as v

SQL: dict[str, str] = {}
RUN: dict = {}


def query(sql: str | None = None):
    def add(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"WITH {v.CORPUS} SELECT chunk_id, len(regexp_extract_all(text, '[^\s\x0B]+'))::BIGINT AS words, len(t)::BIGINT AS tokens, len(list_distinct(t))::BIGINT AS distinct_tokens FROM (SELECT *, {v.TOKENS.format('text')} AS t FROM corpus)")
def token_stats(spark, sf):
    t = tx.tokens(F.col("text"))
    return v.corpus(spark, sf).select("chunk_id", tx.token_count(F.col("text")).alias("words"), F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


@query(f"WITH {v.QUESTIONS}, {v.BM25} SELECT token, df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark, sf):
    return v.lexical(spark, sf).terms.select("token", "df", F.round("idf", 6).alias("idf"))


_TOP = "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {0}) WHERE rank <= {1}"


@query(f"WITH {v.QUESTIONS}, {v.BM25} {_TOP.format('scored', 20)}")
def bm25_topk(spark, sf):
    return v.lexical(spark, sf).search(v.questions(spark, sf), 20)


@query(f"""WITH {v.QUESTIONS}, {v.BM25}, padded AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM questions CROSS JOIN (SELECT chunk_id FROM corpus WHERE lang = 'es') LEFT JOIN scored USING (query_id, chunk_id))
{_TOP.format('padded', 30)}""")
def bm25_padded(spark, sf):
    return v.lexical(spark, sf).search(v.questions(spark, sf), 30, v.corpus(spark, sf).filter("lang = 'es'").select("chunk_id"), pad=True)


@query(f"WITH {v.QUESTIONS}, {v.BM25}, english AS (SELECT scored.* FROM scored JOIN corpus USING (chunk_id) WHERE lang = 'en') {_TOP.format('english', 20)}")
def bm25_filtered(spark, sf):
    return v.lexical(spark, sf).search(v.questions(spark, sf), 20, v.corpus(spark, sf).filter("lang = 'en'").select("chunk_id"))


@query(f"WITH {v.DENSE} SELECT query_id, chunk_id, score, rank FROM near WHERE rank <= 20")
def dense_topk(spark, sf):
    return rt.dense(v.vectors(spark, sf), v.vector_queries(spark, sf), 20)


@query(f"WITH {v.DENSE}, kept AS (SELECT * FROM dots WHERE label < 5) {_TOP.format('kept', 10)}")
def dense_filtered(spark, sf):
    vecs = v.vectors(spark, sf)
    return rt.dense(vecs, v.vector_queries(spark, sf), 10, vecs.filter("label < 5").select("chunk_id"))


def _shared_tokens(spark, sf):
    """A second ranking: distinct tokens in common with the query."""
    return v.lexical(spark, sf).shared(v.questions(spark, sf), 20)


_LISTS = f"""{v.QUESTIONS}, {v.BM25}, list_a AS ({_TOP.format('scored', 20)}),
shared AS (SELECT query_id, chunk_id, count(*)::DOUBLE AS score FROM (SELECT DISTINCT query_id, token FROM asked) JOIN post USING (token) GROUP BY 1, 2), list_b AS ({_TOP.format('shared', 20)})"""
_FUSE = """fused AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM
(SELECT query_id, chunk_id, rank, {0} AS w, 0 AS list_no FROM list_a UNION ALL SELECT query_id, chunk_id, rank, {1} AS w, 1 AS list_no FROM list_b) GROUP BY 1, 2)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused) WHERE rank <= 20"""


@query(f"WITH {_LISTS}, {_FUSE.format('1.0::DOUBLE', '1.0::DOUBLE')}")
def rrf(spark, sf):
    return rt.fuse([(bm25_topk(spark, sf), 1.0), (_shared_tokens(spark, sf), 1.0)], 20)


@query(f"WITH {_LISTS}, {_FUSE.format('0.7::DOUBLE', '0.3::DOUBLE')}")
def rrf_weighted(spark, sf):
    return rt.fuse([(bm25_topk(spark, sf), 0.7), (_shared_tokens(spark, sf), 0.3)], 20)


@query(f"""WITH {_LISTS}, {_FUSE.format('1.0::DOUBLE', '1.0::DOUBLE').replace('SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused) WHERE rank <= 20', '')}
SELECT 'fast' AS mode, query_id, chunk_id, rank FROM list_a WHERE rank <= 5
UNION ALL SELECT 'balanced', query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused) WHERE rank <= 20""")
def hybrid_modes(spark, sf):
    """Fast mode takes five of one ranking; others fuse two."""
    fast = bm25_topk(spark, sf).filter("rank <= 5").select(F.lit("fast").alias("mode"), "query_id", "chunk_id", "rank")
    return fast.unionByName(rrf(spark, sf).select(F.lit("balanced").alias("mode"), "query_id", "chunk_id", "rank"))


def _double_questions(spark, sf):
    q = v.questions(spark, sf)
    other = q.select((F.col("query_id") - 1).alias("query_id"), F.col("text").alias("more"))
    return q.join(other, "query_id").select("query_id", F.concat("text", F.lit(" and "), "more").alias("text"))


_PARTS = r"""double_q AS (SELECT a.item_id AS id, a.text || ' and ' || b.text AS text FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
bits AS (SELECT id, text, list_filter(list_transform(string_split_regex(text, '(?i)\band\b'), lambda x: regexp_replace(x, '^[ ,.;]+|[ ,.;]+$', '', 'g')), lambda x: x <> '') AS b FROM double_q),
parts AS (SELECT id, unnest(range(0, len(c))) AS part, unnest(c) AS text FROM (SELECT id, CASE WHEN len(b) > 1 THEN b ELSE [text] END AS c FROM bits)),
questions AS (SELECT id * 10000 + part AS query_id, text FROM parts)"""


@query(f"""WITH {_PARTS}, {v.BM25}, best AS ({_TOP.format('scored', 20)}),
merged AS (SELECT query_id // 10000 AS query_id, chunk_id, max(score) AS score FROM best GROUP BY 1, 2) {_TOP.format('merged', 20)}""")
def decompose_merge(spark, sf):
    parts = rt.decomposed(_double_questions(spark, sf)).select((F.col("query_id") * 10000 + F.col("part")).alias("query_id"), "text")
    hits = v.lexical(spark, sf).search(parts, 20)
    return rt.merged(hits.withColumn("query_id", F.floor(F.col("query_id") / 10000)), 20)


def _hits_by_source(spark, sf):
    docs = v.corpus(spark, sf).select("chunk_id", F.col("source").alias("document_id"), F.concat("lang", F.lit("-"), "source").alias("section"))
    return bm25_topk(spark, sf).join(docs, "chunk_id")


_HITS = f"{v.QUESTIONS}, {v.BM25}, best AS ({_TOP.format('scored', 20)}), hits AS (SELECT best.*, source AS document_id, lang || '-' || source AS section FROM best JOIN corpus USING (chunk_id))"


@query(f"""WITH {_HITS} SELECT query_id, chunk_id, rank AS citation_id, document_id, CASE WHEN substr(document_id, 4)::INT % 2 = 0 THEN 'Title of ' || document_id ELSE document_id END AS document_title FROM hits WHERE rank <= 8""")
def evidence_numbering(spark, sf):
    titles = v.corpus(spark, sf).select(F.col("source").alias("document_id")).distinct().filter(F.substring("document_id", 4, 9).cast("int") % 2 == 0).withColumn("title", F.concat(F.lit("Title of "), "document_id"))
    return rt.numbered(_hits_by_source(spark, sf), titles, 8).select("query_id", "chunk_id", "citation_id", "document_id", "document_title")


@query(f"""WITH {_HITS}, f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, document_id) AS r FROM hits)
SELECT query_id, chunk_id, document_id, rank, p AS doc_place FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY r) AS p FROM f) WHERE p <= 3""")
def doc_cap(spark, sf):
    return rt.capped(_hits_by_source(spark, sf), 3).select("query_id", "chunk_id", "document_id", "rank", "doc_place")


@query(f"""WITH {_HITS}, s AS (SELECT query_id, section, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, min(rank)) AS p, count(*) OVER (PARTITION BY query_id) AS many FROM hits GROUP BY 1, 2)
SELECT query_id, chunk_id, rank, CASE WHEN many > 6 AND p >= 6 THEN 'Other' ELSE section END AS cluster FROM hits JOIN s USING (query_id, section)""")
def cluster_other(spark, sf):
    return rt.clustered(_hits_by_source(spark, sf)).select("query_id", "chunk_id", "rank", "cluster")


@query(rf"""WITH q AS (SELECT item_id, {v.GROUNDING_WORDS.format('text')} AS w FROM benchmark), s AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS sentence FROM (SELECT doc_id, {v.SENTENCES.format("coalesce(text, '')")} AS x FROM documents)),
m AS (SELECT item_id, min(doc_id) AS doc_id FROM (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY 1),
o AS (SELECT q.item_id, m.doc_id, pos, len(list_intersect(q.w, {v.GROUNDING_WORDS.format('sentence')}))::BIGINT AS overlap FROM q JOIN m USING (item_id) JOIN s USING (doc_id))
SELECT item_id, doc_id, arg_max(pos, overlap * 1000000 - pos) AS pos, max(overlap) AS overlap FROM o WHERE overlap > 0 GROUP BY 1, 2""")
def highlight_sentence(spark, sf):
    """Of the first document that has a benchmark passage, the sentence that shares most words with it; first wins."""
    docs = v.corpus(spark, sf)
    items = v.questions(spark, sf)
    holds = rt.containing(docs, items).groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))
    pairs = holds.join(items.withColumnRenamed("text", "passage"), "query_id").join(docs, "chunk_id")
    each = pairs.select("query_id", "chunk_id", tx.grounding_words(F.col("passage")).alias("w"), F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    each = each.withColumn("overlap", F.size(F.array_intersect("w", tx.grounding_words(F.col("sentence"))))).filter("overlap > 0")
    best = each.groupBy("query_id", "chunk_id").agg(F.max(F.struct("overlap", (-F.col("pos")).alias("p"))).alias("b"))
    return best.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), (-F.col("b.p")).alias("pos"), F.col("b.overlap").alias("overlap"))
