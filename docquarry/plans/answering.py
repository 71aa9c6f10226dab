"""Queries from evidence to checked answers, question filters and label audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answering as aw
from docquarry.operators import clients as cs
from docquarry.operators import audits as au
from docquarry.operators import retrieval as rt
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


# Embedding, hybrid retrieval and reranking ----------------------------------------------------------------------------

_D = aw.DIMENSION
_EMBED = """SELECT {0}, [x / nullif(sqrt(list_sum([y * y FOR y IN raw])), 0) FOR x IN raw] AS e FROM (SELECT {0}, [coalesce(list_sum([CASE WHEN ('0x' || substr(md5(t), 1, 6))::BIGINT % {2} = i THEN (CASE WHEN substr(md5(t), 7, 1) BETWEEN '0' AND '7' THEN 1.0 ELSE -1.0 END) ELSE 0.0 END FOR t IN w]), 0.0)::DOUBLE FOR i IN range({2})] AS raw
  FROM (SELECT {0}, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM {1}))"""


@query(f"WITH e AS ({_EMBED.format('item_id', 'benchmark', _D)}) SELECT item_id, unnest(range({_D})) AS place, round(coalesce(unnest(e), 0)::FLOAT::DOUBLE, 5) AS value FROM e")
def embed_hashed(spark, sf):
    """The default encoder's vectors of the questions."""
    rows = aw.embedded(v.questions(spark, sf))
    return rows.select(F.col("query_id").alias("item_id"), F.posexplode("embedding").alias("place", "x")).select("item_id", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 5).alias("value"))


#: A dense list that needs no model and is the same in SQL: the questions' twins among the vectors, by number.
_TWINS = """tw AS (SELECT item_id AS query_id, (item_id * 20) % (SELECT count(*) FROM embeddings) AS vec_id FROM benchmark), dl AS (SELECT tw.query_id, d.vec_id AS chunk_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM tw JOIN embeddings q USING (vec_id), embeddings d),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dl QUALIFY rank <= 20)"""


def _dense(spark, sf, k):
    n = v.table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    twins = v.questions(spark, sf).crossJoin(F.broadcast(n)).select("query_id", (F.col("query_id") * 20 % F.col("n")).alias("chunk_id"))
    asked = twins.join(v.vectors(spark, sf).select("chunk_id", "embedding"), "chunk_id").select("query_id", "embedding")
    return rt.dense(v.vectors(spark, sf), asked, k)


def _lexical(spark, sf, k):
    return v.lexical(spark, sf).search(v.questions(spark, sf), k)


_TWO = f"{v.QUESTIONS}, {v.BM25}, list_b AS ({search._TOP.format('scored', 20)}), {_TWINS}, list_a AS (SELECT * FROM dense)"
_FUSED = search._FUSE.format("1.0::DOUBLE", "1.0::DOUBLE")
_ONLY_FUSED = _FUSED[: _FUSED.index("SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number()")]


@query(f"""WITH {_TWO}, {_ONLY_FUSED} SELECT 'fast' AS mode, query_id, chunk_id, rank FROM dense WHERE rank <= 5
UNION ALL SELECT 'balanced', query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused) WHERE rank <= 20""")
def hybrid_dense_bm25(spark, sf):
    """Both modes: the dense list alone, and fused with BM25."""
    dense, lexical = (lambda k: _dense(spark, sf, k)), (lambda k: _lexical(spark, sf, k))
    parts = [aw.retrieved(m, dense, lexical).select(F.lit(m).alias("mode"), "query_id", "chunk_id", "rank") for m in ("fast", "balanced")]
    return parts[0].unionByName(parts[1])


_RERANKED = f"""h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused QUALIFY rank <= 20),
rr AS (SELECT query_id, chunk_id, rank, round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), regexp_extract_all(lower(c.text), '[a-z0-9]+'))) / nullif(len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+'))), 0), 0), 6) AS score FROM h JOIN questions q USING (query_id) JOIN corpus c USING (chunk_id)),
re AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS rank FROM rr)"""


def _hybrid(spark, sf):
    return aw.retrieved("balanced", lambda k: _dense(spark, sf, k), lambda k: _lexical(spark, sf, k))


def _with_text(ranked, spark, sf):
    docs = v.corpus(spark, sf).select("chunk_id", "text")
    return docs.join(rt.sent(ranked), "chunk_id").join(v.questions(spark, sf).withColumnRenamed("text", "query"), "query_id")


@query(f"WITH {_TWO}, {_ONLY_FUSED}, {_RERANKED} SELECT query_id, chunk_id, score, rank FROM re WHERE rank <= 8")
def rerank_stub(spark, sf):
    """The fused list scored anew by the default reranker."""
    return aw.reranked(_with_text(_hybrid(spark, sf), spark, sf), 8).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_TWO}, {_ONLY_FUSED} SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank FROM fused) WHERE rank <= 20")
def rerank_off(spark, sf):
    """Without a reranker the fused list stays."""
    return aw.reranked(_hybrid(spark, sf), 8, score=None).select("query_id", "chunk_id", "rank")


@query(f"""WITH {_TWO}, {_ONLY_FUSED}, {_RERANKED} SELECT 'dense' AS arm, query_id, chunk_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM list_b WHERE rank <= 10
UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM h WHERE rank <= 10 UNION ALL SELECT 'hybrid+rerank', query_id, chunk_id, rank FROM re WHERE rank <= 10""")
def four_arms(spark, sf):
    # each list is searched for once: the arms are made of the same ones
    dense, lexical = storage.written(_dense(spark, sf, 20)), storage.written(_lexical(spark, sf, 20))
    hybrid = storage.written(aw.retrieved("balanced", lambda k: dense.filter(F.col("rank") <= k), lambda k: lexical.filter(F.col("rank") <= k)))
    return aw.arms({"dense": dense, "bm25": lexical, "hybrid": hybrid, "hybrid+rerank": aw.reranked(_with_text(hybrid, spark, sf), 20)})


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label FROM embeddings),
s AS (SELECT 'whole' AS arm, query_id, q.label = d.label AS hit, chunk_id, round(list_dot_product(q.e, d.e), 6) AS score FROM q, d UNION ALL SELECT 'half', query_id, q.label = d.label, chunk_id, round(list_dot_product(q.e[1:32], d.e[1:32]), 6) FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT arm, round(avg(h), 6) AS hit_at_5 FROM (SELECT arm, query_id, max(hit::INT) AS h FROM r WHERE rank <= 5 GROUP BY 1, 2) GROUP BY 1""")
def embedder_comparison(spark, sf):
    """Two encoders over the same corpus: whole vectors, and their first halves."""
    vectors, asked = v.vectors(spark, sf), v.vector_queries(spark, sf)
    lists = {"whole": rt.dense(vectors, asked, 5), "half": rt.dense(*(df.withColumn("embedding", F.slice("embedding", 1, 32)) for df in (vectors, asked)), 5)}
    hits = v.with_hits(aw.arms(lists, 5), spark, sf).groupBy("arm", "query_id").agg(F.max("hit").alias("h"))
    return hits.groupBy("arm").agg(F.round(F.avg("h"), 6).alias("hit_at_5"))


#: A chunk is right for a question if it is a vector with the label of the question's twin.
_RIGHT = "rt AS (SELECT tw.query_id, d.vec_id AS chunk_id FROM tw JOIN embeddings q USING (vec_id) JOIN embeddings d ON d.label = q.label)"


def _right(ranked, spark, sf):
    n = v.table(spark, sf, "embeddings").agg(F.count("*").alias("n"))
    labels = v.vectors(spark, sf).select("chunk_id", "label")
    twins = v.questions(spark, sf).crossJoin(F.broadcast(n)).select("query_id", (F.col("query_id") * 20 % F.col("n")).alias("chunk_id"))
    own = twins.join(labels, "chunk_id").select("query_id", F.col("label").alias("wanted"))
    return ranked.join(own, "query_id").join(labels, "chunk_id", "left").withColumn("hit", F.when(F.col("label") == F.col("wanted"), 1).otherwise(0)).drop("label", "wanted")


@query(f"""WITH {_TWO}, {_ONLY_FUSED}, {_RERANKED}, {_RIGHT}, arms AS (SELECT 'dense' AS arm, query_id, chunk_id, rank FROM dense UNION ALL SELECT 'bm25', query_id, chunk_id, rank FROM list_b UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM h UNION ALL SELECT 'hybrid+rerank', query_id, chunk_id, rank FROM re),
q AS (SELECT arm, query_id, CASE WHEN query_id <= (SELECT median(item_id) FROM benchmark) THEN 'hard' ELSE 'easy' END AS half, 'kind' || (query_id % 3) AS kind, max(CASE WHEN a.rank <= 5 AND rt.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS h, coalesce(1 / min(CASE WHEN rt.chunk_id IS NOT NULL THEN a.rank END), 0) AS rr FROM arms a LEFT JOIN rt USING (query_id, chunk_id) WHERE a.rank <= 10 GROUP BY ALL)
SELECT arm, g AS slice, count(*) AS n, round(avg(h), 6) AS hit_at_5, round(avg(rr), 6) AS mrr FROM (SELECT *, unnest(['all', half, kind]) AS g FROM q) GROUP BY 1, 2""")
def arm_slices(spark, sf):
    """All four strategies by kind of question and by half; a question is in several slices."""
    rows = _right(four_arms(spark, sf), spark, sf).groupBy("arm", "query_id").agg(F.max(F.when((F.col("rank") <= 5) & (F.col("hit") == 1), 1).otherwise(0)).alias("h"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))
    mid = v.questions(spark, sf).agg(F.median("query_id").alias("mid"))
    half = F.when(F.col("query_id") <= F.col("mid"), "hard").otherwise("easy")
    kind = F.concat(F.lit("kind"), (F.col("query_id") % 3).cast("string"))
    each = rows.crossJoin(F.broadcast(mid)).withColumn("slice", F.explode(F.array(F.lit("all"), half, kind)))  # one row
    return each.groupBy("arm", "slice").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"""WITH {_TWO}, {_RIGHT}, grid AS (SELECT w, k FROM (VALUES (0.3::DOUBLE), (0.5), (0.7)) a(w), (VALUES (10), (60)) b(k)), both_lists AS (SELECT query_id, chunk_id, rank, 0 AS l FROM list_a UNION ALL SELECT query_id, chunk_id, rank, 1 FROM list_b),
f AS (SELECT w, k, query_id, chunk_id, round(sum(CASE WHEN l = 0 THEN w ELSE 1 - w END / (k + rank)), 9) AS s FROM both_lists, grid GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY w, k, query_id ORDER BY s DESC, chunk_id) AS rank FROM f),
q AS (SELECT w, k, query_id, (SELECT count(*) FROM benchmark b WHERE b.item_id < r.query_id) % 2 AS half, max(CASE WHEN r.rank <= 5 AND rt.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS h, coalesce(1 / min(CASE WHEN rt.chunk_id IS NOT NULL THEN r.rank END), 0) AS rr FROM r LEFT JOIN rt USING (query_id, chunk_id) GROUP BY ALL),
m AS (SELECT w, k, half, round(avg(h), 6) AS hit_at_5, round(avg(rr), 6) AS mrr FROM q GROUP BY ALL), best AS (SELECT w, k FROM m WHERE half = 0 ORDER BY hit_at_5 DESC, mrr DESC, w, k LIMIT 1)
SELECT w, k::BIGINT AS k, CASE half WHEN 0 THEN 'tune' ELSE 'held_out' END AS half, hit_at_5, mrr FROM m JOIN best USING (w, k)""")
def sweep_halves(spark, sf):
    """Fusion settings tried on every second question; the best is reported on both halves."""
    from docquarry.operators import order as od

    lists = _dense(spark, sf, 20).select("query_id", "chunk_id", "rank", F.lit(0).alias("l")).unionByName(_lexical(spark, sf, 20).select("query_id", "chunk_id", "rank", F.lit(1).alias("l")))
    grid = spark.createDataFrame([(w, k) for w in (0.3, 0.5, 0.7) for k in (10, 60)], "w double, k long")
    weight = F.when(F.col("l") == 0, F.col("w")).otherwise(1 - F.col("w"))
    fused = lists.crossJoin(F.broadcast(grid)).groupBy("w", "k", "query_id", "chunk_id").agg(F.round(F.sum(weight / (F.col("k") + F.col("rank"))), 9).alias("s"))
    from pyspark.sql import Window

    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("w", "k", "query_id").orderBy(F.desc("s"), "chunk_id")))
    halves = od.placed(v.questions(spark, sf).select("query_id"), "query_id").select("query_id", F.when(F.col("place") % 2 == 0, "tune").otherwise("held_out").alias("half"))
    q = _right(ranked, spark, sf).groupBy("w", "k", "query_id").agg(F.max(F.when((F.col("rank") <= 5) & (F.col("hit") == 1), 1).otherwise(0)).alias("h"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))
    m = q.join(halves, "query_id").groupBy("w", "k", "half").agg(F.round(F.avg("h"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))
    best = m.filter("half = 'tune'").orderBy(F.desc("hit_at_5"), F.desc("mrr"), "w", "k").limit(1).select("w", "k")
    return m.join(F.broadcast(best), ["w", "k"])  # one row


# Evidence, prompts and contexts ---------------------------------------------------------------------------------------

_EVIDENCE = """ev AS (SELECT item_id AS query_id, n AS citation_id, 'Title ' || (item_id + n) AS document_title, n * 2 AS page_number, 'Results' AS section, left(text, 40 * n::INT) AS text FROM benchmark, range(1, 6) t(n))"""


def _evidence(spark, sf):
    rows = v.questions(spark, sf).select("query_id", "text", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("citation_id"))
    return rows.select("query_id", F.col("citation_id").cast("long").alias("citation_id"), F.concat(F.lit("Title "), (F.col("query_id") + F.col("citation_id")).cast("string")).alias("document_title"), (F.col("citation_id") * 2).alias("page_number"), F.lit("Results").alias("section"), F.substr("text", F.lit(1), F.col("citation_id") * 40).alias("text"))


_BLOCKS = "'[' || citation_id || '] Paper: ' || document_title || ' | Page: ' || page_number || ' | Section: ' || section || chr(10) || text"


@query(f"WITH {_EVIDENCE} SELECT query_id, string_agg({_BLOCKS}, chr(10) || chr(10) ORDER BY citation_id) AS evidence_text FROM ev GROUP BY 1")
def evidence_text(spark, sf):
    return aw.evidence_text(_evidence(spark, sf), "query_id")


_KINDS = [*aw.ROUTES, "question_answering"]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_filled(template: str, hole: str) -> str:
    return "(" + _sql_text(template).replace("{0}", f"' || {hole} || '") + ")"


_PROMPTS = " ".join(
    f"WHEN {_sql_text(kind)} THEN {_sql_filled(aw.TASKS[task][0], _sql_filled(wording, 'question'))} || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || e || chr(10) || chr(10) || '{aw.TASKS[task][1]}:'"
    for kind in _KINDS
    for task, wording in [aw.ROUTES.get(kind, ("qa", "{0}"))]
)


@query(f"""WITH {_EVIDENCE}, t AS (SELECT query_id, string_agg({_BLOCKS}, chr(10) || chr(10) ORDER BY citation_id) AS e FROM ev GROUP BY 1), q AS (SELECT item_id AS query_id, left(text, 60) AS question, {[*_KINDS]}[item_id % {len(_KINDS)} + 1] AS kind FROM benchmark)
SELECT query_id, kind, md5(CASE kind {_PROMPTS} END) AS prompt_md5 FROM q JOIN t USING (query_id)""")
def prompts(spark, sf):
    """Every kind of query routed to its prompt."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("query_id") % len(_KINDS) + 1).cast("int"))
    rows = v.questions(spark, sf).select("query_id", F.substr("text", F.lit(1), F.lit(60)).alias("question"), kind.alias("kind")).join(evidence_text(spark, sf), "query_id")
    return rows.select("query_id", "kind", F.md5(aw.prompt(F.col("kind"), F.col("question"), F.col("evidence_text"))).alias("prompt_md5"))


@query(f"WITH {_EVIDENCE} SELECT query_id, citation_id, text FROM ev WHERE text <> ''")
def context_inverse(spark, sf):
    """Evidence put into a context and taken out of it again."""
    context = aw.context_text(_evidence(spark, sf), "query_id")
    return context.select("query_id", F.explode(aw.evidence_of(F.col("context"))).alias("citation_id", "text"))


@query(f"""WITH {_EVIDENCE}, t AS (SELECT *, sum(len(regexp_extract_all(text, '[^\\s\\x0B]+'))) OVER (PARTITION BY query_id ORDER BY citation_id) + 25 AS s FROM ev),
k AS (SELECT query_id, max(citation_id) AS k FROM t WHERE citation_id IN (3, 4, 5) AND s <= 95 GROUP BY 1) SELECT query_id, citation_id FROM t JOIN k USING (query_id) WHERE citation_id <= k""")
def prompt_budget(spark, sf):
    """The largest of 5, 4 or 3 blocks whose words fit."""
    rows = _evidence(spark, sf).withColumn("n", tx.token_count(F.col("text")))
    return aw.fitted(rows, "n", 95).select("query_id", "citation_id")


@query("""SELECT doc_id, md5('<|im_start|>' || CASE WHEN doc_id % 3 = 0 THEN 'system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || source ELSE 'user' || chr(10) || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Context:' || chr(10) || source ELSE '' END END
 || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10)) AS text_md5 FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[^\\s\\x0B]+')) <= 200""")
def chat_format(spark, sf):
    """Training text in ChatML; examples that are too long go whole."""
    rows = v.table(spark, sf, "documents").filter("text is not null")
    every = F.col("doc_id") % 3 == 0
    before = aw.messages(F.when(every, "Be brief."), F.when(every, F.col("source")), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return aw.within_length(rows, "text", 200).select("doc_id", F.md5(aw.chat_text(before, F.col("text"))).alias("text_md5"))


# Verification and second tries ----------------------------------------------------------------------------------------

#: Claims with numbers, of which some stand in the block they cite: the turn's text with figures put behind it.
_NUMBERED = r"""nb AS (SELECT conv_id, citation_id, text || ' It reached ' || (conv_id * 7 % 1000 + 100) || ' and ' || (conv_id % 9) || '.' || citation_id || ' in all.' AS text FROM evidence),
nc AS (SELECT conv_id, turn, pos, regexp_replace(text, '( \[\d+\])?$', '') || CASE (conv_id + pos) % 3 WHEN 0 THEN ' reached ' || (conv_id * 7 % 1000 + 100) WHEN 1 THEN ' reached ' || (conv_id % 9) || '.' || pos ELSE ' of 42' END || regexp_extract(text, '( \[\d+\])?$') AS text FROM claims)"""


def _numbered(spark, sf):
    conv, pos = F.col("conv_id"), F.col("pos")
    number = (conv * 7 % 1000 + 100).cast("string")
    blocks = v.evidence(spark, sf).withColumn("text", F.concat("text", F.lit(" It reached "), number, F.lit(" and "), (conv % 9).cast("string"), F.lit("."), F.col("citation_id").cast("string"), F.lit(" in all.")))
    tail = F.when((conv + pos) % 3 == 0, F.concat(F.lit(" reached "), number)).when((conv + pos) % 3 == 1, F.concat(F.lit(" reached "), (conv % 9).cast("string"), F.lit("."), pos.cast("string"))).otherwise(" of 42")
    cite = F.regexp_extract("text", r"( \[\d+\])?$", 0)
    claims = v.cited_claims(spark, sf).withColumn("text", F.concat(F.substr("text", F.lit(1), F.length("text") - F.length(cite)), tail, cite))
    return claims, blocks


_PAIRS = rf"""{v.CLAIMS}, {_NUMBERED}, pairs AS (SELECT nc.*, try_cast(regexp_extract(nc.text, '\[(\d+)\]$', 1) AS BIGINT) AS cid, nb.text AS block FROM nc LEFT JOIN nb ON nb.conv_id = nc.conv_id AND nb.citation_id = try_cast(regexp_extract(nc.text, '\[(\d+)\]$', 1) AS BIGINT)),
sig AS (SELECT *, trim(regexp_replace(text, '\[\d+(?:\s*,\s*\d+)*\]', '', 'g')) AS bare FROM pairs),
sw AS (SELECT *, {v.GROUNDING_WORDS.format('bare')} AS cw, {v.GROUNDING_WORDS.format("coalesce(block, '')")} AS ew,
  [{v.STEM.format('y')} FOR y IN [CASE WHEN regexp_matches(x, '^[a-z]') THEN regexp_replace(x, '^[.\-]+|[.\-]+$', '', 'g') ELSE '' END FOR x IN regexp_extract_all(lower(coalesce(block, '')), '[a-z0-9.\-]+')]] AS st,
  [regexp_replace(x, '^[.\-]+|[.\-]+$', '', 'g') FOR x IN regexp_extract_all(lower(coalesce(block, '')), '[a-z0-9.\-]+')] AS pt FROM sig),
tk AS (SELECT *, [CASE WHEN regexp_matches(pt[i], '^[a-z]') THEN st[i] ELSE pt[i] END FOR i IN range(1, len(pt) + 1)] AS tokens, regexp_extract_all(bare, '\d+(?:\.\d+)?') AS nums, regexp_extract_all(bare, '\d+\.\d+|\d{{3,}}') AS spec FROM sw),
fx AS (SELECT *, CASE WHEN block IS NULL OR len(cw) = 0 THEN 0 ELSE len(list_intersect(cw, ew)) / len(cw) END AS overlap, CASE WHEN block IS NULL OR len(cw) = 0 THEN [] ELSE list_filter(nums, lambda n: NOT contains(block, n)) END AS missing,
  block IS NULL OR len(cw) = 0 OR len(list_filter(spec, lambda n: coalesce(list_max([CASE WHEN tokens[i] = n THEN len(list_intersect(cw, list_distinct(tokens[greatest(i - 30, 1):i + 30]))) / len(cw) END FOR i IN range(1, len(tokens) + 1)]), 0) < 0.4)) = 0 AS context_ok FROM tk)"""


def _with_blocks(claims, blocks):
    from docquarry.operators import claims as cl

    each = claims.withColumn("ids", tx.citation_ids(F.col("text")))
    cited = each.select("conv_id", "turn", "pos", F.posexplode("ids").alias("at", "citation_id")).join(blocks.withColumnRenamed("text", "block"), ["conv_id", "citation_id"])
    lists = cited.groupBy("conv_id", "turn", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda s: s["block"]).alias("cited"))
    return cl.grounded(each.join(lists, ["conv_id", "turn", "pos"], "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>"))))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, pos, round(overlap, 6) AS overlap, round(overlap, 6) AS min_cite_overlap, len(missing)::BIGINT AS n_missing, context_ok,
CASE WHEN block IS NULL OR len(missing) > 0 THEN 'none' WHEN overlap >= 0.7 THEN CASE WHEN NOT context_ok OR overlap < 0.15 THEN 'weak' ELSE 'strong' END WHEN overlap >= 0.45 THEN 'weak' ELSE 'none' END AS grounding,
round(round_even(CASE WHEN block IS NULL THEN 0 WHEN len(missing) > 0 THEN least(overlap, 0.3) ELSE overlap END, 3), 3) AS grounding_score FROM fx""")
def grounding_numbers(spark, sf):
    """Claims with numbers: missing ones, their surroundings, and the score."""
    got = _with_blocks(*_numbered(spark, sf))
    return got.select("conv_id", "turn", "pos", F.round("overlap", 6).alias("overlap"), F.round("min_cite_overlap", 6).alias("min_cite_overlap"), F.size("missing").alias("n_missing"), "context_ok", "grounding", "grounding_score")


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, pos, CASE WHEN block IS NULL THEN 'UNSUPPORTED' WHEN overlap >= 0.7 THEN 'SUPPORTED' WHEN overlap >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS status FROM fx""")
def verify_claims(spark, sf):
    claims, blocks = _numbered(spark, sf)
    rows = claims.withColumn("claim_no", F.struct("turn", "pos")).withColumn("citation_ids", tx.citation_ids(F.col("text")))
    return aw.verified(rows, blocks, aw.overlap_verifier, "conv_id").select("conv_id", "turn", "pos", "status")


@query(f"""WITH {_PAIRS}, a AS (SELECT conv_id, turn, list(text ORDER BY pos) AS texts, count(*) AS n, count(cid) AS n_cited, count(*) FILTER (len(missing) > 0) AS bad, sum(len(missing)) AS bad_numbers, count(block) AS valid FROM fx GROUP BY 1, 2)
SELECT conv_id, turn, round(n_cited / n, 6) AS cited_fraction, round(bad / n, 6) AS unsupported_rate, bad_numbers::BIGINT AS unverified_numbers, valid > 0 AS has_valid FROM a""")
def answer_gates(spark, sf):
    """What the gates on a second try look at, for each answer."""
    claims, blocks = _numbered(spark, sf)
    one = F.struct("pos", "text", tx.citation_ids(F.col("text")).alias("citation_ids"))
    said = claims.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(one)).alias("claims"))
    held = blocks.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("citation_id").cast("int").alias("k"), "text"))).alias("evidence"))
    rows = said.join(held, "conv_id", "left").withColumn("evidence", F.coalesce("evidence", F.create_map().cast("map<int,string>")))
    faulty = F.filter("claims", lambda c: F.size(aw.unverified_numbers(F.array(c), F.col("evidence"))) > 0)
    ids = F.map_keys("evidence")
    answer = F.array_join(F.transform("claims", lambda c: c["text"]), " ")
    return rows.select("conv_id", "turn", F.round(aw.cited_fraction(F.col("claims")), 6).alias("cited_fraction"), F.round(aw.unsupported_rate(F.col("claims"), faulty), 6).alias("unsupported_rate"), F.size(aw.unverified_numbers(F.col("claims"), F.col("evidence"))).alias("unverified_numbers"), F.coalesce(aw.has_valid_citation(answer, ids), F.lit(False)).alias("has_valid"))


_TRIES = """SELECT item_id, CASE item_id % 4 WHEN 0 THEN '[4]' WHEN 1 THEN 'It grows with depth.' WHEN 2 THEN 'It grows [1].' ELSE 'The evidence does not specify this.' END AS answer,
CASE item_id % 3 WHEN 0 THEN '[2]' WHEN 1 THEN 'It grows with depth [2].' ELSE 'It grows with depth [9].' END AS revised FROM benchmark"""


@query(f"""WITH t AS ({_TRIES}), s AS (SELECT *, CASE WHEN item_id % 4 <> 0 THEN answer WHEN item_id % 3 <> 0 THEN revised ELSE '{aw.NO_ANSWER}' END AS solid FROM t)
SELECT item_id, solid, CASE WHEN solid = 'It grows with depth.' AND item_id % 3 <> 2 THEN revised WHEN solid = 'It grows with depth [9].' AND FALSE THEN revised ELSE solid END AS cited,
CASE WHEN item_id % 2 = 0 AND item_id % 5 = 0 THEN revised ELSE answer END AS valued FROM s""")
def retry_gates(spark, sf):
    """Second tries for answers that say nothing, cite nothing or have wrong numbers: taken only if better."""
    n = F.col("item_id")
    rows = v.table(spark, sf, "benchmark").select(n, F.when(n % 4 == 0, "[4]").when(n % 4 == 1, "It grows with depth.").when(n % 4 == 2, "It grows [1].").otherwise("The evidence does not specify this.").alias("answer"), F.when(n % 3 == 0, "[2]").when(n % 3 == 1, "It grows with depth [2].").otherwise("It grows with depth [9].").alias("revised"))
    solid = aw.with_substance(F.col("answer"), F.col("revised"))
    rows = rows.withColumn("solid", solid)
    bad = F.when(n % 2 == 0, F.array(F.lit("7"), F.lit("8"))).otherwise(F.array().cast("array<string>"))
    after = F.when(n % 5 == 0, F.array(F.lit("7"))).otherwise(F.array(F.lit("7"), F.lit("9")))
    return rows.select("item_id", "solid", aw.with_citations(F.col("solid"), F.col("revised"), F.array(F.lit(1), F.lit(2))).alias("cited"), aw.with_values(F.col("answer"), F.col("revised"), bad, after).alias("valued"))


@query(f"""WITH t AS ({_TRIES}) SELECT item_id, md5('Q' || chr(10) || chr(10) || '---' || chr(10) || 'Your previous answer was:' || chr(10) || answer || chr(10) || chr(10) || 'The numbers 3, 7 are not in the blocks that are cited for them. Give each value as its block states it. Output only the revised answer.') AS prompt_md5 FROM t""")
def retry_prompts(spark, sf):
    rows = retry_gates(spark, sf).select("item_id", F.col("item_id").alias("n"))
    n = F.col("item_id")
    answer = F.when(n % 4 == 0, "[4]").when(n % 4 == 1, "It grows with depth.").when(n % 4 == 2, "It grows [1].").otherwise("The evidence does not specify this.")
    return rows.select("item_id", F.md5(aw.retry_prompt(F.lit("Q"), answer, aw.value_fault(F.array(F.lit("7"), F.lit("3"), F.lit("7"))))).alias("prompt_md5"))


# Questions, labels and scores -----------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN doc_id % 10 = 0 THEN 'References' ELSE 'Results' END AS section, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\s\x0B]+')) AS n FROM documents)
SELECT doc_id, section <> 'References' AND CASE kind WHEN 'text' THEN n BETWEEN 90 AND 420 AND coalesce(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(length(text), 0), 0) < 0.12 WHEN 'table' THEN length(text) - length(replace(text, '|', '')) >= 12 AND n <= 500 ELSE n >= 12 END AS eligible FROM c""")
def chunk_eligibility(spark, sf):
    n = F.col("chunk_id")
    kind, section = F.when(n % 3 == 0, "text").when(n % 3 == 1, "table").otherwise("figure"), F.when(n % 10 == 0, "References").otherwise("Results")
    return v.corpus(spark, sf).select(n.alias("doc_id"), au.eligible(kind, section, F.col("text"), tx.token_count(F.col("text"))).alias("eligible"))


_ASKED = """doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'Too short?' WHEN 2 THEN 'How does this paper measure the ABC value of its own model?' WHEN 3 THEN 'What does Table 4 list as the ABC value of the model?' WHEN 4 THEN 'what are the usual ways of doing such things at all today?'
WHEN 5 THEN array_to_string(regexp_extract_all(coalesce(text, ''), '[a-z0-9]+')[1:9], ' ') || ' ABC?' ELSE 'Which value of ABC-' || doc_id || ' was found for the larger of both models?' END AS question,
CASE doc_id % 4 WHEN 0 THEN 'It is 12345' WHEN 1 THEN 'yes' WHEN 2 THEN left(coalesce(text, ''), 200) ELSE 'nothing of this stands in it anywhere' END AS answer, CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'text' END AS kind, coalesce(text, '') AS text"""
_SHARES = "len(list_intersect({0}, {1})) > 0"
_FIVE = "list_distinct(list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: array_to_string({0}[i : i + 4], ' ')))"


@query(rf"""WITH a AS (SELECT {_ASKED} FROM documents), w AS (SELECT *, regexp_extract_all(lower(question), '[a-z0-9]+') AS qt, regexp_extract_all(lower(text), '[a-z0-9]+') AS ct, regexp_extract_all(answer, '\d+(?:\.\d+)?') AS nums, len(regexp_extract_all(question, '[^\s\x0B]+')) AS qn, {v.GROUNDING_WORDS.format('answer')} AS aw, {v.GROUNDING_WORDS.format('text')} AS tw FROM a)
SELECT doc_id, coalesce(CASE WHEN trim(question) = '' OR trim(answer) = '' THEN 'empty' WHEN NOT ends_with(trim(question), '?') OR qn NOT BETWEEN 7 AND 40 THEN 'bad question shape' WHEN regexp_matches(question, '(?i)\b(this|the|that) (paper|passage|text|study|article|excerpt|section|authors?|work|document|context)\b|\b(above|following|given) (text|passage|table|figure|excerpt)\b|\baccording to (the|this)\b') THEN 'refers to the paper/text'
WHEN kind = 'text' AND regexp_matches(question, '(?i)\b(table|figure|fig\.)\s*\d+') THEN 'refers to a table/figure label' WHEN NOT regexp_matches(question, '\b[A-Z][a-z]*[A-Z0-9][A-Za-z0-9\-]*\b|\b[A-Z]{{2,}}|\d|\s[A-Z][a-z]{{3,}}') THEN 'generic question (names nothing specific)' WHEN {_SHARES.format(_FIVE.format('qt'), _FIVE.format('ct'))} THEN 'copies the passage'
WHEN kind = 'table' AND len(nums) > 0 AND len(list_filter(nums, lambda x: NOT contains(text, x))) > 0 THEN 'answer numbers not in the table' WHEN kind = 'table' AND len(nums) > 0 THEN NULL WHEN len(regexp_extract_all(answer, '[^\s\x0B]+')) < 3 THEN 'answer too short'
WHEN len(aw) = 0 OR len(list_filter(nums, lambda x: NOT contains(text, x))) > 0 OR len(list_intersect(aw, tw)) / len(aw) < 0.45 THEN 'answer not grounded in the passage' END, 'ok') AS reason FROM w""")
def question_filter(spark, sf):
    """Questions of every kind of fault, with the first reason that holds."""
    from docquarry.operators import claims as cl

    n, text = F.col("chunk_id"), F.col("text")
    first = F.array_join(F.slice(tx.all_of(text, "[a-z0-9]+"), 1, 9), " ")
    question = (
        F.when(n % 9 == 0, "").when(n % 9 == 1, "Too short?").when(n % 9 == 2, "How does this paper measure the ABC value of its own model?").when(n % 9 == 3, "What does Table 4 list as the ABC value of the model?")
        .when(n % 9 == 4, "what are the usual ways of doing such things at all today?").when(n % 9 == 5, F.concat(first, F.lit(" ABC?")))
        .otherwise(F.concat(F.lit("Which value of ABC-"), n.cast("string"), F.lit(" was found for the larger of both models?")))
    )
    answer = F.when(n % 4 == 0, "It is 12345").when(n % 4 == 1, "yes").when(n % 4 == 2, F.substr(text, F.lit(1), F.lit(200))).otherwise("nothing of this stands in it anywhere")
    rows = v.corpus(spark, sf).select(n.alias("doc_id"), "text", question.alias("question"), answer.alias("answer"), F.when(n % 2 == 0, "table").otherwise("text").alias("kind"))
    rows = rows.withColumn("qt", tx.tokens(F.col("question"))).withColumn("ct", tx.tokens(F.col("text")))
    graded = cl.grounded(rows.withColumnRenamed("text", "chunk").withColumn("text", F.col("answer")).withColumn("cited", F.array("chunk")))
    reason = au.question_reason(F.col("question"), F.col("answer"), F.col("kind"), au.shares_run(F.col("qt"), F.col("ct")), F.col("chunk"), F.col("grounding"))
    return graded.select("doc_id", F.coalesce(reason, F.lit("ok")).alias("reason"))


_ITEMS = """items AS (SELECT doc_id AS qid, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END AS type, CASE WHEN doc_id % 5 = 0 THEN 'quite unrelated wording' ELSE left(coalesce(text, ''), 80) END AS question,
CASE WHEN doc_id % 4 = 0 THEN 'value 77 in it' ELSE left(coalesce(text, ''), 60) END AS reference_answer, CASE WHEN doc_id % 8 = 0 THEN -1 ELSE doc_id END AS chunk_id, source AS document_id FROM documents),
chunks AS (SELECT doc_id AS chunk_id, source AS document_id, CASE WHEN doc_id % 40 < 20 AND doc_id % 2 = 0 THEN coalesce(text, '') || ' 77 ' || doc_id ELSE coalesce(text, '') END AS text FROM documents)"""
_JUDGE_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(au.JUDGE_STOP))) + "]"
_JUDGE_WORDS = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9\-]{{2,}}'), lambda w: NOT list_contains(" + _JUDGE_STOP + ", w)))"


@query(rf"""WITH {_ITEMS}, j AS (SELECT i.*, c.text AS source, regexp_extract_all(reference_answer, '\d+(?:\.\d+)?') AS nums FROM items i LEFT JOIN chunks c USING (chunk_id)),
am AS (SELECT qid, count(*) AS ambiguity FROM j JOIN chunks c USING (document_id) WHERE len(nums) > 0 AND c.chunk_id <> j.chunk_id AND len(list_filter(nums, lambda x: NOT contains(c.text, x))) = 0 GROUP BY 1),
w AS (SELECT j.*, coalesce(ambiguity, 0) AS ambiguity, {_JUDGE_WORDS.format('reference_answer')} AS rw, {_JUDGE_WORDS.format('question')} AS qw, {_JUDGE_WORDS.format("coalesce(source, '')")} AS sw FROM j LEFT JOIN am USING (qid)),
s AS (SELECT qid, source, ambiguity, CASE WHEN source IS NULL THEN 0 ELSE len(list_filter(nums, lambda x: NOT contains(source, x))) END AS missing, CASE WHEN source IS NULL THEN 0 WHEN len(rw) = 0 THEN 1 ELSE len(list_intersect(rw, sw)) / len(rw) END AS tg, CASE WHEN source IS NULL THEN 0 WHEN len(qw) = 0 THEN 1 ELSE len(list_intersect(qw, sw)) / len(qw) END AS qa FROM w),
k AS (SELECT *, (tg < 0.5)::INT + (qa < 0.4)::INT + (ambiguity > 0)::INT AS weak, source IS NULL OR missing > 0 AS broken FROM s)
SELECT qid, missing::BIGINT AS n_missing, round(tg, 3) AS term_grounding, round(qa, 3) AS question_answerable, ambiguity, CASE WHEN broken THEN 'broken' WHEN weak > 0 THEN 'suspect' ELSE 'ok' END AS verdict,
CASE WHEN source IS NULL THEN 1000.0 ELSE CASE WHEN broken THEN 100 WHEN weak > 0 THEN 10 ELSE 0 END + missing * 5 + weak + round((1 - tg) + (1 - qa), 2) END AS badness FROM k""")
def audit_verdict(spark, sf):
    """Labels held against their chunks; those that name no chunk of the index are looked for in a spare table, in vain."""
    n = F.col("chunk_id")
    docs = v.corpus(spark, sf).withColumnRenamed("source", "document_id")
    items = docs.select(n.alias("qid"), F.when(n % 3 == 0, "table").otherwise("text").alias("type"), F.when(n % 5 == 0, "quite unrelated wording").otherwise(F.substr("text", F.lit(1), F.lit(80))).alias("question"), F.when(n % 4 == 0, "value 77 in it").otherwise(F.substr("text", F.lit(1), F.lit(60))).alias("reference_answer"), F.when(n % 8 == 0, -1).otherwise(n).alias("chunk_id"), "document_id")
    chunks = docs.select("chunk_id", "document_id", F.when((n % 40 < 20) & (n % 2 == 0), F.concat("text", F.lit(" 77 "), n.cast("string"))).otherwise(F.col("text")).alias("text"))
    got = au.audited(items, chunks, spare=chunks.filter("chunk_id % 8 <> 0"))
    return got.select("qid", F.size("missing").alias("n_missing"), "term_grounding", "question_answerable", "ambiguity", "verdict", "badness")


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN true ELSE false END AS match, (n_nationkey * 10)::VARCHAR AS cell, n_nationkey % 3 = 1 AS transposed FROM nation""")
def cell_check(spark, sf):
    """Tables whose cell for a question is known: right answers, answers of the transposed cell, and others."""
    n = F.col("n_nationkey")
    table = F.concat(F.lit("| k | 1 | 2 |\n| --- | --- | --- |\n| 1 | 5 | "), (n * 10).cast("string"), F.lit(" |\n| 2 | "), (n * 10 + 7).cast("string"), F.lit(" | 8 |"))
    answer = F.when(n % 3 == 0, F.concat(F.lit("It is "), (n * 10).cast("string"))).when(n % 3 == 1, F.concat(F.lit("It is "), (n * 10 + 7).cast("string"))).otherwise("It is 99999")
    got = au.cell_check(F.lit("What is the value for k=1 and c=2?"), answer, table)
    return v.table(spark, sf, "nation").select("n_nationkey", got.alias("c")).select("n_nationkey", "c.*")


_REPLY = """CASE doc_id % 6 WHEN 0 THEN '{"verdict": "correct", "reason": "r' || doc_id || '"}' WHEN 1 THEN '```json' || chr(10) || '{"verdict": "wrong", "corrected_answer": "x", "reason": ""}' || chr(10) || '```' WHEN 2 THEN 'Sure: {"verdict": "correct"} done'
WHEN 3 THEN '{"verdict": "maybe"}' WHEN 4 THEN 'no json' ELSE '{"verdict": "wrong", "corrected_answer": "y' || doc_id || '"}' END"""


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' WHEN 2 THEN 'correct' WHEN 5 THEN 'wrong' ELSE 'unparsed' END AS verdict, CASE doc_id % 6 WHEN 1 THEN 'x' WHEN 5 THEN 'y' || doc_id ELSE '' END AS corrected, CASE WHEN doc_id % 6 = 0 THEN 'r' || doc_id ELSE '' END AS reason FROM documents""")
def judge_replies(spark, sf):
    """Replies in JSON, in fences, in other text, with odd verdicts, and none."""
    rows = v.table(spark, sf, "documents").select("doc_id", F.expr(_REPLY.replace("chr(10)", "char(10)")).alias("reply"))
    got = rows.select("doc_id", au.parsed_verdict(F.col("reply"), ["correct", "wrong"]).alias("p"))
    return got.select("doc_id", F.coalesce("p.verdict", F.lit("unparsed")).alias("verdict"), F.coalesce("p.corrected_answer", F.lit("")).alias("corrected"), F.coalesce("p.reason", F.lit("")).alias("reason"))


@query(r"""SELECT conv_id, turn, pos, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(t, '\[\d+(?:\s*[,–-]\s*\d+)*\]', '', 'g'), '(?i)(?:\*\*)?(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION)(?:\*\*)?\s*:?', '', 'g'), '**', ''), '[ \t]{2,}', ' ', 'g'), '\s+([.,;:])', '\1', 'g'), '^\s+|\s+$', '', 'g'), 'x', 'x')) AS text_md5, false AS empty
FROM (WITH """ + v.CLAIMS + r""" SELECT conv_id, turn, pos, '**LIMITATION**: ' || text || ' [1-3] , **so**  it  is [2] .' AS t FROM claims)""")
def judge_text(spark, sf):
    rows = v.cited_claims(spark, sf).withColumn("t", F.concat(F.lit("**LIMITATION**: "), "text", F.lit(" [1-3] , **so**  it  is [2] .")))
    return rows.select("conv_id", "turn", "pos", F.md5(au.judge_text(F.col("t"))).alias("text_md5"), au.is_empty(F.col("t")).alias("empty"))


_VALUES = """doc_id, (doc_id * 1000 + 234)::VARCHAR || ' ± 0.5' AS ref, CASE doc_id % 4 WHEN 0 THEN 'It is ' || regexp_replace((doc_id * 1000 + 234)::VARCHAR, '(\\d)(\\d\\d\\d)$', '\\1,\\2') || ' [1].' WHEN 1 THEN '(doc) 7' WHEN 2 THEN 'insufficient evidence' ELSE 'about ' || (doc_id * 1000 + 234) END AS answer"""


@query(f"""WITH a AS (SELECT {_VALUES} FROM documents) SELECT count(*) AS n, round(avg((doc_id % 4 IN (0, 3))::INT), 6) AS present, count(*) FILTER (contains(answer, 'insufficient evidence')) AS abstained FROM a""")
def value_questions(spark, sf):
    """Answers to questions for a value: how many have it, however written, and how many abstain."""
    n = F.col("doc_id")
    number = (n * 1000 + 234).cast("string")
    answer = F.when(n % 4 == 0, F.concat(F.lit("It is "), F.regexp_replace(number, r"(\d)(\d\d\d)$", "$1,$2"), F.lit(" [1]."))).when(n % 4 == 1, "(doc) 7").when(n % 4 == 2, "insufficient evidence").otherwise(F.concat(F.lit("about "), number))
    rows = v.table(spark, sf, "documents").select(F.concat(number, F.lit(" ± 0.5")).alias("ref"), answer.alias("answer"))
    rows = rows.filter(au.is_value(F.col("ref")))
    share = F.avg(F.when(au.value_present(F.col("ref"), F.col("answer")), 1.0).otherwise(0.0))
    return rows.agg(F.count("*").alias("n"), F.round(share, 6).alias("present"), F.sum(F.when(F.lower("answer").contains("insufficient evidence"), 1).otherwise(0)).alias("abstained"))


@query(rf"""WITH a AS (SELECT b.item_id, b.text || ' It is 12.5 and 7.' AS ref, coalesce(d.text, '') || CASE WHEN b.item_id % 2 = 0 THEN ' 12.5, 7' ELSE ' 12' END AS answer FROM benchmark b JOIN documents d ON d.doc_id = b.item_id), w AS (SELECT *, {_JUDGE_WORDS.format('ref')} AS rw, {_JUDGE_WORDS.format('answer')} AS aw FROM a)
SELECT item_id, item_id % 2 = 0 AS number_match, round(len(list_intersect(rw, aw)) / len(rw), 6) AS term_recall FROM w""")
def fast_scores(spark, sf):
    items = v.questions(spark, sf).select(F.col("query_id").alias("item_id"), F.concat("text", F.lit(" It is 12.5 and 7.")).alias("ref"))
    rows = items.join(v.corpus(spark, sf).select(F.col("chunk_id").alias("item_id"), F.concat("text", F.when(F.col("chunk_id") % 2 == 0, " 12.5, 7").otherwise(" 12")).alias("answer")), "item_id")
    got = rows.select("item_id", au.fast_score(F.col("answer"), F.col("ref")).alias("s")).select("item_id", "s.*")
    # other numbers of the text can make up for a 7: only texts without digits are asked
    return got.withColumn("term_recall", F.round("term_recall", 6)).withColumn("number_match", F.coalesce("number_match", F.lit(False)))


_NEUTRAL_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(au.NEUTRAL_STOP))) + "]"
_NEUTRAL = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains(" + _NEUTRAL_STOP + ", w)))"


@query(rf"""WITH {v.QUESTIONS}, {v.BM25}, best AS ({search._TOP.format('scored', 5)}), ctx AS (SELECT query_id, string_agg(c.text, chr(10) ORDER BY rank) AS context FROM best JOIN corpus c USING (chunk_id) GROUP BY 1),
r AS (SELECT *, text || CASE WHEN query_id % 2 = 0 THEN ' 31415' ELSE '' END AS ref FROM ctx JOIN questions USING (query_id)), s AS (SELECT *, {_NEUTRAL.format('ref')} AS rw, regexp_extract_all(lower(context), '[a-z0-9]+') AS ct FROM r),
g AS (SELECT coalesce(len(list_intersect(rw, ct)) / nullif(len(rw), 0), 1) AS answer_coverage, CASE WHEN len(regexp_extract_all(ref, '\d+\.?\d*')) > 0 THEN len(list_filter(regexp_extract_all(ref, '\d+\.?\d*'), lambda n: NOT regexp_matches(context, '\b' || regexp_escape(n) || '\b'))) = 0 END AS number_covered, len(regexp_extract_all(context, '[^\s\x0B]+')) AS context_tokens FROM s)
SELECT round(avg(answer_coverage), 4) AS answer_coverage, round(avg((answer_coverage >= 0.8)::INT), 4) AS answer_covered_at_80, round(avg(number_covered::INT), 4) AS number_coverage, count(number_covered) AS n_numbers, round(avg(context_tokens), 1) AS context_tokens FROM g""")
def granularity_summary(spark, sf):
    """How far the first five chunks cover the reference, whatever their size."""
    hits = _lexical(spark, sf, 5).join(v.corpus(spark, sf).select("chunk_id", "text"), "chunk_id")
    context = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))
    rows = context.join(v.questions(spark, sf), "query_id").withColumn("ref", F.concat("text", F.when(F.col("query_id") % 2 == 0, " 31415").otherwise("")))
    return au.neutral_summary(rows.select(au.neutral_score(F.col("context"), F.col("ref")).alias("s")).select("s.*"))


@query(r"""SELECT n_nationkey::BIGINT AS n_nationkey, n_nationkey % 2 = 0 AS accepted, CASE WHEN n_nationkey % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS n_invented FROM nation""")
def transcription_check(spark, sf):
    """Transcribed tables with and without a number that the page doesn't have."""
    n = F.col("n_nationkey")
    md = F.concat(F.lit("| a | b |\n| --- | --- |\n| 00"), (n + 10).cast("string"), F.lit(" | 1."), F.when(n % 2 == 0, "5").otherwise("77777"), F.lit(" |"))
    got = au.transcription(md, F.concat(F.lit("a b "), (n + 10).cast("string"), F.lit(" 1.5")))
    return v.table(spark, sf, "nation").select("n_nationkey", got["accepted"].alias("accepted"), F.size(got["invented"]).alias("n_invented"))


class _Echo:
    """A stand-in for a model: it says the first words of a prompt, is busy when first asked some, and fails at others."""

    name = "echo"

    def available(self) -> bool:
        return True

    def generate(self, prompt: str) -> tuple[str, int]:
        words = prompt.split()
        if len(words) % 5 == 0:
            raise ValueError("too round")
        if len(words) % 2 == 0 and prompt not in self.__dict__:
            self.__dict__[prompt] = True
            raise cs.Busy("later")
        return " ".join(words[:6]) + " ", min(len(words), 6)


@query(r"""WITH q AS (SELECT item_id, regexp_extract_all(text, '[^\s]+') AS w FROM benchmark)
SELECT item_id, CASE WHEN len(w) % 5 = 0 THEN 'none' ELSE array_to_string(w[1:6], ' ') END AS answer, CASE WHEN len(w) % 5 = 0 THEN 'fallback' ELSE 'echo' END AS model, CASE WHEN len(w) % 5 = 0 THEN 0 ELSE least(len(w), 6) END AS eval_count,
CASE WHEN len(w) % 2 = 0 AND len(w) % 5 <> 0 THEN 2 ELSE 1 END AS attempts, len(w) % 5 = 0 AS failed FROM q""")
def model_answers(spark, sf):
    """Prompts answered by a client in tasks: busy times, failures, a fallback and what it took."""
    rows = v.questions(spark, sf).select(F.col("query_id").alias("item_id"), F.col("text").alias("prompt"))
    got = cs.generated(rows, _Echo(), fallback=F.lit("none"), pause=0.0)
    return got.select("item_id", "answer", "model", "eval_count", "attempts", F.col("error").isNotNull().alias("failed"))


@query(rf"""WITH q AS (SELECT item_id, text, {v.GROUNDING_WORDS.format('text')} AS w FROM benchmark), e AS (SELECT item_id AS id, unnest(range(0, len(s))) AS i, unnest(s) AS sentence FROM (SELECT item_id, {v.SENTENCES.format("text")} AS s FROM benchmark)),
o AS (SELECT q.item_id, i, sentence, len(list_intersect(w, {v.GROUNDING_WORDS.format('sentence')})) AS n FROM q JOIN e ON e.id = q.item_id)
SELECT item_id, regexp_replace(sentence, '[.!?]+$', '') || ' [1].' AS answer FROM o QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, i) = 1""")
def extractive_answer(spark, sf):
    """The default generator on each passage as its own evidence."""
    rows = v.questions(spark, sf)
    return rows.select(F.col("query_id").alias("item_id"), aw.extractive(F.col("text"), F.create_map(F.lit(1), F.col("text"))).alias("answer"))
