"""Queries of evaluation, claims and grounding, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import claims as cl
from docquarry.operators import evaluation as ev
from docquarry.operators import order as od
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


_METRICS = ["recall_at_1", "recall_at_3", "recall_at_5", "recall_at_10", "hit_at_1", "hit_at_3", "hit_at_5", "hit_at_10", "mrr", "ndcg_at_10"]
_PER_QUERY = f"""{v.DENSE}, hits AS (SELECT query_id, query_label, rank, (label = query_label)::INT AS hit FROM near WHERE rank <= 20),
rel AS (SELECT query_label, count(*) AS r FROM (SELECT label AS query_label FROM vecs) GROUP BY 1),
raw AS (SELECT query_id, query_label, any_value(r) AS r, {', '.join(f'sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS h{k}' for k in (1, 3, 5, 10))}, min(CASE WHEN hit = 1 THEN rank END) AS f,
  sum(CASE WHEN hit = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(hit) AS found FROM hits JOIN rel USING (query_label) GROUP BY 1, 2),
metrics AS (SELECT query_id, query_label, {', '.join(f'round(h{k} / r, 6) AS recall_at_{k}' for k in (1, 3, 5, 10))}, {', '.join(f'least(h{k}, 1)::DOUBLE AS hit_at_{k}' for k in (1, 3, 5, 10))}, round(coalesce(1 / f, 0), 6) AS mrr,
  round(CASE WHEN found > 0 THEN dcg / list_sum(list_transform(range(1, least(found, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_at_10 FROM raw)"""


def _vector_metrics(spark, sf):
    ranked = rt.dense(v.vectors(spark, sf), v.vector_queries(spark, sf), 20)
    return ev.per_query(v.with_hits(ranked, spark, sf))


@query(f"WITH {_PER_QUERY} SELECT query_id, {', '.join(_METRICS)} FROM metrics")
def retrieval_metrics(spark, sf):
    return _vector_metrics(spark, sf).select("query_id", *_METRICS)


@query(f"WITH {_PER_QUERY} SELECT count(*) AS num_queries, {', '.join(f'round(avg({m}), 6) AS {m}' for m in _METRICS)} FROM metrics")
def retrieval_summary(spark, sf):
    return ev.summary(_vector_metrics(spark, sf), _METRICS)


@query(f"""WITH {_PER_QUERY}, m AS (SELECT median(query_id) AS mid FROM metrics), s AS (SELECT *, CASE WHEN query_id <= mid THEN 'hard' ELSE 'easy' END AS half FROM metrics, m)
SELECT coalesce(query_label::VARCHAR, 'all') AS kind, coalesce(half, 'all') AS half, count(*) AS n, round(avg(hit_at_5), 6) AS hit_at_5, round(avg(mrr), 6) AS mrr FROM s GROUP BY GROUPING SETS ((), (query_label), (half), (query_label, half))""")
def retrieval_slices(spark, sf):
    """Slices by kind and half, alone and together; up to the median is the hard half."""
    got = _vector_metrics(spark, sf).join(v.vector_queries(spark, sf).select("query_id", F.col("query_label").cast("string").alias("kind")), "query_id")
    mid = got.agg(F.median("query_id").alias("mid"))
    got = got.crossJoin(F.broadcast(mid)).withColumn("half", F.when(F.col("query_id") <= F.col("mid"), "hard").otherwise("easy"))
    return got.cube("kind", "half").agg(F.count("*").alias("n"), F.round(F.avg("hit_at_5"), 6).alias("hit_at_5"), F.round(F.avg("mrr"), 6).alias("mrr")).withColumns({"kind": F.coalesce("kind", F.lit("all")), "half": F.coalesce("half", F.lit("all"))})


def _boot(values: str, n: int, low: int, high: int) -> str:
    return f"""units AS (SELECT row_number() OVER (ORDER BY unit) - 1 AS place, v FROM {values}), size AS (SELECT count(*) AS n, avg(v) AS mean FROM units),
draws AS (SELECT r.range AS resample, {v.DRAW.format("r.range::VARCHAR || '|' || j.range::VARCHAR")} % n AS place FROM range({n}) r, size, range(1000000) j WHERE j.range < n),
means AS (SELECT resample, round(avg(v), 9) AS m FROM draws JOIN units USING (place) GROUP BY 1)
SELECT n, round(mean, 6) AS mean, round(list_sort(list(m))[{low + 1}], 6) AS ci_low, round(list_sort(list(m))[{high + 1}], 6) AS ci_high FROM means, size GROUP BY n, mean"""


@query(f"WITH {_PER_QUERY}, vals AS (SELECT query_id AS unit, mrr AS v FROM metrics), {_boot('vals', 1000, 25, 974)}")
def bootstrap_ci(spark, sf):
    rows = _vector_metrics(spark, sf).select(F.col("query_id").alias("unit"), "mrr")
    return ev.bootstrap(rows, "mrr", 1000, 25, 974)


@query(f"WITH {_PER_QUERY}, vals AS (SELECT query_id AS unit, recall_at_10 - recall_at_5 AS v FROM metrics WHERE recall_at_10 IS NOT NULL AND recall_at_5 IS NOT NULL), {_boot('vals', 2000, 50, 1949)}")
def paired_bootstrap(spark, sf):
    """Differences of two arms over the questions that both have."""
    got = _vector_metrics(spark, sf)
    arms = got.select("query_id", F.col("recall_at_5").alias("x")).join(got.select("query_id", F.col("recall_at_10").alias("y")), "query_id")
    rows = arms.filter("x is not null and y is not null").select(F.col("query_id").alias("unit"), (F.col("y") - F.col("x")).alias("d"))
    return ev.bootstrap(rows, "d", 2000, 50, 1949)


@query(f"""WITH {_PER_QUERY}, vals AS (SELECT recall_at_5 AS x, recall_at_10 AS y FROM metrics)
SELECT count(*) AS n, sum((y > x)::INT)::BIGINT AS improved, sum((y < x)::INT)::BIGINT AS worse, sum((y = x)::INT)::BIGINT AS same FROM vals""")
def paired_counts(spark, sf):
    got = _vector_metrics(spark, sf)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    x, y = F.col("recall_at_5"), F.col("recall_at_10")
    return got.agg(F.count("*").alias("n"), count(y > x).alias("improved"), count(y < x).alias("worse"), count(y == x).alias("same"))


def _nearby(vectors, queries, k):
    """(query_id, chunk_id, score): the k ids on either side of a query's own. Ids are dealt into the blocks of their
    order (operators.order), and a query sees its own block and those beside it."""
    placed = od.placed(vectors.select("chunk_id"), "chunk_id")
    spot = placed.withColumn("cell", F.floor(F.col("place") / k))
    own = queries.select("query_id").join(spot.withColumnRenamed("chunk_id", "query_id"), "query_id")
    around = own.select("query_id", F.explode(F.array(*(F.col("cell") + i for i in (-1, 0, 1)))).alias("cell"))
    return around.join(spot.select("chunk_id", "cell"), "cell").select("query_id", "chunk_id", F.lit(0.0).alias("score"))


@query(f"""WITH {v.DENSE}, alt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(chunk_id - query_id), chunk_id) AS rank2 FROM dots),
both_lists AS (SELECT query_id, chunk_id, label, query_label, rank AS r, 0 AS l FROM near WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, label, query_label, rank2, 1 FROM alt WHERE rank2 <= 20),
grid AS (SELECT w, k FROM (VALUES (0.5::DOUBLE), (0.7), (0.9)) a(w), (VALUES (10), (60)) b(k)),
fused AS (SELECT w, k, query_id, chunk_id, label = query_label AS hit, round(sum(CASE WHEN l = 0 THEN w ELSE 1 - w END / (k + r)), 9) AS s FROM both_lists, grid GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY w, k, query_id ORDER BY s DESC, chunk_id) AS rank FROM fused),
q AS (SELECT w, k, query_id, max(CASE WHEN rank <= 5 THEN hit::INT ELSE 0 END) AS h, coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN rank END), 0) AS rr FROM ranked WHERE rank <= 20 GROUP BY ALL),
m AS (SELECT w, k, round(avg(h), 6) AS hit_at_5, round(avg(rr), 6) AS mrr FROM q GROUP BY ALL)
SELECT w, k::BIGINT AS k, hit_at_5, mrr, row_number() OVER (ORDER BY hit_at_5 DESC, mrr DESC, w, k) AS place FROM m""")
def sweep_grid(spark, sf):
    """Fusion weights and constants over a grid: the settings in order of hit rate, then reciprocal rank."""
    near = rt.dense(v.vectors(spark, sf), v.vector_queries(spark, sf), 20)
    close = rt.top(_nearby(v.vectors(spark, sf), v.vector_queries(spark, sf), 20), 20, F.abs(F.col("chunk_id") - F.col("query_id")), F.col("chunk_id"))
    lists = near.select("query_id", "chunk_id", "rank", F.lit(0).alias("l")).unionByName(close.select("query_id", "chunk_id", "rank", F.lit(1).alias("l")))
    grid = spark.createDataFrame([(w, k) for w in (0.5, 0.7, 0.9) for k in (10, 60)], "w double, k long")
    weight = F.when(F.col("l") == 0, F.col("w")).otherwise(1 - F.col("w"))
    fused = lists.crossJoin(F.broadcast(grid)).groupBy("w", "k", "query_id", "chunk_id").agg(F.round(F.sum(weight / (F.col("k") + F.col("rank"))), 9).alias("s"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("w", "k", "query_id").orderBy(F.desc("s"), "chunk_id"))).filter("rank <= 20")
    ranked = v.with_hits(ranked, spark, sf)
    q = ranked.groupBy("w", "k", "query_id").agg(F.max(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("h"), F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"))
    m = q.groupBy("w", "k").agg(F.round(F.avg("h"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hit_at_5"), F.desc("mrr"), "w", "k")))


@query(rf"WITH {v.CLAIMS} SELECT conv_id, turn, pos, coalesce(list_transform(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda x: x::INT)[1]::BIGINT, 0) AS first_id, len(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1))::BIGINT AS n FROM claims")
def citation_ids(spark, sf):
    ids = tx.citation_ids(F.col("text"))
    return v.cited_claims(spark, sf).select("conv_id", "turn", "pos", F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit(0)).alias("first_id"), F.size(ids).alias("n"))


def _answers(spark, sf):
    """Assistants' turns with the markers of their sentences, and the ids of their evidence."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    said = v.cited_claims(spark, sf).groupBy("conv_id", "turn").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("answer"))
    blocks = v.evidence(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list("citation_id")).alias("evidence_ids"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("citation_id", "text")))).alias("evidence"))
    return said.join(blocks, "conv_id")


@query()
def claim_extract(spark, sf):
    answers = _answers(spark, sf).select(F.struct("conv_id", "turn").alias("answer_id"), "answer", "evidence_ids")
    got = cl.claims(answers)
    return got.select("answer_id.conv_id", "answer_id.turn", "claim_no", "text", F.size("citation_ids").alias("n_ids"))


def _cited_rows(spark, sf):
    claims = v.cited_claims(spark, sf).withColumn("ids", tx.citation_ids(F.col("text")))
    blocks = v.evidence(spark, sf).withColumnRenamed("text", "block")
    each = claims.select("conv_id", "turn", "pos", F.posexplode("ids").alias("at", "citation_id")).join(blocks, ["conv_id", "citation_id"])
    lists = each.groupBy("conv_id", "turn", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda s: s["block"]).alias("cited"))
    return claims.join(lists, ["conv_id", "turn", "pos"], "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))


_GROUNDED = f"""{v.CLAIMS}, bare AS (SELECT *, regexp_replace(regexp_replace(text, '\\[\\d+(?:\\s*,\\s*\\d+)*\\]', '', 'g'), '(?i)^\\s*(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION)\\s*:\\s*', '') AS b,
  regexp_extract(text, '\\[(\\d+)\\]', 1) AS cid FROM claims),
j AS (SELECT bare.*, evidence.text AS block FROM bare LEFT JOIN evidence ON evidence.conv_id = bare.conv_id AND evidence.citation_id = try_cast(cid AS BIGINT)),
w AS (SELECT *, {v.GROUNDING_WORDS.format('b')} AS cw, {v.GROUNDING_WORDS.format("coalesce(block, '')")} AS ew,
  list_filter(regexp_extract_all(b, '\\d+(?:\\.\\d+)?'), lambda n: NOT contains(coalesce(block, ''), n)) AS missing FROM j),
o AS (SELECT conv_id, turn, pos, block IS NOT NULL AS cited, CASE WHEN block IS NULL OR len(cw) = 0 THEN 0 ELSE len(list_intersect(cw, ew)) / len(cw) END AS overlap, CASE WHEN block IS NULL OR len(cw) = 0 THEN 0 ELSE len(missing) END AS n_missing FROM w),
grounding AS (SELECT conv_id, turn, pos, round(overlap, 6) AS overlap, CASE WHEN NOT cited OR n_missing > 0 THEN 'none' WHEN overlap >= 0.7 THEN 'strong' WHEN overlap >= 0.45 THEN 'weak' ELSE 'none' END AS grounding FROM o)"""


@query(f"WITH {_GROUNDED} SELECT * FROM grounding")
def grounding(spark, sf):
    got = cl.grounded(_cited_rows(spark, sf))
    return got.select("conv_id", "turn", "pos", F.round("overlap", 6).alias("overlap"), "grounding")


_STATUS_CLAIMS = f"""{v.CLAIMS}, {v.STATUSES}, joined AS (SELECT c.*, s.status, CASE WHEN regexp_matches(c.text, '\\[\\d+\\]') THEN 1 ELSE 0 END AS n_ids
  FROM claims c JOIN statuses s ON s.doc_id = (c.conv_id * 31 + c.turn * 7 + c.pos) % (SELECT count(*) FROM documents)),
per AS (SELECT conv_id, count(*) AS total_claims, sum(n_ids)::BIGINT AS total_citations, count(*) FILTER (n_ids > 0) AS cited, count(*) FILTER (status <> 'NOT_VERIFIED') AS verified_claims,
  count(*) FILTER (status <> 'NOT_VERIFIED' AND n_ids > 0) AS vc, count(*) FILTER (status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') AND n_ids > 0) AS good, count(*) FILTER (status = 'SUPPORTED') AS sup,
  count(*) FILTER (status IN ('UNSUPPORTED', 'CONTRADICTED')) AS flagged_claims FROM joined GROUP BY GROUPING SETS ((conv_id), ())),
cm AS (SELECT conv_id, total_claims, verified_claims, flagged_claims, total_citations, round(cited / total_claims, 6) AS coverage,
  CASE WHEN verified_claims = 0 THEN NULL WHEN vc = 0 THEN 0 ELSE round(good / vc, 6) END AS "precision", CASE WHEN verified_claims = 0 THEN NULL ELSE round(sup / verified_claims, 6) END AS faithfulness,
  CASE WHEN verified_claims = 0 THEN NULL ELSE round(flagged_claims / verified_claims, 6) END AS unsupported_rate FROM per)"""


def _status_claims(spark, sf):
    claims = v.cited_claims(spark, sf)
    docs = v.statuses(spark, sf)
    n = docs.agg(F.count("*").alias("n_docs"))
    keyed = claims.crossJoin(F.broadcast(n)).withColumn("doc_id", F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("pos"), F.col("n_docs")))
    return keyed.join(docs, "doc_id").withColumn("citation_ids", tx.citation_ids(F.col("text")))


@query(f"WITH {_STATUS_CLAIMS} SELECT * FROM cm WHERE conv_id IS NOT NULL")
def citation_metrics(spark, sf):
    return ev.citation_metrics(_status_claims(spark, sf), "conv_id")


@query(f"WITH {_STATUS_CLAIMS} SELECT * EXCLUDE (conv_id) FROM cm WHERE conv_id IS NULL")
def metrics_pooled(spark, sf):
    return ev.citation_metrics(_status_claims(spark, sf))


@query(f"""WITH {_STATUS_CLAIMS} SELECT round(avg(coverage), 6) AS coverage, round(avg("precision"), 6) AS "precision", round(avg(faithfulness), 6) AS faithfulness, round(avg(unsupported_rate), 6) AS unsupported_rate,
sum(total_claims)::BIGINT AS total_claims, sum(verified_claims)::BIGINT AS verified_claims FROM cm WHERE conv_id IS NOT NULL""")
def metrics_mean(spark, sf):
    got = ev.citation_metrics(_status_claims(spark, sf), "conv_id")
    return got.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("coverage", "precision", "faithfulness", "unsupported_rate")), F.sum("total_claims").alias("total_claims"), F.sum("verified_claims").alias("verified_claims"))


_SAID = "CASE doc_id % 5 WHEN 0 THEN 'Status: ' || lower(status) || chr(10) || 'RATIONALE: text of ' || doc_id WHEN 1 THEN 'I think it is ' || lower(status) || '.' WHEN 2 THEN 'not supported at all' WHEN 3 THEN 'no idea' ELSE 'STATUS:' || status END"


@query(rf"""WITH {v.STATUSES}, r AS (SELECT doc_id, {_SAID} AS response FROM statuses), x AS (SELECT *, upper(regexp_extract(response, '(?i)STATUS:\s*(SUPPORTED|PARTIALLY_SUPPORTED|UNSUPPORTED|CONTRADICTED)', 1)) AS s FROM r)
SELECT doc_id, CASE WHEN s <> '' THEN s WHEN contains(upper(response), 'PARTIALLY_SUPPORTED') THEN 'PARTIALLY_SUPPORTED' WHEN contains(upper(response), 'CONTRADICTED') THEN 'CONTRADICTED' WHEN contains(upper(response), 'UNSUPPORTED') THEN 'UNSUPPORTED'
  WHEN contains(upper(response), 'SUPPORTED') THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM x""")
def verdict_parse(spark, sf):
    rows = v.statuses(spark, sf).withColumn("response", F.expr(_SAID))
    return rows.select("doc_id", cl.verdict(F.col("response")).alias("verdict"))


_CALIBRATION = f"""{_GROUNDED}, {v.STATUSES}, cal AS (SELECT g.*, s.status FROM grounding g JOIN statuses s ON s.doc_id = (g.conv_id * 31 + g.turn * 7 + g.pos) % (SELECT count(*) FROM documents) WHERE status <> 'NOT_VERIFIED')"""


def _calibration(spark, sf):
    status = _status_claims(spark, sf).select("conv_id", "turn", "pos", "status").filter("status <> 'NOT_VERIFIED'")
    return grounding(spark, sf).join(status, ["conv_id", "turn", "pos"])


_RATES = """round((tp + tn) / greatest(tp + fp + fn + tn, 1), 6) AS accuracy, round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 6) AS balanced_accuracy,
round(tp / greatest(tp + fp, 1), 6) AS "precision", round(tp / greatest(tp + fn, 1), 6) AS recall"""


def _counts(predicted: str, truth: str) -> str:
    return f"count(*) FILTER (({predicted}) AND ({truth})) AS tp, count(*) FILTER (({predicted}) AND NOT ({truth})) AS fp, count(*) FILTER (NOT ({predicted}) AND ({truth})) AS fn, count(*) FILTER (NOT ({predicted}) AND NOT ({truth})) AS tn"


@query(f"WITH {_CALIBRATION}, c AS (SELECT {_counts(chr(39).join(['grounding = ', 'none', '']), 'status NOT IN (' + repr('SUPPORTED') + ', ' + repr('PARTIALLY_SUPPORTED') + ')')} FROM cal) SELECT tp, fp, fn, tn, {_RATES} FROM c")
def confusion(spark, sf):
    """Flagged claims against bad ones."""
    return ev.confusion(_calibration(spark, sf), F.col("grounding") == "none", ~F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED"))


_GRID_RATES = "(tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2"


@query(f"""WITH {_CALIBRATION}, ids AS (SELECT conv_id, (row_number() OVER (ORDER BY conv_id) - 1) % 2 AS half FROM (SELECT DISTINCT conv_id FROM cal)),
grid AS (SELECT s / 10 AS strong, w / 10 AS weak FROM range(5, 10) a(s), range(2, 7) b(w) WHERE w < s),
c AS (SELECT strong, weak, {_counts("overlap >= strong", "status = 'SUPPORTED'")} FROM cal JOIN ids USING (conv_id), grid WHERE half = 0 GROUP BY ALL),
m AS (SELECT strong, weak, tp, fp, fn, tn, round({_GRID_RATES}, 6) AS balanced_accuracy FROM c)
SELECT *, row_number() OVER (ORDER BY balanced_accuracy DESC, strong, weak) AS place FROM m""")
def threshold_grid(spark, sf):
    """Thresholds over a grid on the even half of the conversations, best first; ties in the grid's order."""
    rows = _calibration(spark, sf)
    ids = od.placed(rows.select("conv_id").distinct(), "conv_id").withColumn("half", F.col("place") % 2)
    grid = spark.createDataFrame([(s / 10, w / 10) for s in range(5, 10) for w in range(2, 7) if w < s], "strong double, weak double")
    rows = rows.join(ids.filter("half = 0"), "conv_id").crossJoin(F.broadcast(grid))
    m = ev.confusion(rows, F.col("overlap") >= F.col("strong"), F.col("status") == "SUPPORTED", "strong", "weak").select("strong", "weak", "tp", "fp", "fn", "tn", "balanced_accuracy")
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("balanced_accuracy"), "strong", "weak")))


@query(f"""WITH {_CALIBRATION}, a AS (SELECT conv_id, turn, avg((grounding = 'none')::INT) AS x, avg((status NOT IN ('SUPPORTED', 'PARTIALLY_SUPPORTED'))::INT) AS y FROM cal GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(abs(x - y)), 6) AS mae, round(avg(x), 6) AS predicted, round(avg(y), 6) AS actual FROM a""")
def answer_mae(spark, sf):
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = _calibration(spark, sf).groupBy("conv_id", "turn").agg(one(F.col("grounding") == "none").alias("x"), one(~F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED")).alias("y"))
    return a.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mae"), F.round(F.avg("x"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("actual"))


@query("""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS n FROM embeddings),
nb AS (SELECT a.vec_id, list_dot_product(a.e, b.e) AS pos, list_dot_product(a.e, c.e) AS neg FROM p a JOIN p b ON b.rn = (a.rn + 10) % a.n JOIN p c ON c.rn = (a.rn + 7) % a.n)
SELECT count(*) AS n, round(avg(pos), 3) AS mean_pos, round(avg(neg), 3) AS mean_neg, round(round(avg(pos), 3) - round(avg(neg), 3), 3) AS gap, round(avg(pos), 3) - round(avg(neg), 3) >= 0.4 AS separates,
round(count(*) FILTER (pos > neg) / greatest(1, count(*)), 6) AS ranked_share FROM nb""")
def judge_controls(spark, sf):
    """Each vector against one further on by ten (right) and by seven (wrong): whether the scores separate."""
    rows = v.vectors(spark, sf).select("chunk_id", "embedding")
    n = rows.agg(F.count("*").alias("n"))
    p = od.placed(rows, "chunk_id").withColumnRenamed("place", "rn").crossJoin(F.broadcast(n))  # one row
    at = lambda k, name: p.select(F.pmod(F.col("rn") - k, F.col("n")).alias("rn"), F.col("embedding").alias(name))
    dot = lambda name: F.aggregate(F.zip_with("embedding", name, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    got = p.join(at(10, "right"), "rn").join(at(7, "wrong"), "rn").select(dot("right").alias("pos"), dot("wrong").alias("neg"))
    a, b = F.round(F.avg("pos"), 3), F.round(F.avg("neg"), 3)
    return got.agg(F.count("*").alias("n"), a.alias("mean_pos"), b.alias("mean_neg"), F.round(a - b, 3).alias("gap"), (a - b >= 0.4).alias("separates"), F.round(F.sum(F.when(F.col("pos") > F.col("neg"), 1).otherwise(0)) / F.greatest(F.lit(1), F.count("*")), 6).alias("ranked_share"))


@query("""SELECT event_type AS mode, count(*) AS n, round(median(value), 6) AS median_ms, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1""")
def latency_by_mode(spark, sf):
    rows = v.table(spark, sf, "events").select(F.col("event_type").alias("mode"), "value")
    median = od.quantiles(rows, "mode", "value", 0.5).select(F.col("mode").alias("m"), F.round("quantile", 6).alias("median_ms"))
    means = rows.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"))
    return means.join(median, F.col("mode").eqNullSafe(F.col("m")), "left").drop("m")


@query(f"""WITH {v.STATUSES} SELECT coalesce(lang, 'all') AS lang, coalesce(status, 'all') AS status, count(*) AS n FROM statuses GROUP BY CUBE (lang, status)""")
def status_pivot(spark, sf):
    got = v.statuses(spark, sf).cube("lang", "status").agg(F.count("*").alias("n"))
    return got.withColumns({"lang": F.coalesce("lang", F.lit("all")), "status": F.coalesce("status", F.lit("all"))})
