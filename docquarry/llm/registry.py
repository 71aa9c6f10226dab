"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, cross_entropy, fingerprints, language_id, multi_index, near_duplicates, packing, periodic_runs, quality, runtime, substrings, surrogates, token_files, vector_codes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Surrogates are drawn with this key; a deployment sets its own secret.
SURROGATE_KEY = "docquarry"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(_docs(spark, sf_dir).select("doc_id", "text"), SURROGATE_KEY, count="n_entities")


def op2_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_docs(spark, sf_dir).select("doc_id", "text", "lang"), keep_text=False).drop("lang")


def op3_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.groups(_docs(spark, sf_dir), near_duplicates.Settings(shingle=2))


def op4_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(_docs(spark, sf_dir).select("doc_id", "text"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_docs(spark, sf_dir).select("doc_id", "text"), digest=True).drop("text")


def op8_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, keep_ids=False).drop("ids")


def op9_simple8b_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runtime.shared_folder(spark)
    token_files.write_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, out)
    return token_files.read_tokens(spark, out).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as of high quality and not toxic."""
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return cross_entropy.score(docs, good)


def op10_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.is_held_out(F.col("doc_id")))
    filters = language_id.learn(docs.filter("not held_out"))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), filters).drop("text")


def _periodic_tails(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of the id, goes on from some word as a repetition of the words there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    mine = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    mine = mine.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("g", F.floor(F.col("h") / 10))
    tail = mine.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    tail = tail.withColumn("left", F.col("n") - F.col("a")).withColumn("p", (1 + F.floor(F.col("left") / (3 + F.col("g") % 8))).cast("int"))
    again = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(F.col("left") / F.col("p")).cast("int"))), F.lit(1), F.col("left"))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return tail.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapsed(_periodic_tails(_docs(spark, sf_dir)))
    best = F.try_element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")), F.lit(1))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    top = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return top.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return multi_index.MultiIndex.build(vecs).search(vecs.filter("vec_id % 50 = 0"), 5)


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = vector_codes.prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = vector_codes.learn(points)
    coded = vector_codes.with_label_errors(vector_codes.encode(points, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def queries() -> dict:
    found = (op1_surrogates, op2_perplexity_bands, op3_tensored_minhash, op4_scaled_sketches, op5_prefix_bpe, op6_cross_entropy, op7_cover_anchors, op8_online_packing, op9_simple8b_files, op10_language_filters)
    return {f.__name__: f for f in (*found, op11_periodic_runs, op12_multi_index, op13_annular_codes)}


OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN w ELSE [] END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (n + m - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(node, root) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT e.b, r.root FROM reached r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b
), least_root AS (SELECT node, min(root) AS root FROM reached GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.root AS component_id, s.doc_id = r.root AS kept
FROM sets s JOIN least_root r ON r.node = s.doc_id
"""


OP7 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20)
), repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, p + o AS q FROM repeats, range(0, 20) t(o)
), gone_of AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(coalesce(g.qs, []))::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN g.qs IS NULL THEN w.w ELSE list_transform(list_filter(range(1, len(w.w) + 1), lambda i: NOT list_contains(g.qs, i)), lambda i: w.w[i]) END, ' ')) AS kept_sha256
FROM words w LEFT JOIN gone_of g ON g.doc_id = w.doc_id
"""


_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_BYTE = "xor(c, ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1)))"
OP11 = rf"""
WITH hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(range(8 * length(doc_id::VARCHAR)), lambda c, k: CASE WHEN k % 8 = 0 THEN {_STEP.format('(' + _BYTE + ')')} ELSE {_STEP.format('c')} END, 4294967295), 4294967295) AS h
  FROM documents
), cut AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM hashed
), given AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut
), edited AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM given
), items AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM edited
), same AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i AS i FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), stretches AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM same) GROUP BY doc_id, q, grp
), runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t, arg_max({{'s': s, 'len': len, 'q': q}}, len * 1000000000000 - s * 1000000 - q) AS best FROM runs GROUP BY doc_id
), gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + len)) AS i FROM runs) GROUP BY doc_id
), kept AS (
  SELECT items.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM items LEFT JOIN (SELECT doc_id, unnest(gone) AS i, 1 AS x FROM gone) USING (doc_id, i) WHERE x IS NULL GROUP BY items.doc_id)
SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.len // best.q)::BIGINT AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM edited e LEFT JOIN listed l ON l.doc_id = e.doc_id LEFT JOIN kept k ON k.doc_id = e.doc_id
"""


def _op13() -> str:
    counted = "isfinite(x) AND abs(x) < 1048576"
    steps = [f"""rows0 AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND {counted})), true)),
parts AS (SELECT vec_id, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS v FROM rows0, range(16) t(p)),
book0 AS (SELECT p, (dense_rank() OVER (ORDER BY vec_id)) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM rows0 ORDER BY vec_id LIMIT 64))"""]
    near = "near{0} AS (SELECT vec_id, p, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d FROM (SELECT a.vec_id, a.p, b.e, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::BIGINT AS d FROM parts a JOIN book{0} b ON a.p = b.p) GROUP BY vec_id, p)"
    for r in range(2):
        steps.append(near.format(r))
        steps.append(f"""sums{r} AS (SELECT p, e, i, sum(x) AS total, count(*) AS n FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM near{r} JOIN parts USING (vec_id, p)) GROUP BY p, e, i),
moved{r} AS (SELECT p, e, list(floor(total / n)::BIGINT ORDER BY i) AS v FROM sums{r} GROUP BY p, e),
book{r + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN moved{r} m ON m.p = b.p AND m.e = b.e)""")
    steps.append(near.format(2))
    steps.append("""coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)""")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN rows0 USING (vec_id), digest"


def oracle_sql() -> dict[str, str]:
    return {"op3_tensored_minhash": OP3, "op7_cover_anchors": OP7, "op11_periodic_runs": OP11, "op13_annular_codes": _op13()}
