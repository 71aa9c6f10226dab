"""The engine's tables as views of the driver's, in Spark and as SQL text with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def lexical(spark: SparkSession, sf_dir: str) -> index.LexicalIndex:
    """The kept index of all documents."""
    return index.kept(spark, f"{sf_dir}/documents.parquet", corpus(spark, sf_dir).select("chunk_id", "text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of searches: every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance is to have the query's label: (query_id, label, num_relevant)."""
    counts = vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("num_relevant"))
    return vector_queries(spark, sf_dir).select("query_id", F.col("query_label").alias("label")).join(counts, "label")


def with_hits(ranked: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows with hit and num_relevant: labels are compared on the rows that were found."""
    own = vectors(spark, sf_dir).select("chunk_id", F.col("label").alias("chunk_label"))
    return ranked.join(label_counts(spark, sf_dir), "query_id").join(own, "chunk_id").withColumn("hit", F.when(F.col("label") == F.col("chunk_label"), 1).otherwise(0)).drop("label", "chunk_label")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def cited_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of assistants' turns as claims; all but every fourth cite a block from 1 to 5."""
    said = turns(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    n = F.col("conv_id") + F.col("turn") + F.col("pos")
    return said.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.when(n % 4 == 0, F.col("sentence")).otherwise(F.concat("sentence", F.lit(" ["), (1 + n % 5).cast("string"), F.lit("]"))).alias("text"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation that aren't the assistant's as its numbered evidence."""
    rows = turns(spark, sf_dir).filter("role <> 'assistant'")
    return rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("citation_id"), "text")


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim's status for each document: its labels, or not verified."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    q, t = F.col("quality"), F.col("toxic")
    status = F.when(q.isNull() | t.isNull(), "NOT_VERIFIED").when((q == 1) & (t == 0), "SUPPORTED").when((q == 0) & (t == 0), "PARTIALLY_SUPPORTED").when((q == 1) & (t == 1), "UNSUPPORTED").otherwise("CONTRADICTED")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", "lang", status.alias("status"))


# The same in SQL ----------------------------------------------------------------------------------------------------

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(trim({0}), '([.!?])\s+([A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
STOP_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({*tx.STOP_WORDS, *tx.REPORTING_WORDS})) + "]"
STEM = (
    "CASE WHEN {0} LIKE '%ing' AND length({0}) >= 7 THEN left({0}, length({0}) - 3) WHEN {0} LIKE '%ed' AND length({0}) >= 6 THEN left({0}, length({0}) - 2) "
    "WHEN {0} LIKE '%es' AND length({0}) >= 6 THEN left({0}, length({0}) - 2) WHEN {0} LIKE '%s' AND length({0}) >= 5 THEN left({0}, length({0}) - 1) ELSE {0} END"
)
GROUNDING_WORDS = r"list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9\-]{{3,}}'), lambda w: NOT list_contains(" + STOP_LIST + ", w)), lambda w: " + STEM.format("w") + "))"

CORPUS = "corpus AS (SELECT doc_id AS chunk_id, coalesce(text, '') AS text, lang, source FROM documents)"
BM25 = f"""{CORPUS},
toks AS (SELECT chunk_id, unnest({TOKENS.format('text')}) AS token FROM corpus),
lens AS (SELECT chunk_id, count(*) AS dl FROM toks GROUP BY 1),
post AS (SELECT token, chunk_id, count(*) AS tf FROM toks GROUP BY 1, 2),
stats AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT count(*) FROM toks) / (SELECT count(*) FROM corpus) AS avgdl),
raws AS (SELECT token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stats GROUP BY 1),
terms AS (SELECT token, df, CASE WHEN raw >= 0 THEN raw ELSE (SELECT 0.25 * avg(raw) FROM raws) END AS idf FROM raws),
asked AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS token FROM questions) GROUP BY 1, 2),
scored AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN post USING (token) JOIN terms USING (token) JOIN lens USING (chunk_id), stats GROUP BY 1, 2)"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"
DENSE = """vecs AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label FROM embeddings),
vq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS query_label FROM embeddings WHERE vec_id % 20 = 0),
dots AS (SELECT query_id, chunk_id, label, query_label, round(list_dot_product(e, q), 6) AS score FROM vecs, vq),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dots)"""
CLAIMS = f"""said AS (SELECT conv_id, turn, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT conv_id, turn, {SENTENCES.format("coalesce(text, '')")} AS s FROM conversations WHERE role = 'assistant')),
claims AS (SELECT conv_id, turn, pos, CASE WHEN (conv_id + turn + pos) % 4 = 0 THEN sentence ELSE sentence || ' [' || (1 + (conv_id + turn + pos) % 5) || ']' END AS text FROM said),
evidence AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS citation_id, coalesce(text, '') AS text FROM conversations WHERE role <> 'assistant')"""
STATUSES = """statuses AS (SELECT d.doc_id, d.source, d.lang, CASE WHEN quality IS NULL OR toxic IS NULL THEN 'NOT_VERIFIED' WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED'
  WHEN quality = 0 AND toxic = 0 THEN 'PARTIALLY_SUPPORTED' WHEN quality = 1 AND toxic = 1 THEN 'UNSUPPORTED' ELSE 'CONTRADICTED' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))"""
DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
