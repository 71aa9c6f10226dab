"""Every query of the engine by name, and the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import documents, retrieval
from docquarry.plans import answering, chunking, quality_sets, reports, routes, scoring, search, storage, views

_PLANS = (search, scoring, quality_sets, reports, answering, storage, chunking, routes)


def flagship(spark, sf_dir):
    """Documents packed into chunks of sentences, the ten best of each benchmark passage by BM25."""
    docs = views.corpus(spark, sf_dir).select(F.col("chunk_id").alias("document_id"), "text")
    packed = documents.chunks(docs).select(F.concat_ws("_c", "document_id", "chunk_no").alias("chunk_id"), "text")
    return retrieval.bm25(packed, views.questions(spark, sf_dir), 10)


def _plain(f):
    """Integer columns as long, as SQL has them."""

    def run(spark, sf_dir):
        # a union of tables dealt alike is taken for dealt by that key itself, also where their tasks were merged differently
        # as they ran: joined or grouped by that key, it fails or repeats rows
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        df = f(spark, sf_dir)
        return df.select(*(F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes))

    return run


def queries() -> dict:
    return {name: _plain(f) for plan in _PLANS for name, f in plan.RUN.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
