"""The document catalogue and index tables: upserts, deletes and resumable work as joins of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """table with the rows of changes put in by key; columns in `keep` stay as the table has them for known keys.

    Of changes that share a key the last counts: the one of the largest `order` and, among equals or without it, of the
    largest values of its columns."""
    last = [*([F.desc(order)] if order else []), *(F.desc(c) for c in table.columns)]
    changes = changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*last))).filter("__n = 1").drop("__n")
    known = table.select(key, *(F.col(c).alias(f"__{c}") for c in keep))
    new = changes.join(known, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in keep else c for c in table.columns))
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(new)


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted keys."""
    return {name: delete(table, gone, key) for name, table in tables.items()}


def registered(papers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue rows of processed papers: the title falls back to the file and the id, scanned ones get an error text,
    and known papers keep uploaded_at."""
    rows = papers.select(
        "document_id",
        F.coalesce(F.nullif("title", F.lit("")), F.nullif("filename", F.lit("")), "document_id").alias("title"),
        "num_chunks",
        "status",
        F.when(F.col("status") == "scanned_needs_ocr", "Scanned PDF (no extractable text layer); OCR not yet supported.").alias("error_message"),
        "uploaded_at",
    )
    return upsert(catalogue, rows, "document_id", keep=("uploaded_at",))


def remaining(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key; of several of one order the one of the largest values."""
    ties = [F.desc(c) for c in log.columns if c not in (key, order)]
    return log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), *ties))).filter("__n = 1").drop("__n")


def first_known(rows: DataFrame, order: str, first: list[str], last: list[str]) -> DataFrame:
    """One row: of some columns the first value that isn't null, of others the last, in an explicit order."""
    pick = lambda c, f: f(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return rows.agg(*(pick(c, F.min) for c in first), *(pick(c, F.max) for c in last))


#: The catalogue's columns with their defaults.
CATALOGUE = "document_id STRING, title STRING DEFAULT 'Untitled', num_chunks BIGINT DEFAULT 0, status STRING DEFAULT 'uploaded', error_message STRING DEFAULT NULL"


def create_catalogue(spark, name: str, location: str) -> None:
    """A table of that name at a location, unless there is one."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({CATALOGUE}) USING parquet LOCATION '{location}'")


def one_document(catalogue: DataFrame, document_id) -> DataFrame:
    """The document's row, or none."""
    return catalogue.filter(F.col("document_id") == document_id)


def listed(catalogue: DataFrame) -> DataFrame:
    """All documents, the latest first; ties by id."""
    return catalogue.orderBy(F.desc("uploaded_at"), "document_id")


def delete_known(tables: dict[str, DataFrame], catalogue: str, asked: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows of the asked keys, and what becomes of each key: `deleted`, or `not_found` where the
    catalogue doesn't have it."""
    known = tables[catalogue].select(key, F.lit("deleted").alias("outcome")).distinct()
    outcome = asked.select(key).distinct().join(known, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_found")))
    return cascade(tables, outcome.filter("outcome = 'deleted'"), key), outcome


def published(index_path: str, papers: DataFrame, catalogue: DataFrame, spark) -> DataFrame:
    """The catalogue with the papers registered, once their index is written whole; before that, as it is."""
    from docquarry.operators.index import LexicalIndex

    return registered(papers, catalogue) if LexicalIndex.load(spark, index_path) is not None else catalogue
