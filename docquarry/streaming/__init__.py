"""Resumable work as file streams: what was done is known from the checkpoint, and a restart goes on behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(spark: SparkSession, source: str, schema, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str, files: int = 4, at: str | None = None, within: str = "30 days") -> None:
    """Process the files that came since the last run in batches of a few files and append the results.

    A key that came before, in this run or an earlier one, is left out: the stream's state knows them, so a batch costs
    what is in it, whatever was done before. With `at`, a column of times, a key is known for `within` after its time and
    then forgotten, so the state has a bound; rows that are later than that are left out. A batch has a folder of its own
    below `out`, which a batch that is run again after a failure writes anew."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream = stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key]) if at else stream.dropDuplicates([key])
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def index_new(spark: SparkSession, source: str, schema, index_path: str, checkpoint: str, files: int = 4) -> None:
    """Put the chunks (chunk_id, text) of files that came since the last run into the index at index_path, which is
    there. A chunk that came before is replaced; of one that a batch has twice, one counts. A batch costs what is in it,
    and one that is run again after a failure isn't put in again."""
    from docquarry.operators.index import LexicalIndex

    def put(batch: DataFrame, number: int) -> None:
        chunks = batch.select("chunk_id", "text")
        if chunks.groupBy("chunk_id").count().filter("count > 1").head(1):  # ids alone are looked at; texts move only if they must
            chunks = chunks.dropDuplicates(["chunk_id"])
        else:
            chunks = spread(chunks, "chunk_id")
        LexicalIndex.load(spark, index_path).append(chunks, number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of files dealt to all tasks by a key, if few tasks would have them: large parts of files aren't cut by a scan."""
    busy = rows.select(F.spark_partition_id().alias("task")).distinct().count()  # no column is read
    return rows.repartition(key) if busy < rows.sparkSession.sparkContext.defaultParallelism else rows


def micro_batches(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """rows with `batch`, from 0: so many rows each, in order of the columns `by`."""
    from docquarry.operators.order import placed

    return placed(rows, *by).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


#: Document states, in the order in which one replaces another at the same time.
STATES = ["uploaded", "parsing", "indexing", "scanned_needs_ocr", "failed", "indexed"]


def latest_states(changes: DataFrame) -> DataFrame:
    """(document_id, status, at) from changes (document_id, status, at): the latest, and of simultaneous ones the
    furthest."""
    far = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    last = F.max(F.struct("at", far.alias("far"), "status")).alias("s")
    return changes.groupBy("document_id").agg(last).select("document_id", "s.status", "s.at")


def worked(documents: DataFrame, fault, work_status: str = "indexed") -> DataFrame:
    """(document_id, status, error) after work on uploaded documents: a fault (a Column, null without one) makes a
    document failed, no matter how the others fare; one without a text layer needs OCR."""
    status = F.when(fault.isNotNull(), "failed").when(F.col("scanned"), "scanned_needs_ocr").otherwise(work_status)
    return documents.select("document_id", status.alias("status"), F.when(fault.isNotNull(), fault).alias("error"))
