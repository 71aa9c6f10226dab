"""States of documents held by a stream: one small state a document, timers for those that hang, and an end for those done."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docquarry.sources import storage
from docquarry.streaming import STATES

#: States in which nothing more is due.
DONE = ("indexed", "failed", "scanned_needs_ocr")
SCHEMA = "document_id string, status string, at timestamp, error string"
#: What the processor gives out; times are microseconds, which need no conversion by row.
GIVEN = "document_id string, status string, us long, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """A document's latest state: the latest change, and of simultaneous ones the furthest. What it gives out are the
    documents whose state has changed. A document that isn't done after `stuck` ms is failed; one that is done is
    forgotten after `keep` ms, so the store holds what is under way and what was done lately."""

    def __init__(self, stuck: int, keep: int):
        self.stuck, self.keep = stuck, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "status string, at long, rank int, due long")

    def _put(self, key: tuple, old: tuple | None, status: str, at: int, rank: int, error: str | None) -> Row:
        due = at // 1000 + (self.keep if status in DONE else self.stuck)
        if old is None or old[3] != due:
            if old is not None and old[3] is not None:
                self.handle.deleteTimer(old[3])
            self.handle.registerTimer(due)
        self.latest.update((status, at, rank, due))
        return Row(document_id=key[0], status=status, us=at, error=error)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # rows and not pandas: most documents have few changes, and a frame for each costs more than all the rest
        best = None
        for row in rows:
            if row.us is not None and row.rank is not None and (best is None or (row.us, row.rank) > best[:2]):
                best = (row.us, row.rank, row.status)
        if best is None:
            return
        old = self.latest.get()
        if old is None or best[:2] > (old[1], old[2]):
            yield self._put(key, old, best[2], best[0], best[1], None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.latest.get()
        if old is None:
            return
        status, at, rank, due = old
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return
        if status in DONE:
            self.latest.clear()
        else:
            # failed at the time when it was due: later changes still count; this timer is spent
            yield self._put(key, None, "failed", due * 1000, STATES.index("failed"), f"stuck in {status}")

    def close(self) -> None:
        pass


def follow(spark: SparkSession, source: str, schema, out: str, checkpoint: str, late: str = "1 day", stuck: int = 3_600_000, keep: int = 30 * 86_400_000, files: int = 4) -> None:
    """Follow the files of changes (document_id, status, at) that came since the last run, and write the documents whose
    state has changed (document_id, status, at, error), a folder for each batch, which a batch that is run again writes
    anew. Times are those of the changes; changes older than the latest one less `late` aren't looked at."""
    storage.ship(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status")) - 1
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    changes = changes.filter("document_id is not null").select(F.col("document_id").cast("string"), "status", "at", F.unix_micros("at").alias("us"), F.when(rank >= 0, rank).cast("int").alias("rank")).withWatermark("at", late)
    states = changes.groupBy("document_id").transformWithState(Lifecycle(stuck, keep), GIVEN, "Append", "EventTime")

    def put(batch: DataFrame, number: int) -> None:
        batch.select("document_id", "status", F.timestamp_micros("us").alias("at"), "error", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/part={number}")

    try:
        states.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last state that follow() wrote of each document."""
    rows = spark.read.schema(f"{SCHEMA}, batch long").parquet(out)
    last = F.max_by(F.struct("status", "at", "error"), F.struct("at", "batch")).alias("s")
    return rows.groupBy("document_id").agg(last).select("document_id", "s.status", "s.at", "s.error")
