"""A library of documents: files, catalogue, chunks and lexical index in one folder, changed together.

Each change is one version of sources.versions: what it writes is beside what was there, and becomes visible with a single
rename, so a reader's catalogue, chunks and index are always of the same documents and a writer that stops midway changes
nothing. Files and chunks are parts that are written once. A document that is put in again or deleted outdates its earlier
rows: `outdated` (document_id, before) says before which generation. When there are FAN_OUT parts they become one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.operators import catalogue as ca
from docquarry.operators import retrieval as rt
from docquarry.operators.index import FAN_OUT, LexicalIndex
from docquarry.sources import storage
from docquarry.sources.versions import Versions

CATALOGUE = "document_id string, title string, num_chunks long, status string, error_message string, uploaded_at long"
#: Documents of a change up to which their ids go to all tasks, so that texts aren't shuffled.
SENT = 500_000
#: Tables whose rows belong to a document each, and the columns they must have.
TABLES = {"files": "document_id string, name string, content binary", "chunks": "chunk_id string, document_id string, text string"}


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SENT else ids


class Library:
    """A library as one of its versions has it. Changes give the library of the next version."""

    def __init__(self, spark: SparkSession, path: str, k1: float = rt.K1, b: float = rt.B):
        self.spark, self.path = spark, path
        self.versions = Versions(spark, path)
        self.number, self.state = self.versions.latest()
        if not self.state:
            self.state = {"generation": 0, "catalogue": None, "outdated": [], **{t: [] for t in TABLES}, "index": LexicalIndex.nothing("string", k1, b)}

    # Reading ------------------------------------------------------------------------------------------------------------

    @property
    def catalogue(self) -> DataFrame:
        part = self.state["catalogue"]
        return self.spark.read.schema(CATALOGUE).parquet(part) if part else self.spark.createDataFrame([], CATALOGUE)

    def table(self, name: str) -> DataFrame:
        """Rows of a table that no later change has outdated."""
        return self._current(name).drop("generation")

    def _current(self, name: str) -> DataFrame:
        parts = self.state[name]
        if not parts:
            return self.spark.createDataFrame([], f"{TABLES[name]}, generation int")
        rows = self.spark.read.option("mergeSchema", True).parquet(*parts)
        if not self.state["outdated"]:
            return rows
        old = _sent(self.spark.read.parquet(*self.state["outdated"]).groupBy(F.col("document_id").alias("__id")).agg(F.max("before").alias("__before")))
        return rows.join(old, (F.col("document_id") == F.col("__id")) & (F.col("generation") < F.col("__before")), "left_anti")

    @property
    def index(self) -> LexicalIndex:
        return LexicalIndex(self.spark, self.path, self.state["index"], self.number)

    # Changes ------------------------------------------------------------------------------------------------------------

    def put(self, papers: DataFrame, chunks: DataFrame, files: DataFrame | None = None) -> Library:
        """Documents put in, or in place of those with their ids.

        papers: (document_id, title, filename, num_chunks, status, uploaded_at), each id once; a known document keeps the
        time of its first upload. chunks: (chunk_id, document_id, text, ...), of which those of papers that are indexed
        count. files: (document_id, name, content)."""
        papers = storage.written(papers)
        ready = _sent(papers.filter("status = 'indexed'").select("document_id"))
        state, generation = self._outdating(papers.select("document_id"))
        kept = {"chunks": chunks.join(ready, "document_id", "left_semi"), **({"files": files} if files is not None else {})}
        for name, rows in kept.items():
            state[name] = [*state[name], self._part(name, rows.withColumn("generation", F.lit(generation)))]
        state["catalogue"] = self._part("catalogue", ca.registered(papers, self.catalogue))
        gone = self.table("chunks").join(_sent(papers.select("document_id")), "document_id", "left_semi")
        # the index is made of what the library keeps
        state["index"] = self.index.changed(self.spark.read.parquet(state["chunks"][-1]).select("chunk_id", "text"), gone).state
        storage.dropped(papers)
        return self._committed(state)

    def delete(self, asked: DataFrame) -> tuple[Library, DataFrame]:
        """The documents of asked (document_id) gone from catalogue, files, chunks and index, and what became of each:
        `deleted`, or `not_found` where the catalogue doesn't have it."""
        known = self.catalogue.select("document_id", F.lit("deleted").alias("outcome"))
        outcome = storage.written(asked.select("document_id").distinct().join(known, "document_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_found"))))
        gone = outcome.filter("outcome = 'deleted'").select("document_id")
        if not gone.head(1):
            return self, outcome
        state, _ = self._outdating(gone)
        state["catalogue"] = self._part("catalogue", ca.delete(self.catalogue, gone, "document_id"))
        state["index"] = self.index.changed(gone=self.table("chunks").join(_sent(gone), "document_id", "left_semi")).state
        return self._committed(state), outcome

    def _part(self, name: str, rows: DataFrame) -> str:
        part = self.versions.new_part(name)
        rows.write.parquet(part)
        return part

    def _outdating(self, ids: DataFrame) -> tuple[dict, int]:
        """The next state, in which all rows of the documents so far are outdated."""
        generation = self.state["generation"] + 1
        state = {**self.state, "generation": generation}
        state["outdated"] = [*state["outdated"], self._part("outdated", ids.select("document_id", F.lit(generation).alias("before")))]
        return state, generation

    def _committed(self, state: dict) -> Library:
        out = Library(self.spark, self.path)
        out.number, out.state = self.number, state
        for name in TABLES:
            if len(state[name]) >= FAN_OUT:
                state[name] = [out._part(name, out._current(name))]
        if len(state["outdated"]) >= FAN_OUT:
            state["outdated"] = [out._part("outdated", self.spark.read.parquet(*state["outdated"]).groupBy("document_id").agg(F.max("before").alias("before")))]
        out.number = self.versions.commit(self.number, state)
        return out
