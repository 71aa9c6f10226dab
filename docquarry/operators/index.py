"""Kept indexes: built once from chunks, added to, cut down, loaded and searched.

A lexical index is made of segments that are written once. Each has its chunks dealt into blocks, and

* `docs` (chunk_id, block, nth, dl, words), in order of chunk_id: where a chunk is, and what it counted for, its tokens
  with a space between them;
* `blocks` (block, ids, dls): the chunks of a block, by their number in it;
* `postings` (token, block, n, most, short, spots, tfs), in order of token: of a block the chunks that have the token,
  how many there are, the largest tf and the shortest of them, which bound what the token can add to a score there.
  `spots` are their numbers in the block, of two bytes each, `tfs` of as few bytes as the largest needs;
* `terms` (token, df).

What an append costs is what is in it: its own segment, which is written first, and taking out the chunks it has anew,
which are looked up by id alone. Taking out writes where the chunks were (`dead`) and what to take off the statistics, for
which the words of those that are there are read; numbers of chunks and tokens are sums over segments. When
FAN_OUT segments are of about one size they become one of the next, so each row is written again log times. Versions of
sources.versions name the parts: readers see a segment and its statistics at once or not at all.

A search reads the postings of the tokens that are asked for, which the scan is told, and deals them by block. A task
scores block after block, all queries at once, and skips a block for a query if the bounds of its tokens there add up to
less than the k-th best score the task has seen; the k best of each query and task are ranked together. No chunk that
could be among them is left out.

A vector index is a table of vectors with what belongs to them, so that no row depends on the place of another."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquarry.functions import text as tx
from docquarry.llm import runtime
from docquarry.operators import retrieval as rt
from docquarry.sources import storage
from docquarry.sources.versions import Versions

#: Chunks in a block (a power of two, of two bytes), and blocks that a generation may number.
BLOCK, GENERATION = 4096, 1 << 40
#: Tokens that a task sorts at once.
SORTED = 1_000_000
#: Bytes of a row group of postings, the least that a search reads.
ROW_GROUP = 8 << 20
#: Values that a scan is given to look for; beyond, tables are joined.
PUSHED = 4000
#: (query, token) pairs that go to all tasks of a search together; more are searched for in turns.
ASKED = 200_000
#: Chunks taken out up to which their places go to all tasks, so that the words of the others aren't shuffled.
SENT = 500_000
#: Rows whose postings a search unpacks at once.
UNPACKED = 256
#: Segments of about one size that become one.
FAN_OUT = 6


def _gathered(rows: pa.Table) -> pa.RecordBatch:
    """Postings rows of the chunks (block, nth, dl, words) of a task's step."""
    words = pc.split_pattern(rows.column("words").combine_chunks(), " ")
    sizes = np.asarray(words.value_lengths().fill_null(0))
    codes = words.flatten().dictionary_encode()
    tokens, codes = codes.dictionary, codes.indices.to_numpy()
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    block, nth, dl = (rows.column(c).to_numpy() for c in ("block", "nth", "dl"))
    kinds, blocks = np.unique(block, return_inverse=True)
    # a number says token and chunk at once; a block's chunks stand together, so it keeps blocks together as well
    both = np.sort(codes.astype(np.int64) * max(len(sizes), 1) + chunk)
    heads = _heads(both)
    tf = np.diff(np.append(heads, len(both)))
    codes, chunk = np.divmod(both[heads], max(len(sizes), 1))
    of = blocks[chunk]
    heads = _heads(codes * max(len(kinds), 1) + of)
    ends = np.append(heads, len(codes))
    reduced = (lambda f, x: f.reduceat(x, heads) if len(heads) else x[:0])
    most = reduced(np.maximum, tf)
    wide = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    columns = [tokens.take(pa.array(codes[heads])), pa.array(kinds[of[heads]]), pa.array(np.diff(ends).astype(np.int32)), pa.array(most.astype(np.int32)), pa.array(reduced(np.minimum, dl[chunk]).astype(np.int32))]
    columns += [_packed(nth[chunk], np.full(len(heads), 2), ends), _packed(tf, wide, ends)]
    return pa.RecordBatch.from_arrays(columns, names=["token", "block", "n", "most", "short", "spots", "tfs"])


def _heads(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.flatnonzero(new)


def _packed(values: np.ndarray, wide: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of values, of which ends has the bounds, as bytes: of each value the lowest `wide` of its run."""
    bytes_of = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    kept = np.arange(4) < np.repeat(wide, np.diff(ends))[:, None]
    offsets = np.append(0, np.cumsum(wide * np.diff(ends))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_of[kept].tobytes())])


def _unpacked(batch: pa.RecordBatch):
    """Slices of a batch of a search's rows with the lists `places` and `tfs` of postings instead of their bytes."""
    for at in range(0, len(batch), UNPACKED):
        part = batch.slice(at, UNPACKED)
        (spots, there), (tfs, upto) = runtime.utf8(part.column("spots")), runtime.utf8(part.column("tfs"))
        offsets = there // 2
        n = np.diff(offsets)
        wide = np.diff(upto) // np.maximum(n, 1)
        values = np.zeros((int(offsets[-1]), 4), np.uint8)
        values[np.arange(4) < np.repeat(wide, n)[:, None]] = tfs
        lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.astype(np.int32)))  # noqa: E731, B023
        made = {"places": pc.coalesce(part.column("places"), lists(spots.view("<u2"))), "tfs": lists(values.view("<u4").ravel())}
        yield pa.RecordBatch.from_pydict({c: made.get(c, part.column(c)) for c in part.schema.names if c != "spots"})


_POSTINGS = "token string, block long, n int, most int, short int, spots binary, tfs binary"


class LexicalIndex:
    """A BM25 index in a folder, as one of its versions has it."""

    def __init__(self, spark: SparkSession, path: str, state: dict | None = None, number: int = 0):
        storage.ship(spark)
        self.spark, self.path = spark, path
        self.versions = Versions(spark, path)
        self.number, self.state = (number, state) if state is not None else self.versions.latest()
        self._floor: float | None = None

    @classmethod
    def build(cls, chunks: DataFrame, path: str, k1: float = rt.K1, b: float = rt.B) -> LexicalIndex:
        """chunks: (chunk_id, text), each id once. Without rows the index is empty and finds nothing. What the folder had
        is no longer part of it."""
        index = cls(chunks.sparkSession, path)
        index.state = cls.nothing(chunks.schema["chunk_id"].dataType.simpleString(), k1, b, index.state.get("generation", 0))
        return index._added(chunks)._committed()

    @staticmethod
    def nothing(id_type: str, k1: float = rt.K1, b: float = rt.B, generation: int = 0) -> dict:
        """The state of an index without chunks."""
        return {"segments": [], "deletes": [], "generation": generation, "batch": None, "k1": float(k1), "b": float(b), "id": id_type}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex | None:
        """The last version of the index in a folder, with the weights it was built with; None where there is none."""
        index = cls(spark, path)
        return index if index.state else None

    # Changes ------------------------------------------------------------------------------------------------------------

    def append(self, chunks: DataFrame, batch: int | None = None) -> LexicalIndex:
        """The index with these chunks (chunk_id, text), each id once; a chunk whose id is known replaces the old one.

        batch: their number in a stream; one that is in already, or comes before one that is, is passed over."""
        if batch is not None and self.state["batch"] is not None and batch <= self.state["batch"]:
            return self
        out = self.changed(chunks)
        out.state["batch"] = batch if batch is not None else self.state["batch"]
        return out._committed()

    def changed(self, chunks: DataFrame | None = None, gone: DataFrame | None = None) -> LexicalIndex:
        """The index without the chunks of gone (chunk_id) and then with others, not yet visible to readers: its state is
        for the caller to commit, with what belongs to it. chunks are computed once."""
        out = self._copy()
        if gone is not None:
            out._without(gone.select("chunk_id").distinct())
        return (out._added(chunks, known=True) if chunks is not None else out)._merged()

    def removed(self, gone: DataFrame) -> LexicalIndex:
        """The index without the chunks of gone (chunk_id): neither found nor counted. Unknown ids change nothing."""
        return self.changed(gone=gone)._committed()

    def without(self, gone: DataFrame, path: str) -> LexicalIndex:
        """A new index at `path` without the chunks of gone (chunk_id). It shares the segments of this one."""
        out = LexicalIndex(self.spark, path)
        out.state = self._copy().state
        return out._without(gone.select("chunk_id").distinct())._committed()

    def _copy(self, **changes) -> LexicalIndex:
        return LexicalIndex(self.spark, self.path, {**self.state, "segments": list(self.state["segments"]), "deletes": list(self.state["deletes"]), **changes}, self.number)

    def _committed(self) -> LexicalIndex:
        self.number = self.versions.commit(self.number, self.state)
        self._floor = None
        return self

    def _added(self, chunks: DataFrame, known: bool = False) -> LexicalIndex:
        """Add a segment. known: its chunks may be there already, and replace those."""
        part, generation = self.versions.new_part("segments"), self.state["generation"] + 1
        # texts are put in order, and then cut: their tokens as an array are several times as large, and were spilled
        ordered = chunks.select("chunk_id", "text").sortWithinPartitions("chunk_id")
        words = ordered.select("chunk_id", tx.token_line(F.coalesce("text", F.lit(""))).alias("words"))
        dl = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
        at = F.monotonically_increasing_id()
        block = F.lit(generation * GENERATION) + F.shiftright(at, int(math.log2(BLOCK)))
        docs = words.select("chunk_id", block.alias("block"), (at % BLOCK).cast("int").alias("nth"), dl.alias("dl"), "words")
        docs.write.option("parquet.bloom.filter.enabled#chunk_id", "true").parquet(f"{part}/docs")
        docs = self.spark.read.schema(docs.schema).parquet(f"{part}/docs")
        members = F.array_sort(F.collect_list(F.struct("nth", "chunk_id", "dl")))
        blocks = docs.groupBy("block").agg(members.alias("m")).select("block", F.col("m.chunk_id").alias("ids"), F.col("m.dl").alias("dls"))
        blocks.write.parquet(f"{part}/blocks")

        def gather(batches):
            held, size, tokens = [], 0, 0
            for batch in batches:
                upto, at = np.cumsum(batch.column("dl").to_numpy(), dtype=np.int64), 0
                while at < len(batch):
                    before = upto[at - 1] if at else 0
                    to = max(at + 1, min(at + BLOCK - size, int(np.searchsorted(upto, before + SORTED - tokens, "right"))))
                    held.append(batch.slice(at, to - at))
                    size, tokens, at = size + to - at, tokens + int(upto[to - 1] - before), to
                    if size >= BLOCK or tokens >= SORTED or at < len(batch):
                        yield _gathered(pa.Table.from_batches(held))
                        held, size, tokens = [], 0, 0
            if held:
                yield _gathered(pa.Table.from_batches(held))

        rows = storage.written(docs.filter("dl > 0").select("block", "nth", "dl", "words").mapInArrow(runtime.relieved(gather), _POSTINGS))
        self._sorted(rows, part)
        storage.dropped(rows)
        n = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        self.state["generation"] = generation
        if known and n["n"]:
            self._without(docs.select("chunk_id"))
        if n["n"]:
            self.state["segments"].append({"part": part, "generations": [generation], "n": n["n"], "tokens": n["tokens"]})
        return self

    def _sorted(self, rows: DataFrame, part: str) -> None:
        """Write postings, which are read twice, in order of token, and their sums."""
        rows.repartitionByRange("token", "block").sortWithinPartitions("token", "block").write.option("parquet.block.size", ROW_GROUP).parquet(f"{part}/postings")
        # in order, a token's rows are together, and hardly more than its sum is shuffled
        self.spark.read.schema(_POSTINGS).parquet(f"{part}/postings").groupBy("token").agg(F.sum("n").alias("df")).write.parquet(f"{part}/terms")

    def _without(self, ids: DataFrame) -> LexicalIndex:
        """Take distinct ids out: where they were goes to `dead`, what they counted for is taken off."""
        docs = self._table("docs")
        if docs is None:
            return self
        few = [r["chunk_id"] for r in ids.limit(PUSHED + 1).collect()]
        # where chunks are is found without their words, and the words read of those that are there
        some = docs.filter(F.col("chunk_id").isin(few)) if len(few) <= PUSHED else docs
        where = some.select("chunk_id", "block", "nth", "dl")
        hit = self._alive(where if len(few) <= PUSHED else where.join(ids, "chunk_id", "left_semi"))
        hit = storage.written(hit.select("block", "nth", "dl"))
        n = hit.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        if n["n"]:
            part = self.versions.new_part("deletes")
            hit.groupBy("block").agg(F.collect_list("nth").alias("places")).write.parquet(f"{part}/dead")
            held = F.broadcast(hit.select("block", "nth")) if n["n"] <= SENT else hit.select("block", "nth")
            words = some.filter("dl > 0").join(held, ["block", "nth"], "left_semi")
            words.select(F.explode(F.array_distinct(F.split("words", " "))).alias("token")).groupBy("token").agg((-F.count("*")).alias("df")).write.parquet(f"{part}/terms")
            self.state["deletes"].append({"part": part, "n": -n["n"], "tokens": -n["tokens"]})
        storage.dropped(hit)
        return self

    def _merged(self) -> LexicalIndex:
        """Make FAN_OUT segments of about one size one, and so with deletes. Blocks keep their numbers."""
        segments, deletes = self.state["segments"], self.state["deletes"]
        while True:
            by_size: dict[int, list[dict]] = {}
            for s in segments:
                by_size.setdefault(int(math.log(max(s["n"], 1), FAN_OUT)), []).append(s)
            some = next((s for _, s in sorted(by_size.items()) if len(s) >= FAN_OUT), None)
            if some is None:
                break
            part = self.versions.new_part("segments")
            tables = {n: self._table(n, some) for n in ("docs", "blocks", "postings")}
            tables["docs"].repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.option("parquet.bloom.filter.enabled#chunk_id", "true").parquet(f"{part}/docs")
            tables["blocks"].write.parquet(f"{part}/blocks")
            self._sorted(tables["postings"], part)
            segments = [s for s in segments if s not in some] + [{"part": part, "generations": sorted(g for s in some for g in s["generations"]), "n": sum(s["n"] for s in some), "tokens": sum(s["tokens"] for s in some)}]
        if len(deletes) >= FAN_OUT:
            part = self.versions.new_part("deletes")
            self._table("dead", deletes).groupBy("block").agg(F.flatten(F.collect_list("places")).alias("places")).write.parquet(f"{part}/dead")
            self._table("terms", deletes).groupBy("token").agg(F.sum("df").alias("df")).write.parquet(f"{part}/terms")
            deletes = [{"part": part, "n": sum(d["n"] for d in deletes), "tokens": sum(d["tokens"] for d in deletes)}]
        self.state.update(segments=segments, deletes=deletes)
        return self

    # Tables -------------------------------------------------------------------------------------------------------------

    def _table(self, name: str, parts: list[dict] | None = None) -> DataFrame | None:
        parts = (self.state["deletes"] if name == "dead" else self.state["segments"]) if parts is None else parts
        return self.spark.read.parquet(*(f"{p['part']}/{name}" for p in parts)) if parts else None

    def _alive(self, docs: DataFrame) -> DataFrame:
        """Rows (block, nth, ...) of chunks that weren't taken out."""
        dead = self._table("dead")
        return docs if dead is None else docs.join(dead.select("block", F.explode("places").alias("nth")), ["block", "nth"], "left_anti")

    @property
    def size(self) -> int:
        """How many chunks are there."""
        return sum(x["n"] for x in (*self.state["segments"], *self.state["deletes"]))

    @property
    def average(self) -> float:
        """Mean number of tokens of a chunk."""
        return sum(x["tokens"] for x in (*self.state["segments"], *self.state["deletes"])) / max(self.size, 1)

    @property
    def terms(self) -> DataFrame:
        """(token, df, idf) of all chunks that are there."""
        parts = [*self.state["segments"], *self.state["deletes"]]
        if not parts:
            return self.spark.createDataFrame([], "token string, df long, idf double")
        rows = self._table("terms", parts)
        if len(parts) > 1:
            rows = rows.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")
        return rt.floored(rows.select("token", F.col("df").cast("long").alias("df")), F.lit(float(self.size)))

    @property
    def chunk_ids(self) -> DataFrame:
        docs = self._table("docs")
        return self.spark.createDataFrame([], f"chunk_id {self.state['id']}") if docs is None else self._alive(docs).select("chunk_id")

    # Search -------------------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
        """The k best chunks of each query (query_id, text) by BM25: (query_id, chunk_id, score, rank). `allowed`
        (chunk_id) restricts results, not the statistics. pad: where fewer have a positive score, chunks without a common
        token follow with 0, in order of id, before negative scores."""
        k1, b, average = self.state["k1"], self.state["b"], self.average

        def weight(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / average))

        asked = rt.query_tokens(queries)
        return self._best(queries, asked.select("query_id", "token", F.col("qf").cast("double").alias("w")), k, weight, True, allowed, pad)

    def shared(self, queries: DataFrame, k: int) -> DataFrame:
        """The k chunks with most distinct tokens in common with each query, as search() gives them."""
        return self._best(queries, rt.query_tokens(queries).select("query_id", "token", F.lit(1.0).alias("w")), k, lambda tf, dl: np.ones(len(tf)), False)

    def _best(self, queries: DataFrame, asked: DataFrame, k: int, weight, by_idf: bool, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
        schema = T.StructType([queries.schema["query_id"], T.StructField("chunk_id", T._parse_datatype_string(self.state["id"])), T.StructField("score", T.DoubleType())])
        if not self.state["segments"] or k <= 0:
            return self.spark.createDataFrame([], schema).withColumn("rank", F.lit(1))
        # every query takes part, as a padded one needs no token
        wanted = queries.select("query_id").distinct().join(asked, "query_id", "left")
        turns = max(1, -(-wanted.count() // ASKED))
        found = None
        for turn in range(turns):
            mine = wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).collect()
            part = self._scored(mine, k, weight, by_idf, allowed, pad, schema)
            found = part if found is None else found.unionByName(part)
        return rt.top(found.withColumn("score", F.round("score", 6)), k)

    def _scored(self, asked: list, k: int, weight, by_idf: bool, allowed: DataFrame | None, pad: bool, schema: T.StructType) -> DataFrame:
        tokens = sorted({r["token"] for r in asked if r["token"] is not None})
        # as a text, since each value of isin() is a call of its own; tokens have letters and digits alone
        one_of = "token IN ({})".format(", ".join(f"'{t}'" for t in tokens)) if 0 < len(tokens) <= PUSHED else None
        held = self.spark.createDataFrame([(t,) for t in tokens], "token string")
        pick = lambda df: df.filter(one_of) if one_of else df.join(held, "token", "left_semi")
        idf = {r["token"]: r["idf"] for r in pick(self.terms).collect()} if by_idf else dict.fromkeys(tokens, 1.0)
        number = {t: i for i, t in enumerate(tokens)}
        queries: dict = {}
        for r in asked:
            own = queries.setdefault(r["query_id"], {})
            if r["token"] in idf:
                own[number[r["token"]]] = r["w"] * idf[r["token"]]
        ids, wants = list(queries), [sorted(w.items()) for w in queries.values()]

        empty = {"token": "string", "ids": f"array<{self.state['id']}>", "dls": "array<int>", "most": "int", "short": "int", "places": "array<int>", "spots": "binary", "tfs": "binary"}

        def row(df: DataFrame, kind: int) -> DataFrame:
            return df.select("block", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in empty.items()))

        stream = row(self._table("blocks"), 0).unionByName(row(pick(self._table("postings")), 3))
        if (dead := self._table("dead")) is not None:
            stream = stream.unionByName(row(dead, 1))
        if allowed is not None:
            there = self._table("docs").join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
            stream = stream.unionByName(row(there.groupBy("block").agg(F.collect_list("nth").alias("places")), 2))
        restricted, arrow = allowed is not None, to_arrow_schema(schema)

        def best(batches):
            ranking = Ranking(wants, k, weight, pad, restricted)
            for batch in batches:
                for part in _unpacked(batch):
                    ranking.take(part, number)
            ranking.finish()
            for i, rows in enumerate(ranking.best):
                if rows:
                    columns = [[ids[i]] * len(rows), [r[1] for r in rows], [-r[0] for r in rows]]
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns, strict=True)), schema=arrow)

        return stream.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(runtime.relieved(best), schema)


class Ranking:
    """The k best chunks of each query, of the blocks a task sees one after another."""

    def __init__(self, wants: list[list[tuple[int, float]]], k: int, weight, pad: bool, restricted: bool):
        self.wants, self.k, self.weight, self.pad, self.restricted = wants, k, weight, pad, restricted
        self.best: list[list[tuple]] = [[] for _ in wants]  # (less the score, id), in order
        self.block, self.alive, self.skipped, self.scored = None, None, 0, 0

    def take(self, batch: pa.RecordBatch, number: dict[str, int]) -> None:
        column = {n: batch.column(n) for n in batch.schema.names}
        blocks, kinds = column["block"].to_numpy(), column["kind"].to_numpy()
        most, short = (column[c].fill_null(0).to_numpy().astype(np.float64) for c in ("most", "short"))
        bounds, tokens = self.weight(most, short), column["token"].to_pylist()
        for i in range(len(batch)):
            if blocks[i] != self.block:
                self.finish()
                self.block, self.posts = blocks[i], {}
                self.ids, self.dls = [], np.empty(0)
                self.alive = None
            values = lambda name: column[name][i].values.to_numpy()  # noqa: E731, B023
            if kinds[i] == 0:
                self.ids, self.dls = column["ids"][i], values("dls").astype(np.float64)
                self.alive = np.ones(len(self.dls), bool)
                self.let = np.zeros(len(self.dls), bool)
            elif kinds[i] == 1:
                self.alive[values("places")] = False
            elif kinds[i] == 2:
                self.let[values("places")] = True
            else:
                self.posts.setdefault(number[tokens[i]], []).append((values("places"), values("tfs"), bounds[i]))

    def finish(self) -> None:
        """Rank the block that was taken."""
        if self.block is None or self.alive is None:
            return
        alive = self.alive & self.let if self.restricted else self.alive
        if not alive.any():
            return
        weights: dict[int, list] = {}
        for q, wants in enumerate(self.wants):
            mine = [(t, w) for t, w in wants if t in self.posts]
            if not mine and not self.pad:
                continue
            best = self.best[q]
            most = sum(max(0.0, w) * max(p[2] for p in self.posts[t]) for t, w in mine)
            if len(best) == self.k and most < -best[-1][0] - 1e-6:
                self.skipped += 1
                continue
            self.scored += 1
            met, parts = np.zeros(len(alive), bool), [(np.empty(0, np.int32), np.empty(0))]
            for t, w in mine:
                if t not in weights:
                    weights[t] = [(places, self.weight(tfs.astype(np.float64), self.dls[places])) for places, tfs, _ in self.posts[t]]
                parts += [(places, w * of) for places, of in weights[t]]
            places, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            score = np.bincount(places, of, len(alive))  # added up in the order of tokens
            met[places] = True
            rows = np.flatnonzero(alive if self.pad else alive & met)
            some = np.round(score[rows], 6)
            if len(rows) > self.k:
                good = some >= np.partition(some, len(some) - self.k)[len(some) - self.k]
                rows, some = rows[good], some[good]
            order = np.lexsort((rows, -some))[: self.k]  # places are in order of id
            found = [(-s, self.ids[r].as_py()) for s, r in zip(some[order].tolist(), rows[order].tolist())]
            self.best[q] = sorted(best + found)[: self.k]
        self.block = None


_kept: dict[tuple[str, str], tuple[str, LexicalIndex]] = {}


def kept(spark: SparkSession, path: str, chunks: DataFrame) -> LexicalIndex:
    """The session's index of the chunks that the files at `path` hold, built at the first search and again when they
    have changed."""
    key, state = (spark.sparkContext.applicationId, path), storage.stamp(spark, path)
    if key not in _kept or _kept[key][0] != state:
        _kept[key] = state, LexicalIndex.build(chunks, storage.folder(spark, "lexical"))
    return _kept[key][1]


class VectorIndex:
    """Vectors of one dimension, with the columns that came with them, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, rows: DataFrame, path: str, dimension: int) -> VectorIndex:
        return cls(rows.sparkSession, path).append(rows, dimension, 0)

    def append(self, rows: DataFrame, dimension: int, part: int) -> VectorIndex:
        """rows: chunk_id, embedding and what else is to be kept. A vector of another length or a null one is an error."""
        fits = F.assert_true(F.coalesce(F.size("embedding") == dimension, F.lit(False)), F.lit(f"a vector hasn't {dimension} values"))
        rows.filter(fits.isNull()).write.mode("overwrite").parquet(f"{self.path}/part={part}")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex | None:
        return cls(spark, path) if storage.exists(spark, path) else None

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(self.path)

    def without(self, gone: DataFrame, path: str) -> VectorIndex:
        out = VectorIndex(self.spark, path)
        self.rows.join(gone.select("chunk_id"), "chunk_id", "left_anti").write.mode("overwrite").parquet(f"{path}/part=0")
        return out

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        return rt.dense(self.rows, queries, k, allowed)
