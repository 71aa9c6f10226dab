"""Threshold-scaled sketches: of a text's shingle hashes, all below a fixed fraction of the hash range.

Which hashes are kept doesn't depend on the text's length, so the union of two sketches is the sketch of both texts
together, and the part of one sketch that is in another estimates containment, however unequal the texts are. A short
text that has no hash below is sketched by its smallest hash, so that only texts without words have an empty sketch;
the smallest hash of a union is that of one of its parts, so merging holds for these too."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import runtime

#: Words in a shingle, and one in how many hashes is kept.
SHINGLE, SCALE = 5, 4


def _limit(scale: int) -> np.uint64:
    return np.uint64((1 << 64) // scale - 1)


def sketches(texts: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[np.ndarray]:
    """Each text's kept hashes, ascending: those up to the limit, or else the smallest. A text with fewer words than a
    shingle has them all as one shingle; one without words has none."""
    data, offsets = runtime.utf8(texts)
    starts, ends, first = runtime.word_bounds(data, offsets)
    words = runtime.word_hashes(data, starts, ends)
    windows = runtime.window_hashes(words, shingle)
    limit = _limit(scale)
    small = np.flatnonzero(windows <= limit)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            i, j = np.searchsorted(small, (a, b - shingle + 1))
            out.append(np.unique(windows[small[i:j]]) if j > i else windows[a : b - shingle + 1].min(keepdims=True))
        else:
            out.append(runtime.mix(runtime.window_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else words[:0])
    return out


def written(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def merged(parts: Iterable[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The sketch of several texts together."""
    all_ = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]))
    kept = all_[all_ <= _limit(scale)]
    return kept if len(kept) else all_[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated part of a's shingles that b has; an empty sketch is in none but another empty one."""
    if not len(a):
        return float(not len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated shared shingles over all of both (0 to 1). Two empty sketches are alike, an empty one is unlike all
    others; texts that are sketched by their smallest hash are alike if it is the same."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(df: DataFrame, name: str = "fingerprint", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """df with the sketch of each whole text as a string (base64 of ascending little-endian hashes).

    Null and empty texts have an empty one; equal texts have equal ones. Each row stands alone; a column of df with the
    new name is replaced; an empty table gives an empty result."""
    runtime.ship(df.sparkSession)
    kept = df.drop(name)

    def run(batches):
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                found = [written(s) for s in sketches(part.column("text"), shingle, scale)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], names=[*part.schema.names, name])

    from pyspark.sql import types as T

    return kept.mapInArrow(runtime.relieved(run), T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())]))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


#: Characters of text that one block of documents is meant to have, and rows sampled to each block's bounds.
BLOCK_CHARS, SAMPLED = 32_000_000, 30


def _constant(values: list[int | None]) -> Column:
    """An array of constants as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _block_of(key: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are at or below (key, tie), by halving."""
    if not bounds:
        return F.lit(0).cast("long")
    keys, ties = (_constant([b[i] for b in bounds]) for i in (0, 1))
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def further(at: Column, step: Column) -> Column:
        there = at + step
        bound = F.try_element_at(keys, there.cast("int"))
        below = (bound < key) | (bound == key) & (F.try_element_at(ties, there.cast("int")) <= tie)
        return F.when(F.coalesce(below, F.lit(False)), there).otherwise(at)

    return F.aggregate(_constant(steps), F.lit(0).cast("long"), further)


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of an edited text and of the next document in descending doc_id order.

    The edited text has the last half of the characters replaced by the first as many of the next document. After the
    last comes the first; a null doc_id is last; rows that repeat a doc_id are in order of a hash of their text, then of
    the text. A lone document is its own next. Null texts count as empty. An empty table gives an empty result.

    Documents are dealt in blocks of consecutive ones, as many as the text needs, whose bounds are those of a sample;
    a bound can lie among rows of one doc_id. A block is streamed in order, with the next block's first document after
    its end: the only rows that are known beyond a block, one for each."""
    spark = docs.sparkSession
    runtime.ship(spark)
    least = -(1 << 63)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # ascending in key and tie is the order of documents: of descending doc_id
    key = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    n = max(runtime.partitions(spark), -(-(size["chars"] or 0) // BLOCK_CHARS))
    share = min(1.0, SAMPLED * n / max(size["rows"], 1))
    some = sorted((r["key"], r["tie"]) for r in rows.select("key", "tie").sample(fraction=share, seed=5).collect())
    bounds = sorted({some[i * len(some) // n] for i in range(1, n)}) if some else []
    dealt = rows.withColumn("block", _block_of(F.col("key"), F.col("tie"), bounds))
    firsts = {r["block"]: r["first"] for r in dealt.groupBy("block").agg(F.min(F.struct("key", "tie")).alias("first")).collect()}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    known = [firsts.get(b) for b in range(len(bounds) + 1)]
    of_block = lambda values: F.element_at(_constant(values), (F.col("block") + 1).cast("int"))
    is_first = (F.col("key") == of_block([k and k["key"] for k in known])) & (F.col("tie") == of_block([k and k["tie"] for k in known]))
    # of rows with the same hash the first by text; equal rows are the same document
    heads = dealt.filter(is_first).groupBy("block", "key", "tie").agg(F.min("text").alias("text"))
    ends = heads.select(of_block([before.get(b) for b in range(len(known))]).alias("block"), F.lit(True).alias("last"), "key", "tie", F.lit(None).cast("long").alias("doc_id"), "text")
    together = dealt.select("block", F.lit(False).alias("last"), "key", "tie", "doc_id", "text").unionByName(ends).repartition(n, "block")
    ordered = together.sortWithinPartitions("block", "last", "key", "tie", "text").select("block", "last", "doc_id", "text")

    def results(held):
        texts = [t for _, t in held]
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        own = sketches(pa.array(texts, pa.large_string()))
        new = sketches(pa.array(edited, pa.large_string()))
        rows = []
        for i, text in enumerate(edited):
            rows.append((held[i][0], len(texts[i]), hashlib.sha256(text.encode()).hexdigest(), written(own[i]), written(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1])))
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=_NAMES)

    def run(batches):
        held, at, size = [], None, 0
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                for block, last, doc, text in zip(*(part.column(c).to_pylist() for c in ("block", "last", "doc_id", "text")), strict=True):
                    if block != at:
                        held, at, size = [], block, 0
                    held.append((doc, text))
                    size += len(text)
                    if last or size >= runtime.STEP_BYTES:
                        if len(held) > 1:
                            yield results(held)
                        held, size = ([] if last else held[-1:]), 0

    return ordered.mapInArrow(runtime.relieved(run), _OUT)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]
