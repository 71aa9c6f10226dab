"""Removal of repeated passages, found by difference-cover anchors.

Of a period's residues a difference cover D has two for every difference: for any two positions there is a shift below
the period that brings both into D. So if windows of ANCHOR words are hashed only at positions whose residue is in D,
any two equal stretches of ANCHOR + PERIOD - 1 words share an anchor at the same place in both. Anchors that occur
twice mark where repeats can be; there alone full windows are hashed, and of equal windows all but the first go.

Each task gathers its own occurrences first and passes on one for each hash, so no hash has more rows than tasks have
batches, however often it occurs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import runtime

WINDOW = 20
#: Residues that make up every difference modulo PERIOD, each once.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a hash that are shuffled, besides what its bucket says: anchors only say where to look.
ANCHOR_BYTES, WINDOW_BYTES = 6, 8
#: Bytes of text whose occurrences a task gathers at once; occurrences that one task of the shuffle is meant to get.
GATHERED_BYTES, HASHES_A_TASK = 6_000_000, 1_000_000
#: Buckets into which what is gathered is dealt at once. Where more are needed, each of so many is gathered again, from
#: all tasks, and dealt once more: a row has the occurrences of many texts, however large the corpus is.
WIDE, REGATHERED = 1024, 2_000_000

#: The rank of a document without doc_id.
LAST = (1 << 63) - 1

_ROW = "bucket long, hashes binary, place binary, docs binary, at binary"


def _flags(blob: bytes | None, n: int, longer: int = 0) -> np.ndarray:
    """Which of n places lie in one of the runs, each so much longer."""
    edge = np.zeros(n + 1, np.int32)
    if blob:
        runs = np.frombuffer(blob, "<i4").reshape(-1, 2)
        np.add.at(edge, runs[:, 0], 1)
        np.add.at(edge, np.minimum(runs[:, 1] + longer, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _runs(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents and places as runs: each run's document, and its (begin, end)."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    if len(docs):
        fresh = np.concatenate([[True], (docs[1:] != docs[:-1]) | (places[1:] != places[:-1])])
        docs, places = docs[fresh], places[fresh]
    if not len(docs):
        return docs, np.empty((0, 2), "<i4")
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (np.diff(places) > 1)])
    return docs[new], np.stack([places[new], places[np.append(new[1:], True)] + 1], 1).astype("<i4")


def _within(docs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """What ranks rows of one doc_id: nothing, but rows without doc_id are documents of their own."""
    return np.where(docs == LAST, keys, 0)


def _later(new: np.ndarray, docs: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which occurrences, in order of hash and rank, are of a later rank than their hash's first; new: those first ones."""
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    within = _within(docs, keys)
    return (docs != docs[lead]) | (within != within[lead]) | (at != at[lead])


def _packed(hashes, docs, keys, at, buckets, first_only):
    """Rows of _ROW for one batch's occurrences, which are distinct and in order of rank. keys: their rows' keys.

    Of a hash's occurrences in the batch only the first (with those of the same rank, in other rows of its doc_id) is
    passed on to meet others'. The rest are repeats for sure and go past as runs, without hashes; unless first_only, so
    does the first."""
    if not len(hashes):
        return
    by = np.argsort(hashes, kind="stable")
    hashes, docs, keys, at = hashes[by], docs[by], keys[by], at[by]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    if first_only:
        done = _later(new, docs, keys, at)
        new = ~done
    else:
        done = ~new
        done[:-1] |= ~new[1:]
    if done.any():
        own, runs = _runs(keys[done], at[done])
        yield -1 - int(own[0]) % buckets, None, None, own.tobytes(), runs.tobytes()
    hashes, docs, keys, at = hashes[new], docs[new], keys[new], at[new].astype(np.uint32)
    part = (hashes % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    hashes, docs, keys, at, part = hashes[by], docs[by], keys[by], at[by], part[by]
    edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)) if len(part) else np.zeros(1, np.int64)
    for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        mine, some, place = np.unique(keys[i:j], return_index=True, return_inverse=True)
        yield int(part[i]), (hashes[i:j] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : WINDOW_BYTES if first_only else ANCHOR_BYTES].tobytes(), place.astype(np.uint16 if len(mine) <= 1 << 16 else np.uint32).tobytes(), np.stack([docs[i:j][some], mine], 1).tobytes(), at[i:j].tobytes()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (without what the bucket says), documents, keys and places of a row of _ROW that has hashes."""
    many = np.frombuffer(row["at"], np.uint32)
    raw = np.frombuffer(row["hashes"], np.uint8).reshape(len(many), -1)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    both = np.frombuffer(row["docs"], np.int64).reshape(-1, 2)[np.frombuffer(row["place"], np.uint16 if len(row["place"]) == 2 * len(many) else np.uint32)]
    return wide.view("<u8").reshape(-1), both[:, 0], both[:, 1], many


def _distinct(hashes: np.ndarray, docs: np.ndarray, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences in order of rank, each once: rows of one key have one text."""
    order = np.lexsort((keys, at, _within(docs, keys), docs))
    again = (keys[order][1:] == keys[order][:-1]) & (at[order][1:] == at[order][:-1])
    order = order[np.concatenate([[True], ~again])[: len(order)]]
    return hashes[order], docs[order], keys[order], at[order]


def _row(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["bucket", "hashes", "place", "docs", "at"])


def _again(first_only: bool, wide: int, fine: int):
    """mapInArrow function of rows of _ROW in order of bucket: each of `wide` buckets gathered and dealt to `fine` ones."""

    def run(batches):
        bucket, held, size = None, [], 0

        def dealt():
            if held:
                # the same hash in several rows is met here already
                for b, *rest in _packed(*_distinct(*(np.concatenate(x) for x in zip(*held, strict=True))), fine, first_only):
                    yield _row((bucket + wide * b if b >= 0 else -1 - (bucket + wide * (-1 - b)), *rest))

        for batch in batches:
            for row in batch.to_pylist():
                if row["hashes"] is None:
                    own = int(np.frombuffer(row["docs"], np.int64)[0])
                    yield _row((-1 - own % (wide * fine), None, None, row["docs"], row["at"]))
                    continue
                if row["bucket"] != bucket or size >= REGATHERED:
                    yield from dealt()
                    bucket, held, size = row["bucket"], [], 0
                hashes, docs, keys, at = _opened(row)
                held.append((hashes, docs, keys, at.astype(np.int64)))
                size += len(hashes)
        yield from dealt()

    return run


def _runs_again(wide: int, fine: int):
    """mapInArrow function of rows (group, docs, runs) in order of group: each of `wide` groups of documents gathered and
    dealt to `fine` ones."""

    def run(batches):
        group, held, size = None, [], 0

        def dealt():
            if held:
                owner, runs = (np.concatenate(x) for x in zip(*held, strict=True))
                part = owner // wide % fine
                by = np.argsort(part, kind="stable")
                owner, runs, part = owner[by], runs[by], part[by]
                edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)).tolist()
                for i, j in zip(edges, edges[1:], strict=False):
                    yield pa.RecordBatch.from_arrays([pa.array([group + wide * int(part[i])]), pa.array([owner[i:j].tobytes()], pa.binary()), pa.array([runs[i:j].tobytes()], pa.binary())], names=["group", "docs", "runs"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group or size >= REGATHERED:
                    yield from dealt()
                    group, held, size = row["group"], [], 0
                held.append((np.frombuffer(row["docs"], np.int64), np.frombuffer(row["runs"], "<i4").reshape(-1, 2)))
                size += len(held[-1][0])
        yield from dealt()

    return run


def _meet(first_only: bool, groups: int):
    """applyInArrow function of a bucket: runs of the places whose hash occurs elsewhere (first_only: earlier), packed
    by groups of documents."""

    def meet(table: pa.Table) -> pa.Table:
        owners, runs, hashes, docs, keys, at = [np.empty(0, np.int64)], [np.empty((0, 2), "<i4")], [], [], [], []
        for row in table.to_pylist():
            if row["hashes"] is None:
                owners.append(np.frombuffer(row["docs"], np.int64))
                runs.append(np.frombuffer(row["at"], "<i4").reshape(-1, 2))
            else:
                for x, into in zip(_opened(row), (hashes, docs, keys, at), strict=True):
                    into.append(x)
        if hashes:
            h, d, k, p = np.concatenate(hashes), np.concatenate(docs), np.concatenate(keys), np.concatenate(at).astype(np.int64)
            by = np.argsort(h, kind="stable")
            new = np.concatenate([[True], h[by][1:] != h[by][:-1]])
            by = by[~(new & np.append(new[1:], True))]
            by = by[np.lexsort((p[by], _within(d[by], k[by]), d[by], h[by]))]
            h, d, k, p = h[by], d[by], k[by], p[by]
            if first_only and len(h):
                later = _later(np.concatenate([[True], h[1:] != h[:-1]]), d, k, p)
                k, p = k[later], p[later]
            own, more = _runs(k, p)
            owners.append(own)
            runs.append(more)
        owner, run = np.concatenate(owners), np.concatenate(runs)
        group = owner % groups
        by = np.argsort(group, kind="stable")
        owner, run, group = owner[by], run[by], group[by]
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
        ends = np.append(edges[1:], len(group))
        spans = list(zip(edges.tolist(), ends.tolist(), strict=True)) if len(group) else []
        return pa.table({"group": group[edges], "docs": pa.array([owner[i:j].tobytes() for i, j in spans], pa.binary()), "runs": pa.array([run[i:j].tobytes() for i, j in spans], pa.binary())})

    return meet


def _gather(table: pa.Table) -> pa.Table:
    """applyInArrow function of a group of documents: one row of runs for each document."""
    owner = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("docs").to_pylist()])
    run = np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in table.column("runs").to_pylist()])
    by = np.argsort(owner, kind="stable")
    owner, run = owner[by], run[by]
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ends = np.append(edges[1:], len(owner))
    return pa.table({"key": owner[edges], "runs": pa.array([run[i:j].tobytes() for i, j in zip(edges, ends, strict=True)], pa.binary())})


def _by_document(rows: DataFrame, first_only: bool, wide: int, fine: int) -> DataFrame:
    """(key, runs) of rows of _ROW in `wide` buckets, each of which becomes `fine` ones."""
    if fine > 1:
        rows = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(runtime.relieved(_again(first_only, wide, fine)), _ROW)
    met = rows.groupBy("bucket").applyInArrow(runtime.relieved(_meet(first_only, wide)), "group long, docs binary, runs binary")
    if fine > 1:
        met = met.repartition("group").sortWithinPartitions("group").mapInArrow(runtime.relieved(_runs_again(wide, fine)), "group long, docs binary, runs binary")
    return met.groupBy("group").applyInArrow(runtime.relieved(_gather), "key long, runs binary")


class _Batcher:
    """Gathers (hash, doc, key, place) of slices until there is enough text, then packs them."""

    def __init__(self, buckets: int, first_only: bool):
        self.buckets, self.first_only, self.parts, self.size, self.docs = buckets, first_only, [], 0, 0

    def add(self, hashes, docs, keys, at, size, n):
        self.parts.append((hashes, docs, keys, at))
        self.size += size
        self.docs += n

    def full(self) -> bool:
        return self.size >= GATHERED_BYTES or self.docs >= 30_000

    def rows(self):
        if self.parts:
            hashes, docs, keys, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts, self.size, self.docs = [], 0, 0
            for row in _packed(*_distinct(hashes, docs, keys, at), self.buckets, self.first_only):
                yield _row(row)


def _anchors(source: DataFrame, wide: int, fine: int) -> DataFrame:
    """(key, runs): the cover positions whose ANCHOR words occur at another cover position."""

    def run(batches):
        gathered = _Batcher(wide, first_only=False)
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                data, offsets = runtime.utf8(part.column("text"))
                starts, ends, first = runtime.word_bounds(data, offsets)
                windows = runtime.window_hashes(runtime.word_hashes(data, starts, ends), ANCHOR)
                own = runtime.owners(first)[: len(windows)]
                place = np.arange(len(windows)) - first[own] if len(windows) else np.empty(0, np.int64)
                keep = np.flatnonzero(runtime.inside(first, ANCHOR, len(windows)) & np.isin(np.arange(PERIOD), COVER)[place % PERIOD])
                gathered.add(windows[keep], *(part.column(c).to_numpy()[own[keep]] for c in ("doc", "key")), place[keep], len(data), len(part))
                if gathered.full():
                    yield from gathered.rows()
        yield from gathered.rows()

    return _by_document(source.select("doc", "key", "text").mapInArrow(runtime.relieved(run), _ROW), False, wide, fine)


def _windows(marked: DataFrame, wide: int, fine: int) -> DataFrame:
    """(key, runs): starts of windows of WINDOW words that occur earlier. marked: (doc, key, text, marks), the anchors."""

    def run(batches):
        gathered = _Batcher(wide, first_only=True)
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                data, offsets = runtime.utf8(part.column("text"))
                starts, ends, first = runtime.word_bounds(data, offsets)
                windows = runtime.window_hashes(runtime.word_hashes(data, starts, ends), WINDOW)
                if not len(windows):
                    continue
                anchor = np.zeros(len(starts) + 1, np.int64)
                for i, marks in enumerate(part.column("marks").to_pylist()):
                    if marks:
                        anchor[first[i] + 1 : first[i + 1] + 1] = _flags(marks, int(first[i + 1] - first[i]))
                sums = np.cumsum(anchor)
                # a window has the anchors that start in its first PERIOD words
                has = sums[PERIOD : PERIOD + len(windows)] > sums[: len(windows)]
                keep = np.flatnonzero(has & runtime.inside(first, WINDOW, len(windows)))
                own = runtime.owners(first)[keep]
                gathered.add(windows[keep], *(part.column(c).to_numpy()[own] for c in ("doc", "key")), keep - first[own], len(data), len(part))
                if gathered.full():
                    yield from gathered.rows()
        yield from gathered.rows()

    return _by_document(marked.mapInArrow(runtime.relieved(run), _ROW), True, wide, fine)


def removed(docs: DataFrame, digest: bool = False, prefix: str = "") -> DataFrame:
    """docs' rows with `n_words`, `n_removed` and what is left: the text without the words to go or, with digest, the
    hash (sha256) of the kept words joined by spaces as `kept_sha256`; the new names get the prefix.

    A word goes if it lies in a window of WINDOW words of its document that equals one that starts earlier: in a
    document with a smaller doc_id, or before it in the same. Windows are judged on the input. Null texts have no words
    (and stay null). Rows that repeat a doc_id: equal places are of one rank, so none goes for the other's sake. Rows
    without doc_id are later than all others, and of different texts each a document of its own, in order of a hash of
    the text; those of equal texts are one document. A row's words go by its own text's windows alone. Kept stretches of a text keep their white space; the gap of a removed stretch
    becomes the white space before what follows. An empty table gives an empty result; texts are read whole.

    Texts are shuffled twice, to meet their anchors and then their repeats, beside hashes: a fixed share of the words,
    and those of repeats. Windows are equal if their 64-bit hashes are."""
    spark = docs.sparkSession
    runtime.ship(spark)
    key = runtime.fresh(docs, "key")
    rank, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.col("text").cast("string")
    # of the row's values, not of its place in the table: it is the same in every scan
    source = docs.withColumn(key, F.xxhash64(rank, text))
    plain = source.select(rank.alias("doc"), F.col(key).alias("key"), text.alias("text"))
    words = plain.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-words // (6 * HASHES_A_TASK)))
    wide, fine = min(buckets, WIDE), -(-buckets // WIDE)
    marks = runtime.written(_anchors(plain, wide, fine).withColumnRenamed("runs", "marks"))
    marked = plain.join(marks, "key")
    runs = runtime.written(_windows(marked, wide, fine))
    runtime.dropped(marks)
    name = runtime.fresh(source, "runs")
    joined = source.join(runs.select(F.col("key").alias(key), F.col("runs").alias(name)), key, "left")
    new = [prefix + n for n in ("n_words", "n_removed", *(["kept_sha256"] if digest else []))]
    kept_names = [c for c in docs.columns if c.lower() not in new]

    def run(batches):
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                column = part.column("text")
                data, offsets = runtime.utf8(column)
                starts, ends, first = runtime.word_bounds(data, offsets)
                raw = data.tobytes()
                gone_of = part.column(name).to_pylist()
                lost, left = [], []
                for i in range(len(part)):
                    a, b = int(first[i]), int(first[i + 1])
                    n, mine = b - a, raw[offsets[i] : offsets[i + 1]]
                    gone = _flags(gone_of[i], n, WINDOW - 1)
                    count = int(gone.sum())
                    lost.append(count)
                    if digest:
                        if count:
                            keep = np.flatnonzero(~gone) + a
                            words = [raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
                        else:
                            words = mine.split()
                        left.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    elif not column[i].is_valid:
                        left.append(None)
                    elif not count:
                        left.append(mine.decode())
                    else:
                        # each kept word with the white space before it; the tail goes with the last word
                        froms = np.concatenate([[offsets[i]], ends[a : b - 1]])
                        parts = [raw[s:e] for s, e, g in zip(froms.tolist(), ends[a:b].tolist(), gone.tolist(), strict=True) if not g]
                        left.append((b"".join(parts) + (b"" if gone[-1] else raw[ends[b - 1] : offsets[i + 1]])).decode().lstrip(" "))
                texts = pa.array(left, pa.string())
                stats = [pa.array(np.diff(first)), pa.array(lost, pa.int64())]
                kept = [texts if c == "text" and not digest else part.column(c) for c in kept_names]
                yield pa.RecordBatch.from_arrays([*kept, *stats, *([texts] if digest else [])], names=[*kept_names, *new])

    fields = [f for f in docs.schema.fields if f.name in kept_names]
    fields = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in fields]
    fields += [T.StructField(n, T.StringType() if n.endswith("sha256") else T.LongType()) for n in new]
    return joined.mapInArrow(runtime.relieved(run), T.StructType(fields))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with repeated passages removed from text, and n_chars (if there is one) counted anew; same columns."""
    out = removed(docs, prefix="__repeats_")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
