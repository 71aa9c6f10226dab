"""Cross-entropy difference: how much likelier a text is under a target model than under a background model.

Both are bigram models of the same order and smoothing over one vocabulary, all words of the documents and the text's
end. The background's word probabilities are shares, p(w) = c(w) / N; the target's lean on them, (c'(w) + STRENGTH p(w)) /
(N' + STRENGTH); and in either model a word's probability after another is (c(u, w) + STRENGTH p(w)) / (c(u) + STRENGTH).
So after any word each model's probabilities sum to one. The target is a part of the background's documents. A
document's score is the mean over its words and its end of the target loss less the background loss: the lower, the
closer to the target.

All counts are exact and none is dropped; what is counted grows with the corpus, so no model is held in one place. Rows
are dealt into gathers of some megabytes. The distinct words and bigrams of a gather go to their buckets as arrays of
sorted hashes, where the counts of all gathers are summed up, and each gather gets back the sums for what it asked.
However common a word is, a gather has one entry for it. Texts are shuffled once: asking and scoring read the same
exchange.

A gather asks WIDE buckets at most. Where counts need more, what some gathers ask a bucket is merged, each key once, and
asked of finer ones together, and the sums go back to them the same way: no row gets smaller as the corpus grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import runtime

#: How many words' weight the less specific estimate has in the more specific one.
STRENGTH = 20.0
#: Characters of text to a gather, and to a bucket of counts.
GATHER_CHARS, BUCKET_CHARS = 12_000_000, 8_000_000
#: Buckets that a gather asks, and gathers whose questions to a bucket are merged where there are finer ones.
WIDE, MERGED = 1024, 1024
#: Bits of a hash of a word or bigram, the lowest of which says which it is.
BITS = 56
#: What the text's end counts as; before a text's first word stands its start.
_END = np.uint64(0x5DEECE66D5DEECE6)


def _narrow(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs; the first byte says how many."""
    kind = next(k for k in (1, 2, 4, 8) if k == 8 or not len(values) or int(values.max()) < 1 << 8 * k)
    return bytes([kind]) + values.astype(f"<u{kind}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one's upper bits, then all lower 32 bits, then how much the upper bits grow."""
    upper = keys >> np.uint64(32)
    return upper[:1].astype("<u8").tobytes() + (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + _narrow(np.diff(upper))


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    lower = np.frombuffer(blob, "<u4", count=n, offset=8).astype(np.uint64)
    upper = np.cumsum(np.concatenate([np.frombuffer(blob, "<u8", count=1).astype(np.int64), _wide(blob[8 + 4 * n :])]))
    return (upper.astype(np.uint64) << np.uint64(32)) | lower


class _Counted:
    """The words and bigrams of texts, each text ended."""

    def __init__(self, texts: pa.Array):
        data, offsets = runtime.utf8(texts)
        starts, ends, first = runtime.word_bounds(data, offsets)
        self.n_words = np.diff(first)
        #: events of each text: its words and its end; a text without words has none
        self.sizes = self.n_words + (self.n_words > 0)
        last = np.zeros(int(self.sizes.sum()), bool)
        self.stops = np.cumsum(self.sizes)
        last[self.stops[self.sizes > 0] - 1] = True
        events = np.full(len(last), _END)
        events[~last] = runtime.word_hashes(data, starts, ends)
        words, after = np.unique(events, return_inverse=True)
        before = np.empty(len(after), np.int64)
        before[1:] = after[:-1]
        before[(self.stops - self.sizes)[self.sizes > 0]] = len(words)
        codes, self.event, n = np.unique(before * (len(words) + 1) + after, return_inverse=True, return_counts=True)
        #: of each bigram the places of its words; a first word's is that of the start, which has the end's count
        self.one, self.two = codes // (len(words) + 1), codes % (len(words) + 1)
        end = np.searchsorted(words, _END)
        contexts = np.append(words, runtime.mix(np.array([_END])))
        self.contexts = np.append(np.arange(len(words)), end)
        with np.errstate(over="ignore"):
            pairs = runtime.mix(runtime.mix(contexts[self.one]) * np.uint64(0x9E3779B97F4A7C15) + words[self.two])
        keys = np.concatenate([runtime.mix(words) & ~np.uint64(1 << (64 - BITS)), pairs | np.uint64(1 << (64 - BITS))]) >> np.uint64(64 - BITS)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.many = keys[self.order], len(words)
        self.after, self.counts = after, np.concatenate([np.bincount(after, minlength=len(words)), n])[self.order]

    def counted(self, chosen: np.ndarray) -> np.ndarray:
        """The keys' counts in the chosen texts."""
        event = np.repeat(chosen, self.sizes)
        word, pair = np.bincount(self.after[event], minlength=self.many), np.bincount(self.event[event], minlength=len(self.one))
        return np.concatenate([word, pair])[self.order]

    def asked(self, buckets: int, chosen: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Bucket, keys, and their counts in all texts and in the chosen ones: the buckets are ranges of keys."""
        near = self.counted(chosen)
        part = np.minimum(self.keys // np.uint64((1 << BITS) // buckets), np.uint64(buckets - 1))
        edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)).tolist() if len(part) else []
        for i, j in zip(edges, edges[1:], strict=False):
            yield int(part[i]), _packed(self.keys[i:j]), _narrow(self.counts[i:j]), _narrow(near[i:j])

    def means(self, counts: np.ndarray, share: np.ndarray, strength: float) -> np.ndarray:
        """Mean loss of each text, given the counts of all keys in their order and the words' own probabilities."""
        own = np.empty(len(counts), np.int64)
        own[self.order] = counts
        context, joint = own[: self.many][self.contexts], own[self.many :]
        loss = -np.log((joint + strength * share[self.two]) / (context[self.one] + strength))
        sums = np.concatenate([[0.0], np.cumsum(loss[self.event])])
        return (sums[self.stops] - sums[self.stops - self.sizes]) / np.maximum(self.sizes, 1)

    def words(self, counts: np.ndarray) -> np.ndarray:
        """Of counts of all keys in their order, those of the words in the words' order."""
        own = np.empty(len(counts), np.int64)
        own[self.order] = counts
        return own[: self.many]


_ASKED = "bucket long, gather long, keys binary, far binary, near binary"
_ANSWERED = "bucket long, gather long, far binary, near binary"
_ASKED_NAMES = [x.split()[0] for x in _ASKED.split(", ")]
_ASKED_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _table(rows: list[tuple], names: list[str], types: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(list(c), t) for n, t, c in zip(names, types, columns, strict=True)})


def _meet(table: pa.Table) -> pa.Table:
    """applyInArrow function of a bucket: for each gather the sums, over all gathers, of the counts of what it asked for."""
    counts = [[_wide(x) for x in table.column(c).to_pylist()] for c in ("far", "near")]
    sizes = [len(c) for c in counts[0]]
    keys = [_unpacked(x, n) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for own in counts:
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate(own))
        sums.append(total)
    rows, at, bucket = [], 0, table.column("bucket")[0].as_py()
    for gather, size in zip(table.column("gather").to_pylist(), sizes, strict=True):
        mine = place[at : at + size]
        rows.append((bucket, gather, None, _narrow(sums[0][mine]), _narrow(sums[1][mine])))
        at += size
    return _table(rows, _ASKED_NAMES, _ASKED_TYPES).drop_columns(["keys"])


def _together(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each row, all of them once, and the places of the rows' keys among those."""
    sizes = [len(_wide(x)) for x in table.column("far").to_pylist()]
    keys = [_unpacked(x, n) for x, n in zip(table.column("keys").to_pylist(), sizes, strict=True)]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, place


def _finer(asked: DataFrame, wide: int, fine: int, gathers: int) -> DataFrame:
    """Answers (bucket, gather, far, near) to asked, a written table of questions to `wide` buckets, through `fine` times
    as many."""
    parts = max(1, -(-gathers // MERGED))
    low, step = (1 << BITS) // wide, (1 << BITS) // (wide * fine)
    asked = asked.withColumn("merged", F.col("bucket") * parts + F.col("gather") % parts)

    def merge(table: pa.Table) -> pa.Table:
        _, distinct, place = _together(table)
        sums = [np.zeros(len(distinct), np.int64) for _ in range(2)]
        for total, name in zip(sums, ("far", "near"), strict=True):
            np.add.at(total, place, np.concatenate([_wide(x) for x in table.column(name).to_pylist()]))
        bucket, merged = table.column("bucket")[0].as_py(), table.column("merged")[0].as_py()
        part = np.minimum((distinct - np.uint64(bucket * low)) // np.uint64(step), np.uint64(fine - 1)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part)).tolist()
        rows = [(bucket * fine + int(part[i]), merged, _packed(distinct[i:j]), _narrow(sums[0][i:j]), _narrow(sums[1][i:j])) for i, j in zip(edges, edges[1:], strict=False)]
        return _table(rows, _ASKED_NAMES, _ASKED_TYPES)

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            keys, _, place = _together(left)
            got = sorted(zip(right.column("bucket").to_pylist(), right.column("far").to_pylist(), right.column("near").to_pylist(), strict=True))
            far, near = (np.concatenate([_wide(a[i]) for a in got]) for i in (1, 2))
            at = 0
            for bucket, gather, mine in zip(left.column("bucket").to_pylist(), left.column("gather").to_pylist(), keys, strict=True):
                own = place[at : at + len(mine)]
                rows.append((bucket, gather, None, _narrow(far[own]), _narrow(near[own])))
                at += len(mine)
        return _table(rows, _ASKED_NAMES, _ASKED_TYPES).drop_columns(["keys"])

    merged = asked.groupBy("merged").applyInArrow(runtime.relieved(merge), _ASKED)
    answers = merged.groupBy("bucket").applyInArrow(runtime.relieved(_meet), _ANSWERED)
    return asked.groupBy("merged").cogroup(answers.withColumnRenamed("gather", "merged").groupBy("merged")).applyInArrow(runtime.relieved(share), _ANSWERED)


def _sizes(docs: DataFrame, key: str) -> DataFrame:
    """Of each row its key, bytes of text, and events (words and an end)."""

    def run(batches):
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                data, offsets = runtime.utf8(part.column("text"))
                words = np.diff(runtime.word_bounds(data, offsets)[2])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(np.diff(offsets)), pa.array(words + (words > 0))], names=["key", "bytes", "events"])

    kind = docs.schema[key].dataType
    return docs.select(key, "text").mapInArrow(runtime.relieved(run), T.StructType([T.StructField("key", kind), T.StructField("bytes", T.LongType()), T.StructField("events", T.LongType())]))


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", strength: float = STRENGTH) -> DataFrame:
    """docs without `text`, with n_words, target_loss, background_loss (nats per word or end) and score, their difference.

    The background model learns from all of docs, the target model from those whose key is in target (key; it may repeat;
    keys that docs doesn't have, and null, count for nothing). A null or wordless text has no words and null losses.
    Columns of docs with the new names are replaced; repeated rows count and are scored as often as they occur; without
    any target row the target's probabilities are the background's shares. An empty table gives an empty result. Texts
    are read whole."""
    spark = docs.sparkSession
    runtime.ship(spark)
    new = ["n_words", "target_loss", "background_loss", "score"]
    own = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    names = [c for c in own.columns if c != "text"]
    # names of its own, whatever docs' are
    plain = own.select("text", *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    fields = [f for f in plain.schema.fields if f.name != "text"]
    mark = f"c{names.index(key)}"
    kind = plain.schema[mark].dataType
    good = target.select(F.col(key).cast(kind).alias("key")).filter("key is not null").distinct()
    sizes = _sizes(plain, mark).join(good.withColumn("good", F.lit(True)), "key", "left")
    total = sizes.agg(F.sum("bytes").alias("n"), F.sum("events").alias("far"), F.sum(F.when(F.col("good"), F.col("events"))).alias("near")).first()
    chars, far_events, near_events = (total[c] or 0 for c in ("n", "far", "near"))
    buckets = max(1, -(-chars // BUCKET_CHARS))
    wide, fine = min(buckets, WIDE), -(-buckets // WIDE)
    # some for each task, if there is text enough
    gathers = max(1, -(-chars // GATHER_CHARS), min(runtime.partitions(spark), chars // (GATHER_CHARS // 10)))
    dealt_by = lambda c: F.pmod(F.xxhash64(c), F.lit(gathers))
    # rows without a key are dealt by all they hold
    gather = F.when(F.col(mark).isNotNull(), dealt_by(mark)).otherwise(F.pmod(F.xxhash64(*plain.columns), F.lit(gathers)))
    dealt = plain.select(gather.alias("gather"), *plain.columns).repartition(min(gathers, 4 * runtime.partitions(spark)), "gather")
    good = good.select(dealt_by("key").alias("gather"), "key")

    def asking(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], _ASKED_NAMES, _ASKED_TYPES)
        found = _Counted(left.column("text"))
        chosen = pc.fill_null(pc.is_in(left.column(mark), right.column("key").combine_chunks()), False).to_numpy()
        return _table([(b, left.column("gather")[0].as_py(), *rest) for b, *rest in found.asked(wide, chosen)], _ASKED_NAMES, _ASKED_TYPES)

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _Counted(left.column("text"))
        got = sorted(zip(right.column("bucket").to_pylist(), right.column("far").to_pylist(), right.column("near").to_pylist(), strict=True))
        far, near = (np.concatenate([np.empty(0, np.int64), *(_wide(a[i]) for a in got)]) for i in (1, 2))
        share = found.words(far) / max(far_events, 1)
        means = [found.means(near, (found.words(near) + strength * share) / (near_events + strength), strength), found.means(far, share, strength)]
        none = found.n_words == 0
        columns = [pa.array(found.n_words), *(pa.array(m, mask=none) for m in (*means, means[0] - means[1]))]
        return pa.table([*(left.column(f.name) for f in fields), *columns], names=[*(f.name for f in fields), *new])

    asked = dealt.groupBy("gather").cogroup(good.groupBy("gather")).applyInArrow(runtime.relieved(asking), _ASKED)
    answers = asked.groupBy("bucket").applyInArrow(runtime.relieved(_meet), _ANSWERED) if fine == 1 else _finer(runtime.written(asked), wide, fine, gathers)
    more = [T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in new[1:])]
    out = dealt.groupBy("gather").cogroup(answers.groupBy("gather")).applyInArrow(runtime.relieved(losses), T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), *more]))
    return out.toDF(*names, *new)
