"""MinHash near-duplicates with tensored banding.

A document's set of word shingles has SIDE left and SIDE right keys, each of ROWS minhashes. A table is a pair of a left
and a right key, so SIDE^2 tables of 2 * ROWS minhashes each cost only 2 * SIDE * ROWS minhash computations. Documents
with the same set are one class from the start, and only one of each class is hashed.

First, in each bucket of each table, every member is paired with the bucket's first: a bucket is cut down to one member
inside a task before it is shuffled, so no key has more rows than there are tasks. Pairs are confirmed on full sets and
confirmed links make components. Then every pair of different components that shares a bucket is compared, so that each
pair that shares one is settled; a crowded bucket is dealt out in blocks, of which each two meet
in a task of their own. What is compared there are odd sketches, and only pairs that may be links become rows: an odd
sketch has one bit for each class of shingles, whether the set has an odd number of them. Two sketches differ in no more
bits than the sets have shingles that only one has, so no link is lost."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import runtime
from docquarry.llm.components import components


@dataclass(frozen=True)
class Settings:
    """shingle: words in one; percent: least similarity (intersection over union) of a link; fold: A-Z count as a-z.

    rows: minhashes of a key; side: keys of either side; crowded: members of a bucket from which on it is compared in
    blocks of about so many."""

    shingle: int = 5
    percent: int = 80
    fold: bool = True
    rows: int = 3
    side: int = 14
    crowded: int = 4096

    def missed(self, similarity: float) -> float:
        """The chance that no table has both of two documents of this similarity."""
        one = 1 - similarity**self.rows
        return 1 - (1 - one**self.side) ** 2


def shingles(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin. A text with fewer words has all of
    them as its only shingle; one without words has none."""
    data, offsets = runtime.utf8(texts)
    starts, ends, first = runtime.word_bounds(data, offsets)
    words = runtime.word_hashes(data, starts, ends, settings.fold)
    k = settings.shingle
    windows = runtime.window_hashes(words, k)
    out, sizes = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.unique(windows[a : b - k + 1])
        elif b > a:
            own = runtime.mix(runtime.window_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            own = words[:0]
        out.append(own)
        sizes.append(len(own))
    return np.concatenate([words[:0], *out]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def sketch(hashes: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """(sets, 2 * side) keys of non-empty sets: the left ones, then the right ones."""
    n = settings.rows * settings.side * 2
    multiply = runtime._stream(31, n) | np.uint64(1)
    add = runtime._stream(32, n)
    keys = np.zeros((len(first) - 1, 2 * settings.side), np.uint64)
    work = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        for i in range(n):
            np.multiply(hashes, multiply[i], out=work)
            work += add[i]
            work ^= work >> np.uint64(29)
            column = keys[:, i // settings.rows]
            column *= np.uint64(0xD6E8FEB86659FD93)
            column += runtime.mix(np.minimum.reduceat(work, first[:-1]))
    return runtime.mix(keys)


def _odd_sketch(hashes: np.ndarray) -> bytes:
    """The odd sketch of a set: at least two bits for each member, a power of two and 512 or more."""
    width = max(512, 1 << (2 * len(hashes) - 1).bit_length())
    bits = (runtime.mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


class _Sketches:
    """Sizes and odd sketches of sets, compared by pairs of their places."""

    def __init__(self, blobs: list[bytes]):
        """blobs: of each set its size as 8 bytes, then its odd sketch."""
        data = np.frombuffer(b"".join(blobs), np.uint64)
        ends = np.cumsum([len(x) // 8 for x in blobs], dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        self.size = data[begins].astype(np.int64) if len(blobs) else np.empty(0, np.int64)
        self.words = ends - begins - 1
        self.place = np.zeros(len(blobs), np.int64)
        self.of_width = {}
        for w in np.unique(self.words).tolist():
            mine = np.flatnonzero(self.words == w)
            self.place[mine] = np.arange(len(mine))
            self.of_width[w] = data[begins[mine][:, None] + 1 + np.arange(w)]

    def may_link(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs can be similar enough; those that can't surely aren't."""
        n, m = self.size[a], self.size[b]
        may = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        at = np.flatnonzero(may)
        narrow = np.minimum(self.words[a[at]], self.words[b[at]])
        for w in np.unique(narrow).tolist():
            mine = at[narrow == w]
            step = max(1, 4_000_000 // w)
            for i in range(0, len(mine), step):
                some = mine[i : i + step]
                differ = np.bitwise_count(self._rows(a[some], w) ^ self._rows(b[some], w)).sum(1, dtype=np.int64)
                may[some] = (100 + percent) * differ <= (100 - percent) * (n[some] + m[some])
        return may

    def _rows(self, which: np.ndarray, w: int) -> np.ndarray:
        """Sketches folded to w words: the halves of a sketch, one on the other, are the sketch of half the width."""
        out, own = np.empty((len(which), w), np.uint64), self.words[which]
        for width in np.unique(own).tolist():
            mine = own == width
            rows = self.of_width[width][self.place[which[mine]]]
            while rows.shape[1] > w:
                rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
            out[mine] = rows
        return out


def _digests(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs' doc_id with n_shingles, the 128-bit digest of the set, its keys, and its size and odd sketch."""

    def run(batches):
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                hashes, first = shingles(part.column("text"), settings)
                n = np.diff(first)
                full = np.flatnonzero(n)
                keys = sketch(hashes, np.append(first[:-1][full], first[-1]), settings) if len(full) else None
                blobs, marks, digests = [None] * len(n), [None] * len(n), np.zeros((len(n), 2), np.int64)
                for k, i in enumerate(full.tolist()):
                    own = hashes[first[i] : first[i + 1]]
                    blobs[i] = keys[k].tobytes()
                    marks[i] = np.uint64(len(own)).tobytes() + _odd_sketch(own)
                    digests[i] = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                columns = [part.column("doc_id"), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "low", "high", "keys", "marks"])

    return docs.mapInArrow(runtime.relieved(run), "doc_id long, n_shingles long, low long, high long, keys binary, marks binary")


#: Nodes whose buckets a task gathers at once (a power of two); keys that one task of the shuffle is meant to get.
GATHERED, KEYS_A_TASK = 1 << 12, 500_000
#: Buckets into which a gather's keys are dealt at once. Where more are needed, each of so many is gathered again, up to so
#: many nodes and keys (places have 16 bits), and dealt once more: no row gets smaller as the corpus grows.
WIDE, NODES_AGAIN, KEYS_AGAIN = 1024, 60_000, 1_000_000
#: Parts into which rows of one set are dealt before their class is found.
SALTS = 64

_PACKED = "bucket long, gather long, keys binary, place binary, counts binary, nodes binary, others binary, marks binary, sizes binary, subs binary, gathers binary"
_MET = "a long, b long, gather long, key long, blocks int"


def _grid(keys: np.ndarray, side: int) -> np.ndarray:
    """(nodes, side^2) table keys."""
    table = runtime._stream(33, side * side)
    with np.errstate(over="ignore"):
        left = np.repeat(keys[:, :side], side, axis=1)
        return runtime.mix(left * np.uint64(0x9E3779B97F4A7C15) + np.tile(keys[:, side:], (1, side)) + table)


def _run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _parts(keys: np.ndarray, side: int, buckets: int) -> np.ndarray:
    """(nodes, side^2) places in the shuffle of the table keys: tables of one left key go together, so that a pair that
    shares several of them meets once."""
    return np.repeat((runtime.mix(keys[:, :side]) % np.uint64(buckets)).astype(np.int64), side, axis=1)


def _dealt(buckets: int) -> tuple[int, int]:
    """How many buckets a gather deals to, and how many each of those becomes."""
    return min(buckets, WIDE), -(-buckets // WIDE)


def _by_bucket(gather: int | None, keys: np.ndarray, part: np.ndarray, owner: np.ndarray, nodes: np.ndarray, counts: np.ndarray | None = None, comps: np.ndarray | None = None, marks: list[bytes] | None = None, subs: np.ndarray | None = None, gathers: np.ndarray | None = None):
    """Rows of _PACKED: keys by their part, with the places of their owners in nodes; counts and subs belong to keys,
    components, marks and gathers to nodes."""
    by = np.argsort(part, kind="stable")
    keys, owner, part = keys[by], owner[by], part[by]
    counts = counts[by].astype(np.uint16) if counts is not None else None
    subs = subs[by].astype(np.uint32) if subs is not None else None
    edges = np.append(_run_starts(part), len(part)).tolist()
    for i, j in zip(edges, edges[1:], strict=False):
        mine, place = np.unique(owner[i:j], return_inverse=True)
        blobs = [marks[k] for k in mine.tolist()] if marks is not None else []
        of = lambda x: None if x is None else x[i:j].tobytes()  # noqa: E731, B023
        own = lambda x: None if x is None else x[mine].tobytes()  # noqa: E731, B023
        yield int(part[i]), gather, keys[i:j].tobytes(), place.astype(np.uint16).tobytes(), of(counts), nodes[mine].tobytes(), own(comps), b"".join(blobs), np.array([len(x) for x in blobs], np.uint32).tobytes(), of(subs), own(gathers)


def _first_dealing(gather: int, keys: np.ndarray, part: np.ndarray, owner: np.ndarray, nodes: np.ndarray, wide: int, fine: int, **more):
    """_by_bucket for the first dealing of a gather: part is the last bucket."""
    yield from _by_bucket(gather, keys, part % wide, owner, nodes, subs=part // wide if fine > 1 else None, **more)


def _again(wide: int):
    """mapInArrow function of rows of _PACKED in order of bucket: each bucket gathered from many gathers, and dealt to those
    that its keys' subs name."""

    def run(batches):
        bucket, held, nodes, keys = None, [], 0, 0

        def dealt():
            if not held:
                return
            whole = lambda name, kind: None if held[0][name] is None else np.frombuffer(b"".join(r[name] for r in held), kind)
            sizes, many = np.array([len(r["nodes"]) // 8 for r in held]), np.array([len(r["keys"]) // 8 for r in held])
            owner = whole("place", np.uint16).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, many)
            subs = whole("subs", np.uint32).astype(np.int64)
            marks = None
            if held[0]["sizes"]:
                blob, ends = b"".join(r["marks"] for r in held), np.cumsum(whole("sizes", np.uint32), dtype=np.int64)
                marks = [blob[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            gathers = np.repeat(np.array([r["gather"] for r in held], np.int64), sizes)
            for row in _by_bucket(None, whole("keys", np.uint64), bucket + wide * subs, owner, whole("nodes", np.int64), whole("counts", np.uint16), whole("others", np.int64), marks, gathers=gathers):
                yield _batch(row)

        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"] is None:
                    yield _batch(tuple(row[n] for n in batch.schema.names))
                    continue
                if row["bucket"] != bucket or nodes + len(row["nodes"]) // 8 > NODES_AGAIN or keys >= KEYS_AGAIN:
                    yield from dealt()
                    bucket, held, nodes, keys = row["bucket"], [], 0, 0
                held.append(row)
                nodes, keys = nodes + len(row["nodes"]) // 8, keys + len(row["keys"]) // 8
        yield from dealt()

    return run


def _in_buckets(packed: DataFrame, buckets: int) -> DataFrame:
    """Rows of _PACKED of a first dealing, in their last buckets."""
    wide, fine = _dealt(buckets)
    if fine == 1:
        return packed
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(runtime.relieved(_again(wide)), _PACKED)


def _gathers_of(table: pa.Table) -> np.ndarray:
    """The gather of each node of rows of _PACKED."""
    own = zip(table.column("gather").to_pylist(), table.column("gathers").to_pylist(), table.column("nodes").to_pylist(), strict=True)
    return np.concatenate([np.empty(0, np.int64), *(np.frombuffer(many, np.int64) if many is not None else np.full(len(nodes) // 8, one, np.int64) for one, many, nodes in own)])


def _batch(row) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[2:])], names=names)


def _unpacked(table: pa.Table, kinds: dict[str, type]) -> list[np.ndarray]:
    """The keys of all rows and the places of their nodes, then the columns of kinds, one after the other."""
    blobs = lambda name: [x for x in table.column(name).to_pylist() if x is not None]
    whole = lambda name, kind: np.frombuffer(b"".join(blobs(name)), kind)
    sizes = np.array([len(x) // 8 for x in blobs("nodes")], np.int64)
    many = np.array([len(x) // 8 for x in blobs("keys")], np.int64)
    place = whole("place", np.uint16).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, many)
    return [whole("keys", np.uint64), place, *(whole(name, kind) for name, kind in kinds.items()), many]


def _stars(reps: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """Rows of _MET. With a and b: of each bucket's members, each but the first is in a pair with an earlier one, such
    that the pairs connect them all. With key: that the gather has members of a bucket that is to be compared in so many
    blocks."""

    wide, fine = _dealt(buckets)
    buckets = wide * fine

    def gathered(gather, nodes, keys):
        by = np.argsort(nodes, kind="stable")  # a run's first is its smallest node
        nodes, keys = nodes[by], keys[by]
        grid, part = _grid(keys, settings.side).reshape(-1), _parts(keys, settings.side, buckets).reshape(-1)
        owner = np.repeat(np.arange(len(nodes)), settings.side**2)
        by = np.argsort(grid, kind="stable")
        grid, part, owner = grid[by], part[by], owner[by]
        start = _run_starts(grid)
        count = np.diff(np.append(start, len(grid)))
        lead = np.repeat(owner[start], count)
        later = np.flatnonzero(lead != owner)
        pairs = np.unique(owner[later] * len(nodes) + lead[later])
        if len(pairs):
            yield -1 - gather % buckets, gather, None, None, None, nodes[pairs // len(nodes)].tobytes(), nodes[pairs % len(nodes)].tobytes(), None, None, None, None
        yield from _first_dealing(gather, grid[start], part[start], owner[start], nodes, wide, fine, counts=count)

    def run(batches):
        for batch in batches:
            gather, nodes = batch.column("gather").to_numpy(), batch.column("node").to_numpy()
            edges = [*_run_starts(gather).tolist(), len(gather)]
            for i, j in zip(edges, edges[1:], strict=False):
                keys = np.frombuffer(b"".join(batch.column("keys")[i:j].to_pylist()), np.uint64).reshape(j - i, -1)
                for row in gathered(int(gather[i]), nodes[i:j], keys):
                    yield _batch(row)

    def meet(table: pa.Table) -> pa.Table:
        plain = pc.is_null(table.column("keys"))
        pairs = table.filter(plain)
        a, b = ([np.frombuffer(x, np.int64) for x in pairs.column(c).to_pylist()] for c in ("nodes", "others"))
        table = table.filter(pc.invert(plain))
        keys, place, counts, nodes, many = _unpacked(table, {"counts": np.uint16, "nodes": np.int64})
        member, gather = nodes[place], _gathers_of(table)[place]
        by = np.lexsort((member, keys))
        keys, member = keys[by], member[by]
        start = _run_starts(keys)
        length = np.diff(np.append(start, len(keys)))
        lead = np.repeat(member[start], length)
        later = np.flatnonzero(member != lead)
        a, b = np.concatenate([*a, member[later]]), np.concatenate([*b, lead[later]])
        by_pair = np.lexsort((b, a))
        a, b = a[by_pair], b[by_pair]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[fresh], b[fresh]
        total = np.repeat(np.add.reduceat(counts[by].astype(np.int64), start) if len(start) else length, length)
        hot = np.flatnonzero(total > settings.crowded)
        none, empty = pa.nulls(len(a), pa.int64()), pa.nulls(len(hot), pa.int64())
        one = pa.table({"a": a, "b": b, "gather": none, "key": none, "blocks": pa.nulls(len(a), pa.int32())})
        two = pa.table({"a": empty, "b": empty, "gather": gather[by][hot], "key": keys[hot].view(np.int64), "blocks": (-(-total[hot] // settings.crowded)).astype(np.int32)})
        return pa.concat_tables([one, two])

    packed = _in_buckets(reps.select("node", "gather", "keys").mapInArrow(runtime.relieved(run), _PACKED), buckets)
    return packed.groupBy("bucket").applyInArrow(runtime.relieved(meet), _MET)


def _in_blocks(grid: np.ndarray, part: np.ndarray, owner: np.ndarray, nodes: np.ndarray, crowded: np.ndarray, blocks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, parts and owners, where each key of crowded (ascending) is replaced by one key for each other block of its
    bucket: a member has a block, and any two blocks share a key."""
    if not len(crowded):
        return grid, part, owner
    at = np.minimum(np.searchsorted(crowded, grid), len(crowded) - 1)
    many = crowded[at] == grid
    keys, parts, owners = [grid[~many]], [part[~many]], [owner[~many]]
    which, mine, n = grid[many], owner[many], blocks[at[many]].astype(np.uint64)
    own = runtime.mix(nodes[mine].astype(np.uint64) ^ which) % n if len(n) else n
    for j in range(int(n.max()) if len(n) else 0):
        there = np.flatnonzero((own != j) & (n > j))
        low, high = np.minimum(own[there], np.uint64(j)), np.maximum(own[there], np.uint64(j))
        keys.append(runtime.mix(which[there] ^ runtime.mix((low << np.uint64(32)) | high)))
        parts.append((keys[-1] % np.uint64(buckets)).astype(np.int64))
        owners.append(mine[there])
    return np.concatenate(keys), np.concatenate(parts), np.concatenate(owners)


def _all_paired(keys: np.ndarray, comps: np.ndarray, place: np.ndarray, sketches: _Sketches, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: distinct (later, earlier) places of nodes of one run, of different components, that may link."""
    start = _run_starts(keys)
    nth = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
    at, apart, out = np.flatnonzero(nth > 0), 1, []
    n = len(sketches.size)
    while len(at):
        some = at[comps[place[at]] != comps[place[at - apart]]]
        if len(some):
            two = np.unique(place[some] * n + place[some - apart])
            out.append(two[sketches.may_link(two // n, two % n, percent)])
        apart += 1
        at = at[nth[at] >= apart]
    both = np.unique(np.concatenate([np.empty(0, np.int64), *out]))
    return both // max(n, 1), both % max(n, 1)


def _settling(open_ones: DataFrame, crowded: DataFrame, settings: Settings, buckets: int) -> DataFrame:
    """(a, b), a > b: all pairs of nodes of different components that share a bucket and may link."""
    wide, fine = _dealt(buckets)
    buckets = wide * fine

    def dealt(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows:
            nodes, comps = left.column("node").to_numpy(), left.column("component").to_numpy()
            keys = np.frombuffer(b"".join(left.column("keys").to_pylist()), np.uint64).reshape(len(nodes), -1)
            grid, part = _grid(keys, settings.side).reshape(-1), _parts(keys, settings.side, buckets).reshape(-1)
            owner = np.repeat(np.arange(len(nodes)), settings.side**2)
            hot, first = np.unique(right.column("key").to_numpy().view(np.uint64), return_index=True)
            grid, part, owner = _in_blocks(grid, part, owner, nodes, hot, right.column("blocks").to_numpy()[first], buckets)
            rows = [_batch(r) for r in _first_dealing(0, grid, part, owner, nodes, wide, fine, comps=comps, marks=left.column("marks").to_pylist())]
        return pa.Table.from_batches(rows, _batch((0, 0, *[b""] * 9)).schema)

    def meet(table: pa.Table) -> pa.Table:
        keys, place, nodes, comps, sizes, _ = _unpacked(table, {"nodes": np.int64, "others": np.int64, "sizes": np.uint32})
        blob = b"".join(table.column("marks").to_pylist())
        ends = np.cumsum(sizes, dtype=np.int64)
        # a node that several rows hold has one place
        nodes, first, again = np.unique(nodes, return_index=True, return_inverse=True)
        marks, comps, place = [blob[i:j] for i, j in zip((ends - sizes)[first].tolist(), ends[first].tolist(), strict=True)], comps[first], again[place]
        by = np.lexsort((place, keys))
        keys, place = keys[by], place[by]
        # buckets of one component are settled
        start = _run_starts(keys)
        length, comp = np.diff(np.append(start, len(keys))), comps[place]
        odd = np.add.reduceat((np.repeat(comp[start], length) != comp).astype(np.int64), start) if len(start) else length
        apart = np.repeat(odd, length) > 0
        a, b = _all_paired(keys[apart], comps, place[apart], _Sketches(marks), settings.percent)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    packed = open_ones.select("gather", "node", "component", "keys", "marks").groupBy("gather").cogroup(crowded.groupBy("gather")).applyInArrow(runtime.relieved(dealt), _PACKED)
    return _in_buckets(packed, buckets).groupBy("bucket").applyInArrow(runtime.relieved(meet), "a long, b long").distinct()


def _sets(docs: DataFrame, pairs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingles) of the nodes in pairs, a written table. The join is the same at every size, so that a
    measurement on little data tells what more will take."""
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
    wanted = runtime.written(reps.select("node", "doc_id", "low", "high").join(nodes, "node", "left_semi"))

    def sets(batches):
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                hashes, first = shingles(part.column("text"), settings)
                blob = [hashes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
                both = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in blob), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(blob, pa.binary())], names=["doc_id", "low", "high", "shingles"])

    found = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(runtime.relieved(sets), "doc_id long, low long, high long, shingles binary")
    out = runtime.written(found.join(wanted, ["doc_id", "low", "high"]).select("node", "shingles").dropDuplicates(["node"]))
    runtime.dropped(wanted)
    return out


def _confirmed(pairs: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = pairs.select("a", "b").join(known.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(u), len(v)) < settings.percent * max(len(u), len(v)):
                    good.append(False)
                    continue
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= settings.percent * (len(u) + len(v) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(runtime.relieved(check), "a long, b long")


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the document's own without any. kept: doc_id = component_id.
    Null or wordless texts have no shingles and no links. A null doc_id has no links either, a null component_id and is
    kept. Rows that repeat a doc_id are one document with the links of all its texts. An empty table gives an empty
    result. Very long texts are hashed whole. Two texts have the same set if its 128-bit digest is the same."""
    spark = docs.sparkSession
    runtime.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = _digests(docs, settings).withColumn("node", F.monotonically_increasing_id())
    rows = runtime.written(rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")))
    linked = rows.filter("doc_id is not null and n_shingles > 0")
    # a set's rows are summed up in parts, so that a set with very many rows isn't gathered in one task
    parts = runtime.written(linked.groupBy("low", "high", "salt").agg(F.min("node").alias("node"), F.min("doc_id").alias("least")))
    classes = runtime.written(parts.groupBy("low", "high").agg(F.min("node").alias("node"), F.min("least").alias("least")))
    reps = linked.join(classes.select("node"), "node", "left_semi").select("node", "doc_id", "low", "high", "keys", "marks")
    reps = runtime.written(reps.withColumn("gather", F.shiftright(F.monotonically_increasing_id(), GATHERED.bit_length() - 1)))
    buckets = lambda n: max(1, -(-n * settings.side**2 // KEYS_A_TASK))
    met = runtime.written(_stars(reps, settings, buckets(classes.count())))
    pairs = runtime.written(met.filter("a is not null").select("a", "b").distinct())
    crowded = met.filter("key is not null").select("gather", "key", "blocks").distinct()
    # the second pass sees no node that the first one's pairs didn't have
    known = _sets(docs, pairs, reps, settings)
    several = linked.groupBy("doc_id").agg(F.min("low").alias("x"), F.max("low").alias("y"), F.min("high").alias("v"), F.max("high").alias("w")).filter("x <> y or v <> w")
    texts = linked.select("doc_id", "low", "high").join(several.select("doc_id"), "doc_id", "left_semi").join(classes, ["low", "high"]).select("doc_id", "node").distinct()
    one_document = texts.join(texts.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b")
    found = runtime.written(components(_confirmed(pairs, known, settings).unionByName(one_document)))
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias("c" + side))
    placed = lambda df: df.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    # the first pass's pairs connect each bucket's members: while it has several components, each is in such a pair
    apart = runtime.written(placed(pairs).filter("ca <> cb").select("ca", "cb").distinct())
    # written, as a component with very many nodes is then a skewed key that Spark can split
    open_comps = runtime.written(apart.select(F.col("ca").alias("component")).unionAll(apart.select("cb")).distinct())
    in_component = reps.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ones = runtime.written(in_component.join(open_comps, "component", "left_semi").select("node", "gather", "component", "keys", "marks"))
    late = _settling(open_ones, crowded, settings, buckets(open_ones.count())).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    late = runtime.written(late)
    confirmed = _confirmed(late, known, settings)
    joined = runtime.written(components(placed(confirmed).select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    final = classes.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    final = final.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c")).drop("c")
    final = runtime.written(final)
    # what is left to be done reads none of these
    runtime.dropped(reps, met, pairs, known, found, apart, open_comps, open_ones, late, joined, classes)
    first = runtime.written(final.groupBy("component").agg(F.min("least").alias("component_id")))
    parts = parts.select("low", "high", "salt").join(final.join(first, "component").select("low", "high", "component_id"), ["low", "high"])
    out = rows.select("doc_id", "n_shingles", "low", "high", "salt").join(parts, ["low", "high", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that groups() keeps, with docs' own columns."""
    found = groups(docs, settings).filter("not kept").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")
