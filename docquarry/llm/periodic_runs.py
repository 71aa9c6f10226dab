"""Periodic runs of words, found in a suffix tree of each text.

Words are numbered, suffixes sorted by doubling, and the tree of what neighbours share read off their common lengths. Two
suffixes that part in a node of depth D and start D words apart are a branching tandem repeat: the same D words twice, and
then something else. Each node is asked for such pairs from the leaves of all its children but the largest, so a leaf is
asked for at most log n times. The repeats with a run's period stand at its end; rotated to the left for as long as words
D apart are equal, they give its start. What is a repeat of a shorter period there is dropped, and each run is left once.

All texts of a step are in one array and one forest of trees: words of different texts never count as equal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import runtime

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Leaves that are asked for partners at once.
ASKED = 2_000_000


class Suffixes:
    """Suffixes of many sequences in order, with what neighbours have in common.

    levels[k] has for each place a number that is equal for two places if, and only if, 2^k symbols from there on are
    equal and in the same sequence; one more entry, -1, stands for what is outside."""

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        """codes: the symbols of all sequences, one after another; first: where each starts, and the end."""
        n = len(codes)
        owner = runtime.owners(first)
        end = np.repeat(first[1:], np.diff(first))
        key = owner * (int(codes.max()) + 1 if n else 1) + codes
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.levels, step = [rank.astype(np.int32)], 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        while len(slots):
            places = order[slots]
            then = places + step
            follow = np.where(then < end[places], rank[np.minimum(then, n)], -1)
            pair = rank[places] * (n + 1) + follow + 1
            by = np.argsort(pair, kind="stable")
            places, pair = places[by], pair[by]
            order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = pair[1:] != pair[:-1]
            rank[places] = np.maximum.accumulate(np.where(new, slots, 0))
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = slots[tied]
            step *= 2
            if len(slots):
                self.levels.append(rank.astype(np.int32))
        self.n, self.order, self.rank = n, order, rank

    def shared(self) -> np.ndarray:
        """For each place in order how long a start its suffix shares with the one before; 0 at both ends."""
        out = np.zeros(self.n + 1, np.int64)
        a, b = self.order[:-1], self.order[1:]
        same = np.flatnonzero(self.levels[0][a] == self.levels[0][b]) if self.n else np.empty(0, np.int64)
        a, b = a[same], b[same]
        length = np.zeros(len(same), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            length += (level[np.minimum(a + length, self.n)] == level[np.minimum(b + length, self.n)]).astype(np.int64) << k
        out[same + 1] = length
        return out

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before places a are the same as those before places b, which are other places."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            x, y = a - length - (1 << k), b - length - (1 << k)
            fits = (x >= 0) & (y >= 0)
            fits &= level[np.where(fits, x, self.n)] == level[np.where(fits, y, self.n)]
            length += fits.astype(np.int64) << k
        return length


def _nearest_smaller(values: np.ndarray, active: np.ndarray, step: int) -> np.ndarray:
    """For each active place the nearest one to the left (step -1) or right (1) with a smaller value. values[0] and the
    last are smaller than any active one. All between a place and where it points at any time is as large as its own."""
    to = np.arange(len(values)) + step
    while len(active):
        active = active[values[to[active]] >= values[active]]
        to[active] = to[to[active]]
    return to


class Tree:
    """Inner nodes of the suffix tree: begin and end in the order of suffixes, depth; and their children but the largest."""

    def __init__(self, shared: np.ndarray):
        edges = np.flatnonzero(shared > 0)
        left, right = _nearest_smaller(shared, edges, -1)[edges], _nearest_smaller(shared, edges, 1)[edges]
        by = np.argsort(left * len(shared) + right, kind="stable")
        edges, left, right = edges[by], left[by], right[by]
        opens = np.ones(len(edges), bool)
        opens[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        heads = np.flatnonzero(opens)
        node = np.cumsum(opens) - 1
        self.begin, self.end, self.depth = left[heads], right[heads], shared[edges[heads]]
        closes = np.append(heads[1:], len(edges))[: len(heads)] - 1
        # a child before each edge of its node, and one after the last
        begin = np.concatenate([np.where(opens, left, np.concatenate([[0], edges[:-1]]) if len(edges) else edges), edges[closes]])
        end = np.concatenate([edges, self.end])
        node = np.concatenate([node, np.arange(len(heads))])
        by = np.lexsort((begin - end, node))  # the largest first
        largest = by[np.searchsorted(node[by], np.arange(len(heads)))]
        small = np.ones(len(begin), bool)
        small[largest] = False
        self.large_begin, self.large_end = begin[largest], end[largest]
        self.child_begin, self.child_end, self.child_node = begin[small], end[small], node[small]


def branching_repeats(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of all branching tandem repeats."""
    tree = Tree(suffixes.shared())
    sizes = tree.child_end - tree.child_begin
    sums = np.concatenate([[0], np.cumsum(sizes)])
    places, periods, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sums, sums[at] + ASKED, "right")) - 1)
        child = np.repeat(np.arange(at, to), sizes[at:to])
        node = tree.child_node[child]
        leaf = suffixes.order[tree.child_begin[child] + np.arange(len(child)) - (sums[child] - sums[at])]
        depth = tree.depth[node]
        after = suffixes.rank[np.minimum(leaf + depth, suffixes.n)]
        good = (after >= tree.begin[node]) & (after < tree.end[node]) & ((after < tree.child_begin[child]) | (after >= tree.child_end[child]))
        # from a partner in another small child the same pair is found as that child's
        before = suffixes.rank[np.where(leaf >= depth, leaf - depth, suffixes.n)]
        other = (before >= tree.large_begin[node]) & (before < tree.large_end[node])
        places += [leaf[good], (leaf - depth)[other]]
        periods += [depth[good], depth[other]]
        at = to
    return np.concatenate(places), np.concatenate(periods)


def runs(codes: np.ndarray, first: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (among all symbols), ends and smallest periods of the maximal runs with so many symbols and periods at
    least, in order of start, then period."""
    none = np.empty(0, np.int64)
    if not len(codes):
        return none, none, none
    suffixes = Suffixes(codes, first)
    place, period = branching_repeats(suffixes)
    end = place + 2 * period
    by = np.lexsort((period, end))
    place, period, end = place[by], period[by], end[by]
    found = []
    while len(place):
        # the shortest period of each end is a run's; longer ones that are its multiples within the run are no other
        lead = np.ones(len(end), bool)
        lead[1:] = end[1:] != end[:-1]
        p, q, e = place[lead], period[lead], end[lead]
        start = p - suffixes.shared_before(p, p + q)
        found.append((start, e, q))
        mine = np.cumsum(lead) - 1
        left = ~lead & ~((period % q[mine] == 0) & (place >= start[mine]))
        place, period, end = place[left], period[left], end[left]
    if not found:
        return none, none, none
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    fits = end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[fits], end[fits], period[fits]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _joined(data: np.ndarray, sizes: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by single spaces. data: the words' bytes without what was between them."""
    kept = np.flatnonzero(keep)
    upto = np.concatenate([[0], np.cumsum(keep)])[first]  # kept words before each text
    widths = sizes[kept] + 1
    widths[upto[1:][np.diff(upto) > 0] - 1] -= 1  # none after a text's last
    ends = np.cumsum(widths)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[(ends - 1)[widths > sizes[kept]]] = False
    out[letters] = data[np.repeat(keep, sizes)]
    offsets = np.concatenate([[0], ends])[upto]
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(out)]).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapsed(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, name: str = "runs") -> DataFrame:
    """docs with `runs` and with texts in which each run is cut down to its first period.

    Words are what stands between spaces and \\t..\\r of the whole text. A run is a stretch of words of which those
    `period` apart are equal, for no smaller period, that neither neighbour extends; it counts from so many words and so
    many periods on. `runs` lists (start, length, period), by start, then period; start is a word's number from 0. The
    new text has the words that no run has after its first period, joined by single spaces.

    A null or empty text has no runs and becomes empty. Repeated rows and null ids are rows as others; all other columns
    stay as they are, one named as the new one is replaced. A text is handled whole in one task, in memory of a few dozen
    bytes for each word and doubling of its longest repeat."""
    runtime.ship(docs.sparkSession)
    source = docs.drop(name).withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            where = batch.schema.names.index("text")
            for part in runtime.steps(batch, where):
                data, offsets = runtime.utf8(part.column(where))
                begins, ends, first = runtime.word_bounds(data, offsets)
                sizes = ends - begins
                inner = np.zeros(len(data) + 1, np.int8)
                inner[begins] += 1
                inner[ends] -= 1
                words = data[np.cumsum(inner[:-1], dtype=np.int8) > 0]
                upto = np.concatenate([[0], np.cumsum(sizes)])
                codes = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(upto.astype("<i8")), pa.py_buffer(words)]).dictionary_encode().indices.to_numpy()
                start, end, period = runs(codes.astype(np.int64), first, least_length, least_exponent)
                covered = np.zeros(len(sizes) + 1, np.int32)
                np.add.at(covered, start + period, 1)
                np.add.at(covered, end, -1)
                texts = _joined(words, sizes, np.cumsum(covered[:-1]) == 0, first)
                owner = np.searchsorted(first, start, "right") - 1
                listed = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(end - start), pa.array(period)], fields=list(_RUN))
                per_text = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32()), listed)
                columns = [texts if i == where else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays([*columns, per_text], names=[*part.schema.names, name])

    kind = T.ArrayType(T.StructType([T.StructField(f.name, T.LongType()) for f in _RUN]))
    return source.mapInArrow(runtime.relieved(run), T.StructType([*source.schema.fields, T.StructField(name, kind)]))
