"""Product codes of vectors, learned in whole numbers, with entries found by annular norm pruning.

A vector is scaled, floored and cut into parts; each part position has a codebook of entries. A codebook is kept in order
of norm. By the triangle inequality no entry is nearer than the difference of norms, so once some distance is known, only
entries whose norm differs by no more can be as near: a binary search finds that interval, and those alone are measured,
exactly. The interval has its ends, so an entry that ties is measured too.

Learning shuffles one sum for each entry and task; all that reaches the driver are the codebooks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import runtime, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of this size and more have no exact squares in 64 bits; the limit is on vectors, before they are scaled.
MOST = float(1 << 20)
#: Parts that are measured at once.
STEP = 8192
#: A label with so small a share of all rows isn't hot; so there are at most this many hot ones.
HOT_LABELS = 1000


class Annuli:
    """A codebook in order of norm."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def _distance(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((points - self.entries[at]) ** 2).sum(1)

    def intervals(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point the first and last (excluded) entry, by norm, that may be as near as those next to it by norm."""
        norm = np.sqrt((points.astype(np.float64) ** 2).sum(1))
        above = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        best = np.minimum(self._distance(points, above), self._distance(points, np.maximum(above - 1, 0)))
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-9 * norm + 1e-6  # wider than any rounding
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, ties to the smaller number, and its squared distance."""
        begin, end = self.intervals(points)
        sizes = end - begin
        heads = np.cumsum(sizes) - sizes
        point = np.repeat(np.arange(len(points)), sizes)
        at = begin[point] + np.arange(len(point)) - heads[point]
        distance = self._distance(points[point], at)
        least = np.minimum.reduceat(distance, heads)
        entry = np.where(distance == least[point], self.order[at], len(self.order))
        return np.minimum.reduceat(entry, heads), least


class Codebooks:
    """Entries of each part position."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.bounds = np.cumsum([0, *(e.shape[1] for e in entries)])

    @property
    def width(self) -> int:
        return int(self.bounds[-1])

    def assigned(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts): the nearest entry of each part, and its squared distance."""
        codes = np.zeros((len(points), len(self.entries)), np.int64)
        distances = np.zeros(codes.shape, np.int64)
        for part, entries in enumerate(self.entries):
            if not entries.shape[1]:
                continue
            annuli, mine = Annuli(entries), points[:, self.bounds[part] : self.bounds[part + 1]]
            for at in range(0, len(points), STEP):
                codes[at : at + STEP, part], distances[at : at + STEP, part] = annuli.nearest(mine[at : at + STEP])
        return codes, distances

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place in the part, as decimal numbers between commas."""
        return hashlib.sha256(",".join(str(c) for e in self.entries for c in e.reshape(-1).tolist()).encode()).hexdigest()


_LABEL, _POINT = "label", "point"


def prepared(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """A table (vec_id, label, point) of the rows whose vector counts, as floored multiples of 1 / scale (32-bit, packed).

    Left out: vectors that are null, have a null or non-finite component or one of MOST or more, and vectors of another
    length than that of the row with the smallest id (null ids come last, equal ids by their vector)."""
    runtime.ship(rows.sparkSession)
    source = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias(_LABEL), vectors.as_doubles(vector).alias(_POINT))
    source = source.filter(vectors.usable(F.col(_POINT), MOST))
    first = source.orderBy(F.asc_nulls_last("vec_id"), _POINT).limit(1).select(F.size(_POINT).alias("n")).first()
    width = first["n"] if first else 0

    def run(batches):
        for batch in batches:
            values = np.floor(scale * vectors.matrix(batch.column(2), width)).astype("<i4")
            packed = pa.array([row.tobytes() for row in values], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["vec_id", _LABEL, _POINT])

    schema = T.StructType([source.schema["vec_id"], source.schema[_LABEL], T.StructField(_POINT, T.BinaryType())])
    return runtime.written(source.filter(F.size(_POINT) == width).mapInArrow(runtime.relieved(run), schema))


def _points(column: pa.Array) -> np.ndarray:
    data, offsets = runtime.utf8(column)
    return np.ascontiguousarray(data).view("<i4").reshape(len(offsets) - 1, -1).astype(np.int64) if len(data) else np.zeros((len(offsets) - 1, 0), np.int64)


def learn(points: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a table that prepared() made: the parts of the first `entries` rows by id, moved `rounds` times to
    the floored means of what is nearest to them. Entries that nothing is nearest to stay. With fewer rows there are
    fewer entries; without rows, none."""
    seeds = [np.frombuffer(r[_POINT], "<i4").astype(np.int64) for r in points.orderBy(F.asc_nulls_last("vec_id"), _POINT).limit(entries).select(_POINT).collect()]
    width = len(seeds[0]) if seeds else 0
    cuts = [i * width // parts for i in range(parts + 1)]
    books = Codebooks([np.stack([s[a:b] for s in seeds]) if seeds else np.zeros((0, 0), np.int64) for a, b in zip(cuts, cuts[1:])])
    for _ in range(rounds if seeds else 0):
        now = books  # what this round's tasks get

        def run(batches, now=now):
            counts = [np.zeros(len(e), np.int64) for e in now.entries]
            sums = [np.zeros(e.shape, np.int64) for e in now.entries]
            for batch in batches:
                mine = _points(batch.column(0))
                codes, _ = now.assigned(mine)
                for part in range(len(sums)):
                    counts[part] += np.bincount(codes[:, part], minlength=len(counts[part]))
                    np.add.at(sums[part], codes[:, part], mine[:, now.bounds[part] : now.bounds[part + 1]])
            rows = [(part, e, int(counts[part][e]), sums[part][e].tolist()) for part in range(len(sums)) for e in np.flatnonzero(counts[part]).tolist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["part", "entry", "n", "sums"])

        found = points.select(_POINT).mapInArrow(runtime.relieved(run), "part int, entry int, n long, sums array<long>")
        sums = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "value")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        moved = [e.copy() for e in books.entries]
        for r in sums.collect():  # as many as the codebooks have components
            moved[r["part"]][r["entry"], r["place"]] = r["value"] // r["n"]
        books = Codebooks(moved)
    return books


def encode(points: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, code, error) of a table that prepared() made: the numbers of the nearest entries by part, as
    hex digits, and the sum of their squared distances."""
    runtime.ship(points.sparkSession)
    digits = [max(2, math.ceil(math.log2(max(len(e), 2)) / 4)) for e in books.entries]

    def run(batches):
        for batch in batches:
            codes, distances = books.assigned(_points(batch.column(2)))
            text = ["".join(f"{c:0{d}x}" for c, d in zip(row, digits, strict=True)) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(distances.sum(1))], names=["vec_id", _LABEL, "code", "error"])

    schema = T.StructType([points.schema["vec_id"], points.schema[_LABEL], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return points.mapInArrow(runtime.relieved(run), schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Rows of encode() with `label_error`, the sum of errors over equal labels; null is a label.

    A hot label would be one task's in a join. There are at most HOT_LABELS of them, whose sums go to all tasks; the rest
    are joined by label."""
    coded = runtime.written(coded)
    sums = coded.groupBy(_LABEL).agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")).withColumnRenamed(_LABEL, "__label")
    sums = runtime.written(sums)
    hot = F.col("__n") * HOT_LABELS > coded.count()
    same = F.col(_LABEL).eqNullSafe(F.col("__label"))
    often, seldom = F.broadcast(sums.filter(hot)), sums.filter(~hot)
    parts = [coded.join(often, same), coded.join(often, same, "left_anti").join(seldom, same)]
    return parts[0].select(*coded.columns, "label_error").unionByName(parts[1].select(*coded.columns, "label_error"))
