"""Approximate nearest neighbours by cosine, with multi-index hashing of learned binary codes.

A rotation is learned that takes centred vectors as near as it can to the corners of a cube; the signs of a rotated
vector are its code. Vectors are kept in blocks, and each block has a table for each substring of the codes: the rows in
order of that substring. Of two codes within a Hamming radius at least one substring differs by no more than its share of
the radius, so the rows within it are all among those whose substring is that near (a ball larger than the table is
not enumerated: the table's entries are tested for being in it). They are confirmed on whole codes and ranked by their
vectors.

How far to look is learned too: for each cosine, the radius within which nearly all pairs of that cosine lie. A query looks
as far as its k-th best so far asks for, at first that of the sample. So the work follows the data: among near copies the
radius is small; where all vectors are about as far apart, most of a block has to be looked at, as any index would."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm import runtime, vectors

BITS = 64
#: Rows from which the rotation, the radii and first bounds are learned: those with the smallest hash of their id.
SAMPLE, PAIRED = 4096, 512
#: Turns of the rotation; share of a cosine's pairs that its radius must hold, and of how many pairs that is measured.
TURNS, HELD, LEAST_PAIRS = 30, 0.985, 100
COSINES = 40
#: Radius that every query begins with, and by how much it grows while fewer than k are found.
START, GROWTH = 6, 6
#: Vectors in a block, and bytes of them as doubles; queries in a block; vectors that a task is worth.
BLOCK, BLOCK_BYTES, QUERY_BLOCK, LEAST_CELL = 16_384, 16 << 20, 512, 1024


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lengths; a row whose squares are too large or small for doubles is scaled by its largest component."""
    with np.errstate(over="ignore", under="ignore"):
        norms = np.sqrt((rows * rows).sum(1))
    odd = (norms < 1e-140) | ~np.isfinite(norms)
    if odd.any():
        rows = rows.copy()
        rows[odd] /= np.abs(rows[odd]).max(1)[:, None]
        norms[odd] = np.sqrt((rows[odd] * rows[odd]).sum(1))
    return rows, norms


def _cosines(rows: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Summed row by row, so that equal rows have equal cosines wherever they stand."""
    return (rows * query).sum(1) / (norms * norm)


class Coder:
    """Codes of vectors, and radii by cosine. Learned from a sample's rows (ids, vectors)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bits: int = BITS):
        self.width = rows.shape[1]
        self.ids = ids
        rows, norms = _scaled(rows)
        self.units = rows / norms[:, None]
        self.mean = self.units.mean(0) if len(rows) else np.zeros(self.width)
        centred = self.units - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        random = np.random.default_rng(0)
        turned = []
        while sum(t.shape[1] for t in turned) < bits:
            flat = centred @ axes
            rotation = np.linalg.qr(random.standard_normal((flat.shape[1],) * 2))[0]
            for _ in range(TURNS):
                left, _, right = np.linalg.svd(np.where(flat @ rotation > 0, 1.0, -1.0).T @ flat)
                rotation = (left @ right).T
            turned.append(axes @ rotation)
        self.rotation = np.concatenate(turned, 1)[:, :bits]
        self.bits = bits
        codes = self.codes(self.units)
        cosine = self.units[:PAIRED] @ self.units.T
        apart = np.bitwise_count(codes[:PAIRED, None] ^ codes[None, :])
        other = ids[:PAIRED, None] != ids[None, :]
        cell = np.clip(((cosine + 1) * COSINES / 2).astype(np.int64), 0, COSINES - 1)
        radii, last = np.zeros(COSINES, np.int64), 0
        for c in range(COSINES - 1, -1, -1):
            mine = apart[other & (cell == c)]
            angle = np.arccos(2 * c / COSINES - 1) / np.pi  # the share of bits that differ at the cell's lower end
            far = np.quantile(mine, HELD, method="higher") if len(mine) >= LEAST_PAIRS else bits * angle + 2.2 * np.sqrt(bits * angle * (1 - angle))
            last = radii[c] = min(bits, max(last, int(np.ceil(far))))
        self.radii = radii

    def codes(self, units: np.ndarray) -> np.ndarray:
        signs = (units - self.mean) @ self.rotation > 0
        return np.packbits(signs, axis=1, bitorder="little").view("<u8").reshape(-1)

    def radius(self, cosine: float) -> int:
        """How far codes may be apart of vectors with this cosine or a larger one. Below -1: as far as any."""
        return int(self.radii[min(int((cosine + 1) * COSINES / 2), COSINES - 1)]) if cosine >= -1 else self.bits

    def bounds(self, ids: np.ndarray, units: np.ndarray, k: int) -> np.ndarray:
        """The k-th best cosine of each query in the sample, itself left out; -2 where the sample has fewer."""
        if len(self.ids) <= k:
            return np.full(len(ids), -2.0)
        cosine = np.where(ids[:, None] == self.ids[None, :], -2.0, units @ self.units.T)
        return np.partition(cosine, -k, axis=1)[:, -k]


def _balls(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of so many bits by how many are set, and for each radius how many are within it."""
    every = np.arange(1 << bits, dtype=np.uint64)
    weight = np.bitwise_count(every)
    return every[np.argsort(weight, kind="stable")], np.cumsum(np.bincount(weight, minlength=bits + 1))


def substrings(n: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of the substrings of codes for a table of n rows, about as wide as numbers of rows are."""
    parts = max(1, min(bits // 4, round(bits / max(4, min(16, int(np.log2(max(n, 2))))))))
    cuts = [i * bits // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def tables_of(codes: np.ndarray) -> np.ndarray:
    """For each substring the rows in order of it."""
    return np.stack([np.argsort((codes >> np.uint64(a)) & np.uint64((1 << w) - 1), kind="stable") for a, w in substrings(len(codes))]).astype("<i4")


class Block:
    """Vectors with their codes and a table for each substring."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, tables: np.ndarray):
        self.ids, self.codes = ids, codes
        self.rows, self.norms = _scaled(rows)
        self.tables = []
        for (shift, width), order in zip(substrings(len(codes)), tables, strict=True):
            values = (codes[order] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            starts = np.searchsorted(values, np.arange((1 << width) + 1, dtype=np.uint64))
            self.tables.append((shift, width, order, values, starts))

    def within(self, code: np.uint64, radius: int, balls: dict) -> np.ndarray:
        """All rows whose code differs in `radius` bits at most."""
        share, more = divmod(radius, len(self.tables))
        near = np.zeros(len(self.codes), bool)
        for j, (shift, width, order, values, starts) in enumerate(self.tables):
            reach = min(share if j <= more else share - 1, width)
            if reach < 0:
                continue
            mine = (code >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            if width not in balls:
                balls[width] = _balls(width)
            masks, sizes = balls[width]
            if sizes[reach] < len(order):
                probes = (masks[: sizes[reach]] ^ mine).astype(np.int64)
                begin, many = starts[probes], starts[probes + 1] - starts[probes]
                hit = np.flatnonzero(many)
                begin, many = begin[hit], many[hit]
                near[order[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]] = True
            else:
                near[order[np.bitwise_count(values ^ mine) <= reach]] = True
        rows = np.flatnonzero(near)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]

    def best(self, query_id: int, query: np.ndarray, norm: float, code: np.uint64, bound: float, coder: Coder, k: int, balls: dict) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k best rows found, at least k where the block has so many. The query's id is left out;
        of an id's rows the best counts."""
        radius = START
        while True:
            rows = self.within(code, radius, balls)
            rows = rows[self.ids[rows] != query_id]
            about = self.rows[rows] @ query / (self.norms[rows] * norm)
            # ids may repeat, so the k best rows may be fewer ids; then all rows found are ranked
            best = rows if len(rows) <= k else rows[about >= np.partition(about, -k)[-k] - 1e-9]
            for some in (best, rows):
                score = _cosines(self.rows[some], self.norms[some], query, norm)
                order = np.lexsort((self.ids[some], -score))
                ids, score = self.ids[some][order], score[order]
                lead = np.sort(np.unique(ids, return_index=True)[1])
                if len(lead) >= k or len(some) == len(rows):
                    break
            ids, score = ids[lead[:k]], score[lead[:k]]
            asked = coder.radius(max(bound, score[-1])) if len(ids) == k else max(coder.radius(bound), radius + GROWTH)
            if radius >= min(asked, coder.bits):
                return ids, score
            radius = min(asked, coder.bits)


class MultiIndex:
    """An index of all vectors of a table: the coder, and a written table of blocks in cells."""

    def __init__(self, coder: Coder | None, blocks: DataFrame | None, cells: int, kept_as: str = "<f8"):
        self.coder, self.blocks, self.cells, self.kept_as = coder, blocks, cells, kept_as

    @classmethod
    def build(cls, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> MultiIndex:
        """Index every row that has an id and a vector with some length.

        Left out: ids that are null; vectors that are null or empty, hold a null or non-finite component or only zeros, and
        vectors that aren't as long as most of the sample's (ties: the longer). The sample has at most so many rows."""
        spark = rows.sparkSession
        runtime.ship(spark)
        source = _counting(rows, key, vector)
        drawn = _sample(source, sample)
        if not drawn:
            return cls(None, None, 0)
        sizes = [len(r["v"]) for r in drawn]
        width = max(set(sizes), key=lambda n: (sizes.count(n), n))
        drawn = list({r["id"]: r for r in reversed(drawn) if len(r["v"]) == width}.values())
        coder = Coder(np.array([r["id"] for r in drawn], np.int64), np.array([r["v"] for r in drawn], np.float64))
        source = source.filter(F.size("v") == width)
        cells = max(1, min(2 * runtime.partitions(spark), -(-source.count() // LEAST_CELL)))
        kept_as = "<f4" if dict(rows.dtypes)[vector] == "array<float>" else "<f8"
        most = max(LEAST_CELL, min(BLOCK, BLOCK_BYTES // (8 * width)))

        def run(batches):
            from pyspark import TaskContext

            ids, parts, held = [], [], 0

            def block():
                nonlocal ids, parts, held
                mine, values = np.concatenate(ids), np.concatenate(parts)
                ids, parts, held = [mine[most:]], [values[most:]], max(0, held - most)
                mine, values = mine[:most], values[:most]
                scaled, norms = _scaled(values)
                codes = coder.codes(scaled / norms[:, None])
                row = [TaskContext.get().partitionId()], [mine.astype("<i8").tobytes()], [values.astype(kept_as).tobytes()], [codes.tobytes()], [tables_of(codes).tobytes()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["cell", "ids", "vectors", "codes", "tables"])

            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                parts.append(vectors.matrix(batch.column(1), width))
                held += len(batch)
                while held >= most:
                    yield block()
            if held:
                yield block()

        dealt = source.repartition(cells).mapInArrow(runtime.relieved(run), "cell int, ids binary, vectors binary, codes binary, tables binary")
        return cls(coder, runtime.written(dealt), cells, kept_as)

    def search(self, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): for each query the k nearest that were found, by cosine, then id.

        Rows of the query's own id are no candidates. With fewer than k candidates all are found. Queries that the index
        would leave out find nothing. Rows that repeat an id are one candidate, or one query, as near as the nearest of
        them."""
        spark = queries.sparkSession
        schema = "query_id long, vec_id long, score double"
        if self.coder is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        coder, kept_as = self.coder, self.kept_as
        source = _counting(queries, key, vector).filter(F.size("v") == coder.width)

        def coded(batches):
            for batch in batches:
                for at in range(0, len(batch), QUERY_BLOCK):
                    part = batch.slice(at, QUERY_BLOCK)
                    ids, (rows, norms) = part.column(0).to_numpy(), _scaled(vectors.matrix(part.column(1), coder.width))
                    units = rows / norms[:, None]
                    row = ids.astype("<i8"), rows.astype("<f8"), norms.astype("<f8"), coder.codes(units), coder.bounds(ids, units, k).astype("<f8")
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["q_ids", "q_rows", "q_norms", "q_codes", "q_bounds"])

        def best(batches):
            held, block, balls = None, None, {}
            for batch in batches:
                for i in range(len(batch)):
                    row = {n: batch.column(n)[i].as_py() for n in ("ids", "codes", "q_ids", "q_rows", "q_norms", "q_codes", "q_bounds")}
                    if held != (row["ids"], row["codes"]):
                        held, ids = (row["ids"], row["codes"]), np.frombuffer(row["ids"], "<i8")
                        values = np.frombuffer(batch.column("vectors")[i].as_py(), kept_as)
                        tables = np.frombuffer(batch.column("tables")[i].as_py(), "<i4").reshape(-1, len(ids))
                        block = Block(ids, values.astype(np.float64).reshape(len(ids), -1), np.frombuffer(row["codes"], "<u8"), tables)
                    asked = np.frombuffer(row["q_ids"], "<i8")
                    rows, norms = np.frombuffer(row["q_rows"], "<f8").reshape(len(asked), -1), np.frombuffer(row["q_norms"], "<f8")
                    codes, bounds = np.frombuffer(row["q_codes"], "<u8"), np.frombuffer(row["q_bounds"], "<f8")
                    found = [block.best(*q, coder, k, balls) for q in zip(asked.tolist(), rows, norms, codes, bounds, strict=True)]
                    many = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, many)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

        blocks = source.repartition(max(1, min(runtime.partitions(spark), -(-source.count() // QUERY_BLOCK)))).mapInArrow(runtime.relieved(coded), "q_ids binary, q_rows binary, q_norms binary, q_codes binary, q_bounds binary")
        asked = runtime.written(blocks).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1))))
        # dealt by cell: the queries of all cells together are many times their table, so they must not go to all tasks
        found = self.blocks.join(asked.hint("merge"), "cell").mapInArrow(runtime.relieved(best), schema)
        # a query's rows meet once: both an id's best row and the ranks are made where they are
        found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(source: DataFrame, most: int) -> list:
    """The rows with the smallest hash of their id, at most so many. Each task tells the driver hashes only; the rows
    within the last of them are put in order by a task, and no more than are asked for reach the driver."""
    h = F.xxhash64("id")
    last = source.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]
    if last is None:
        return []
    first = runtime.written(source.filter(h <= last).orderBy(h, "id", "v").limit(most))
    drawn = first.orderBy(h, "id", "v").collect()
    runtime.dropped(first)
    return drawn


def _counting(rows: DataFrame, key: str, vector: str) -> DataFrame:
    source = rows.select(F.col(key).cast("long").alias("id"), vectors.as_doubles(vector).alias("v")).filter("id is not null")
    return source.filter(vectors.usable(F.col("v"))).filter(F.exists("v", lambda x: x != 0))
