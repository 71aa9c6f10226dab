"""Token ids in word-aligned files: Simple-8b with escapes and per-block offsets.

Format. A shard is what one task writes: rows of (shard, part, first, n_ids, doc_ids, doc_lengths, word_offsets, words).
A row holds the ids of whole documents in order; `first` counts the shard's ids before it. The ids are cut into blocks
of BLOCK; word_offsets (little-endian unsigned 32-bit) says where each block's 64-bit words start. A word's top four
bits are its selector: 0..13 pack so many ids of so many bits as LAYOUTS says, from the low bits up; ESCAPE means that
the next word is one id as it is. A block's last word may have unused places, which are 0. The rows are kept in Parquet
files, whose commit protocol makes a task's retry harmless."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import runtime
from docquarry.llm.pieces import library_encoder

#: (ids in a word, bits each), by selector.
LAYOUTS = [(60 // b if b else 60, b) for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)]
ESCAPE = 15
BLOCK = 256
_COUNT = np.array([c for c, _ in LAYOUTS] + [0, 1], np.int64)
_REACH = 60


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids and where each block's words start (one more than blocks)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint32)
    grid = np.zeros((blocks, BLOCK + _REACH), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    length = np.full(blocks, BLOCK)
    length[-1] = len(ids) - BLOCK * (blocks - 1)
    width = np.zeros(grid.shape, np.uint8)
    for _, bits in LAYOUTS:
        width += (grid >= np.uint64(1 << bits)).astype(np.uint8)  # the index of the narrowest layout that holds the id
    # widest id among the next so many, and from it the layout with most ids that fits
    best = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    widest, have = width.copy(), 1
    for selector in range(len(LAYOUTS) - 1, -1, -1):
        count = LAYOUTS[selector][0]
        while have < count:
            by = min(have, count - have)
            widest[:, : widest.shape[1] - by] = np.maximum(widest[:, : widest.shape[1] - by], widest[:, by:])
            have += by
        best[widest[:, :BLOCK] <= selector] = selector
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    rows, places, selectors = [], [], []
    while len(live):
        place = at[live]
        selector = best[live, place]
        rows.append(live)
        places.append(place)
        selectors.append(selector)
        at[live] = place + _COUNT[selector]
        live = live[at[live] < length[live]]
    row, place, selector = np.concatenate(rows), np.concatenate(places), np.concatenate(selectors)
    order = np.lexsort((place, row))
    row, place, selector = row[order], place[order], selector[order]
    size = np.where(selector == ESCAPE, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k, (count, bits) in enumerate(LAYOUTS):
        mine = np.flatnonzero(selector == k)
        if len(mine):
            word = np.full(len(mine), k << 60, np.uint64)
            for j in range(count):
                word |= grid[row[mine], place[mine] + j] << np.uint64(bits * j)
            words[where[mine]] = word
    raw = np.flatnonzero(selector == ESCAPE)
    words[where[raw]] = np.uint64(ESCAPE << 60)
    words[where[raw] + 1] = grid[row[raw], place[raw]]
    offsets = np.zeros(blocks + 1, np.uint32)
    offsets[1:] = np.cumsum(np.bincount(row, size, blocks)).astype(np.uint32)
    return words, offsets


def decode_words(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids that encode_words was given."""
    blocks = len(offsets) - 1
    if n == 0:
        return np.empty(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, _COUNT[selector])
    block = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    before = np.cumsum(count) - count
    place = before - before[offsets[:-1].astype(np.int64)][block]
    grid = np.zeros((blocks, BLOCK + _REACH), np.uint64)
    for k, (many, bits) in enumerate(LAYOUTS):
        mine = np.flatnonzero((selector == k) & ~raw)
        if len(mine):
            mask = np.uint64((1 << bits) - 1)
            for j in range(many):
                grid[block[mine], place[mine] + j] = (words[mine] >> np.uint64(bits * j)) & mask
    lone = np.flatnonzero((selector == ESCAPE) & ~raw)
    grid[block[lone], place[lone]] = words[lone + 1]
    return grid[:, :BLOCK].reshape(-1)[:n]


_FILE = "shard int, part long, first long, n_ids long, doc_ids array<long>, doc_lengths array<long>, word_offsets binary, words binary"
_FILE_ARROW = runtime.arrow_schema([("shard", pa.int32()), ("part", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("word_offsets", pa.binary()), ("words", pa.binary())])


def write_tokens(docs: DataFrame, path: str, end_id: int, out: str, parts: int | None = None) -> None:
    """Encode every whole text with the tokenizers file at `path`, add `end_id`, and write shards to the folder `out`.

    Documents are in ascending doc_id order over the shards (null first; rows that repeat a doc_id by their text). A
    null or empty text is `end_id` alone. Columns other than doc_id and text are left out. An empty table gives a
    readable folder without rows."""
    runtime.ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        shard, part_no, first = TaskContext.get().partitionId(), 0, 0
        encoder = library_encoder(path, words=True)
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                found = [ids + end for ids in encoder(part.column("text"))]
                lengths = [len(x) // 4 for x in found]
                ids = np.frombuffer(b"".join(found), "<u4")
                words, offsets = encode_words(ids)
                row = [shard], [part_no], [first], [len(ids)], [part.column("doc_id").to_pylist()], [lengths], [offsets.astype("<u4").tobytes()], [words.astype("<u8").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _FILE_ARROW, strict=True)], schema=_FILE_ARROW)
                part_no += 1
                first += len(ids)

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = source.repartitionByRange(parts or runtime.partitions(docs.sparkSession), "doc_id")
    dealt.sortWithinPartitions("doc_id", "text").mapInArrow(runtime.relieved(run), _FILE).write.parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """Rows (doc_id, start, ids) of a folder that write_tokens made; start: the ids of all documents before.

    The driver learns one number for each shard."""
    runtime.ship(spark)
    table = spark.read.schema(_FILE).parquet(out)
    sizes = {r["shard"]: r["n"] for r in table.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    begins, total = {}, 0
    for shard in sorted(sizes):
        begins[shard] = total
        total += sizes[shard]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["doc_lengths"], np.int64)
                ids = decode_words(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["word_offsets"], "<u4"), row["n_ids"]).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                base = begins[row["shard"]] + row["first"]
                cut = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(base + ends - lengths, pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "start", "ids"])

    return table.mapInArrow(runtime.relieved(run), "doc_id long, start long, ids binary")
