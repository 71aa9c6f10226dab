"""Bounded-space online packing of token sequences into windows of a fixed size.

Each task keeps a fixed number of open windows. A document's full windows are cut off first; what remains goes where
it fits best. If it fits nowhere, the fullest window is topped up with a cut of it (if the gap is worth a cut) and
emitted, and the rest goes on. The windows still open at a task's end are merged by groups of tasks in the same way."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import runtime
from docquarry.llm.pieces import library_encoder

SIZE, OPEN, LEAST_CUT, TASKS_MERGED = 1024, 64, 16, 32

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, merge_group long"
_ARROW = runtime.arrow_schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("merge_group", pa.int64())])


class Packer:
    """Windows in the making. put() takes (doc, start, ids as bytes, the document's tokens); emitted rows gather in done."""

    def __init__(self, first_id: int, size: int = SIZE, room: int = OPEN, least_cut: int = LEAST_CUT, keep_ids: bool = True):
        self.size, self.room, self.least_cut, self.next_id, self.keep_ids = size, room, least_cut, first_id, keep_ids
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.windows: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []
        self.made = 0

    def _emit(self, pieces: list[tuple]) -> None:
        at, sequence = 0, self.next_id
        self.next_id += 1
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, ids if self.keep_ids else None, None))
            at += len(ids) // 4

    def put(self, doc, start: int, ids: bytes, total: int) -> None:
        n, at, width = len(ids) // 4, 0, self.size
        while n - at >= width:
            self._emit([(doc, start + at, ids[4 * at : 4 * (at + width)], total)])
            at += width
        while at < n:
            need = n - at
            k = bisect_left(self.free, (need, -1))
            if k == len(self.free) and len(self.free) >= self.room:  # none fits and no more may be open: the fullest goes
                gap, window = self.free.pop(0)
                pieces = self.windows.pop(window)
                if gap >= self.least_cut:
                    pieces.append((doc, start + at, ids[4 * at : 4 * (at + gap)], total))
                    at += gap
                self._emit(pieces)
                continue
            if k < len(self.free):
                gap, window = self.free.pop(k)
            else:
                gap, window = width, self.made
                self.made += 1
                self.windows[window] = []
            self.windows[window].append((doc, start + at, ids[4 * at :], total))
            at = n
            if gap == need:
                self._emit(self.windows.pop(window))
            else:
                insort(self.free, (gap - need, window))

    def leftovers(self) -> list[list[tuple]]:
        """The open windows, fullest first; none is open afterwards."""
        out = [self.windows[w] for _, w in self.free]
        self.free, self.windows = [], {}
        return out

    def close(self) -> None:
        """Emit what is open, cut so that one window at most isn't full."""
        pieces: list[tuple] = []
        held = 0
        for window in self.leftovers():
            for doc, start, ids, total in window:
                at, n = 0, len(ids) // 4
                while at < n:
                    take = min(n - at, self.size - held)
                    pieces.append((doc, start + at, ids[4 * at : 4 * (at + take)], total))
                    at += take
                    held += take
                    if held == self.size:
                        self._emit(pieces)
                        pieces, held = [], 0
        if pieces:
            self._emit(pieces)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents, packed.

    A document's ids are those of the tokenizers library for the file at `path`, then `end_id`; a null or empty text is
    `end_id` alone. Each id is in exactly one piece; a sequence's pieces have gapless offsets from 0. A null doc_id
    stays null; rows that repeat a doc_id are packed each by itself. An empty table gives no pieces. `ids` holds the
    piece's ids (null without keep_ids), so that windows can be built by ordering a sequence's pieces by offset.
    Columns other than doc_id and text are dropped, whatever their names.

    Sequence ids are unique, not dense: the task's number, then a count. The windows left open by a group of tasks meet
    in one task, at most OPEN for each of TASKS_MERGED tasks, whatever the input's size."""
    spark = docs.sparkSession
    runtime.ship(spark)
    end = np.array([end_id], "<u4").tobytes()

    def first_pass(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packer = Packer(task << 33, size, keep_ids=keep_ids)
        encoder = library_encoder(path, words=False)
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                for key, ids in zip(part.column("doc_id").to_pylist(), encoder(part.column("text")), strict=True):
                    ids += end
                    packer.put(key, 0, ids, len(ids) // 4)
                yield _rows(packer.done)
                packer.done = []
        group = task // TASKS_MERGED
        yield _rows([(d, s, len(ids) // 4, None, total, None, None, ids, group) for window in packer.leftovers() for d, s, ids, total in window])

    def merge(table: pa.Table) -> pa.Table:
        group = table.column("merge_group")[0].as_py()
        packer = Packer((1 << 62) | (group << 33), size, keep_ids=keep_ids)
        for d, s, ids, total in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.put(d, s, ids, total)
        packer.close()
        return pa.Table.from_batches([_rows(packer.done)])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = runtime.written(source.mapInArrow(runtime.relieved(first_pass), _PIECES))
    open_ones = first.filter("merge_group is not null").groupBy("merge_group").applyInArrow(runtime.relieved(merge), _PIECES)
    return first.filter("merge_group is null").unionByName(open_ones).drop("merge_group")
