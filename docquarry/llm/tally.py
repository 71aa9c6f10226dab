"""Counting keys of a corpus: each task sums its own, in bounded memory, before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import runtime

#: Distinct keys that a task holds before it hands on its sums.
HELD = 1_000_000


class Tally:
    """Sums by 64-bit key, held as sorted arrays; parts are merged when they outgrow what is merged."""

    def __init__(self):
        self.keys, self.sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            distinct, n = np.unique(keys, return_counts=True)
            self.parts.append((distinct, n.astype(np.int64)))
            self.waiting += len(distinct)
            if self.waiting > max(200_000, len(self.keys)):
                self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.parts)])
        sums = np.concatenate([self.sums, *(n for _, n in self.parts)])
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, sums = keys[first], np.add.reduceat(sums, first)
        self.keys, self.sums, self.parts, self.waiting = keys, sums, [], 0

    def taken(self, name: str | None) -> pa.RecordBatch:
        self.merge()
        out = pa.RecordBatch.from_arrays([pa.array([name] * len(self.keys), pa.string()), pa.array(self.keys.view(np.int64)), pa.array(self.sums)], names=["name", "key", "n"])
        self.keys, self.sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        return out


def counted(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[str, np.ndarray]]], step: int = runtime.STEP_BYTES) -> DataFrame:
    """(name, key, n): how often each key occurs under a name in all of df (which has `text`). keys_of gives names and
    keys of a slice of rows of about `step` bytes of text, in any order and as often as it likes."""
    runtime.ship(df.sparkSession)

    def run(batches):
        tallies: dict[str, Tally] = {}
        for batch in batches:
            for part in runtime.steps(batch, "text", step):
                for name, keys in keys_of(part):
                    tallies.setdefault(name, Tally()).add(keys)
                if sum(len(t.keys) + t.waiting for t in tallies.values()) > HELD:
                    for name, tally in tallies.items():
                        yield tally.taken(name)
                    tallies = {}
        for name, tally in tallies.items():
            yield tally.taken(name)

    return df.mapInArrow(runtime.relieved(run), "name string, key long, n long").groupBy("name", "key").agg(F.sum("n").alias("n"))


def by_name(names: list[str | None], values: np.ndarray, first: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Each name with the values of the texts that have it; first: where each text's values begin."""
    number: dict[str, int] = {}
    marks = np.array([number.setdefault(n, len(number)) for n in names], np.int64)
    if len(number) == 1:
        yield names[0], values
        return
    own = np.repeat(marks, np.diff(first))
    for name, i in number.items():
        yield name, values[own == i]
