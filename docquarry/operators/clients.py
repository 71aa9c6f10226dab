"""Clients of models that answer prompts: rows in, answers with what they took out, in the tasks that hold the rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.sources import storage

#: Times a prompt is asked while the model is busy, and seconds before the second time (twice as many before the third).
ATTEMPTS, PAUSE = 3, 2.0


class Busy(Exception):
    """The model can't answer now and may later (too many requests, a gateway's error)."""


class Client(Protocol):
    """What a model must offer. A client is sent to the tasks, so it opens its connections when it is first asked."""

    name: str

    def available(self) -> bool: ...

    def generate(self, prompt: str) -> tuple[str, int]:
        """The answer, and of how many tokens it is (0 if the model doesn't say)."""
        ...


_NEW = [T.StructField(n, t) for n, t in (("answer", T.StringType()), ("model", T.StringType()), ("latency_ms", T.DoubleType()), ("eval_count", T.LongType()), ("tokens_per_second", T.DoubleType()), ("attempts", T.IntegerType()), ("error", T.StringType()))]


def generated(rows: DataFrame, client: Client, prompt: str = "prompt", fallback: Column | None = None, pause: float = PAUSE, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """rows with `answer`, `model`, `latency_ms`, `eval_count`, `tokens_per_second`, `attempts` and `error`; columns with
    these names are replaced.

    A busy model is asked again, ATTEMPTS times at most. A prompt that fails, or is null, gives its row an error, and the
    others go on. Answers are stripped. Where the model isn't available when a task begins, its rows have the error
    `unavailable`. fallback: a Column that answers the rows with an error instead, as model `fallback`; the error stays."""
    storage.ship(rows.sparkSession)
    kept = rows.drop(*(f.name for f in _NEW))
    columns = [*kept.columns, *(f.name for f in _NEW)]

    def ask(text: str | None) -> tuple:
        if text is None:
            return None, 0.0, 0, 0.0, 0, "no prompt"
        began = clock()
        for attempt in range(1, ATTEMPTS + 1):
            try:
                answer, tokens = client.generate(text)
                took = clock() - began
                return (answer or "").strip(), 1000 * took, tokens, tokens / took if took > 0 else 0.0, attempt, None
            except Busy as e:
                if attempt == ATTEMPTS:
                    return None, 1000 * (clock() - began), 0, 0.0, attempt, f"busy: {e}"
                time.sleep(pause * 2 ** (attempt - 1))
            except Exception as e:  # one prompt must not end the others
                return None, 1000 * (clock() - began), 0, 0.0, attempt, repr(e)
        raise AssertionError

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = None
        for batch in batches:
            if there is None:
                there = client.available()
            found = [ask(t if isinstance(t, str) else None) if there else (None, 0.0, 0, 0.0, 0, "unavailable") for t in batch[prompt]]
            names = ["answer", "latency_ms", "eval_count", "tokens_per_second", "attempts", "error"]
            yield batch.assign(model=client.name, **{n: pd.Series([f[i] for f in found], index=batch.index, dtype=object if n in ("answer", "error") else None) for i, n in enumerate(names)})[columns]

    out = kept.mapInPandas(run, T.StructType([*kept.schema.fields, *_NEW]))
    if fallback is None:
        return out
    lost = F.col("error").isNotNull()
    return out.withColumn("model", F.when(lost, "fallback").otherwise(F.col("model"))).withColumn("answer", F.when(lost, fallback).otherwise(F.col("answer")))


def usage(answered: DataFrame) -> DataFrame:
    """(model, n, failed, eval_count, mean_latency_ms) of answers, a row for each model."""
    return answered.groupBy("model").agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.sum("eval_count").alias("eval_count"), F.avg("latency_ms").alias("mean_latency_ms"))
