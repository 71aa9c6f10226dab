"""Language identification by bit-sliced Bloom filters of n-grams.

A language contains an n-gram that makes up at least LEAST_SHARE of its text, and its filter holds all that it contains.
The filters stand side by side: a slot is a mask with one bit for each language, so that one probe of the
slots of an n-gram returns all languages containing it. For each language the n-grams that hit are counted, corrected
for the false positives that its filter's fill makes, and the largest corrected share decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import runtime, tally

#: An n-gram belongs to a language from this share of the language's n-grams on, so a filter has 1 / LEAST_SHARE at most.
#: What is rarer than that in all of a language's text is as likely a name, a quotation or a slip.
LEAST_SHARE = 1 / 20_000
PROBES = 4
UNDETERMINED = "und"

_LETTER = np.zeros(1 << 16, bool)
_LETTER[[i for i in range(1 << 16) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """One 4-gram hash for each letter (the character before it, it, two after; others than letters as a space), and
    where each text's begin (one more than texts)."""
    low = [" " + t.lower() + "  " if t else "   " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    letter = np.where(points < 1 << 16, _LETTER[np.minimum(points, (1 << 16) - 1)], False)
    beyond = np.flatnonzero(points >= 1 << 16)
    if len(beyond):
        letter[beyond] = [chr(p).isalpha() for p in points[beyond].tolist()]
    points[~letter] = 32
    at = np.flatnonzero(letter)
    grams = runtime.mix((points[at - 1] << np.uint64(42)) ^ (points[at] << np.uint64(28)) ^ (points[at + 1] << np.uint64(14)) ^ points[at + 2])
    ends = np.cumsum([len(t) for t in low])
    return grams, np.concatenate([[0], np.searchsorted(at, ends)])


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # by language

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> LanguageFilters:
        """members: by language, its n-gram hashes."""
        largest = max([len(m) for m in members], default=0)
        slots = 1 << max(10, int(10 * largest - 1).bit_length() if largest else 10)
        masks = np.zeros((slots, -(-len(languages) // 64) or 1), np.uint64)
        for i, grams in enumerate(members):
            for slot in _slots(grams, slots):
                masks[slot, i // 64] |= np.uint64(1 << (i % 64))
        fill = np.array([((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, masks, fill**PROBES)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram the mask of languages whose filter contains it."""
        out = None
        for slot in _slots(grams, len(self.masks)):
            out = self.masks[slot] if out is None else out & self.masks[slot]
        return out

    def shares(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, languages): which share of a text's n-grams is in each language, corrected for false positives."""
        masks = self.containing(grams)
        n = np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for i in range(len(self.languages)):
            hit = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(hit)])
            out[:, i] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        return np.clip((out - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)


def _slots(grams: np.ndarray, slots: int):
    with np.errstate(over="ignore"):
        step = runtime.mix(grams) | np.uint64(1)
        for k in range(PROBES):
            yield ((grams + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


def learn(train: DataFrame) -> LanguageFilters:
    """Filters from all rows of (text, lang) whose lang isn't null. Rows without a letter add nothing.

    What reaches the driver: the languages, and for each at most 1 / LEAST_SHARE n-grams."""
    train = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null")
    languages = sorted(r["lang"] for r in train.select("lang").distinct().collect())

    def keys(part):
        grams, first = ngrams(part.column("text").to_pylist())
        yield from tally.by_name(part.column("lang").to_pylist(), grams, first)

    counts = runtime.written(tally.counted(train, keys))
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))  # one row for each language
    members = counts.join(F.broadcast(totals), "name").filter(F.col("n") >= LEAST_SHARE * F.col("total")).select("name", "key")
    found = members.toArrow()
    names, grams = found.column("name").combine_chunks().to_numpy(zero_copy_only=False), found.column("key").to_numpy().view(np.uint64)
    return LanguageFilters.build(languages, [grams[names == x] for x in languages])


def predict(df: DataFrame, filters: LanguageFilters, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each whole text and how clear it is (0 to 1: the best share among all languages' shares).

    Null text, or one without a letter: `und`, 0. No n-gram known anywhere: the first learned language, 0. Without any
    learned language all rows are `und`. Ties go to the language first by name. Columns with the new names are replaced;
    repeated rows and null keys are rows as others."""
    spark = df.sparkSession
    runtime.ship(spark)
    kept = df.drop(label, score)
    model = spark.sparkContext.broadcast(filters)

    def run(batches):
        filters = model.value
        for batch in batches:
            for part in runtime.steps(batch, "text"):
                grams, first = ngrams(part.column("text").to_pylist())
                n = np.diff(first)
                if filters.languages:
                    shares = filters.shares(grams, first)
                    best = shares.argmax(1)
                    total = shares.sum(1)
                    names = [filters.languages[b] if m else UNDETERMINED for b, m in zip(best.tolist(), n.tolist(), strict=True)]
                    scores = np.where((total > 0) & (n > 0), shares[np.arange(len(n)), best] / np.maximum(total, 1e-12), 0.0)
                else:
                    names, scores = [UNDETERMINED] * len(n), np.zeros(len(n))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*part.schema.names, label, score])

    return kept.mapInArrow(runtime.relieved(run), T.StructType([*kept.schema.fields, T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())]))


def is_held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5; so is one without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))
