"""Quality rules: word statistics and character n-gram perplexity.

The n-gram model is modified Kneser-Ney of order 4 over characters as they are. Spark counts the n-grams of all
documents by language, and from them continuation counts, discounts, back-off weights and probabilities of all of them;
none is left out. A corpus is judged by these: its most frequent n-grams, HELD at most, are told to all tasks in sorted
arrays, and the rest of a text's n-grams are looked up by a join. Every language has its own model and its own band of
perplexities: the median, less or more so many times the median distance from it.

For texts that the model wasn't made of, learn() gives one that is held in memory: what makes up at least LEAST_SHARE of
a language's n-grams. N-grams below that share are discounted whole, so that the probabilities after any context still
sum to one. No query judges its own corpus by it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import runtime, tally

ORDER, BITS = 4, 16
#: An n-gram is in a model for other texts from this share of the language's n-grams of its order on.
LEAST_SHARE = 1 / 500_000
#: N-grams that every task is told; others are looked up where they occur.
HELD = 1_000_000
#: Log probabilities are summed up in whole parts of this size, so that a sum is the same in any order.
UNIT = 1 << 24
#: Bytes of text whose n-grams are handled together.
STEP_BYTES = 500_000
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: The band around the median log perplexity: so many times the median distance from it (6: four standard deviations of
#: a normal distribution). Less than half of the rows can't move either without bound, wherever they lie.
REACH = 6.0
#: ... but at least so far on either side, and this over the root of the characters in words wider: few say little.
LEAST_REACH, SHORT_REACH = 0.1, 1.5
#: The model of texts without a language.
NO_LANGUAGE = ""

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the n-grams that end at its characters and at its end (16 bits to a character, the last lowest),
    and where each text's begin. Before a text stand newlines, after it one. Characters beyond 16 bits share the values
    that no character has."""
    padded = ["\n\n\n" + (t or "") + "\n" for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), np.uint32)
    units = np.where(points < 1 << 16, points, 0xD800 + points % 2048).astype(np.uint64)
    sizes = np.array([len(t) for t in padded], np.int64)
    ends = np.cumsum(sizes)
    if len(units) < ORDER:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    out = units[3:] | (units[2:-1] << np.uint64(16)) | (units[1:-2] << np.uint64(32)) | (units[:-3] << np.uint64(48))
    keep = np.ones(len(out), bool)
    for j in range(1, ORDER):  # n-grams that end in the next text's padding
        at = ends[:-1] - ORDER + j
        keep[at] = False
    return out[keep], np.concatenate([[0], np.cumsum(sizes - 3)])


def word_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = runtime.utf8(texts)
    starts, ends, first = runtime.word_bounds(data, offsets)
    n_words = np.diff(first)
    point = (data & 0xC0) != 0x80
    white = runtime._SPACE[data]

    def sums(flags):
        s = np.concatenate([[0], np.cumsum(flags)])
        return s[offsets[1:]] - s[offsets[:-1]]

    hashes = runtime.word_hashes(data, starts, ends)
    windows = runtime.window_hashes(hashes, 5)
    repeated = np.zeros(len(hashes) + 1, np.int64)
    if len(windows):
        ok = runtime.inside(first, 5, len(windows))
        own = runtime.owners(first)[: len(windows)].astype(np.uint64)
        with np.errstate(over="ignore"):
            keys = runtime.mix(windows + own * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(keys[ok])
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = np.flatnonzero((twice[at] == keys) & ok)
            edge = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + 5, -1)
            repeated[1:] = np.cumsum(np.cumsum(edge[:-1]) > 0)
    dup = []
    for text in texts.to_pylist():
        if text and "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
            dup.append(len(lines) - len(set(lines)))
        else:
            dup.append(0)
    return {"n_words": n_words, "word_chars": sums(point & ~white), "n_symbols": sums(_SYMBOLS[data]), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeated[first[1:]] - repeated[first[:-1]]}


# The model ---------------------------------------------------------------------------------------------------------


def _hash(order: int, gram: np.ndarray) -> np.ndarray:
    return runtime.mix(gram ^ runtime._stream(41, ORDER + 1)[order])


class SortedHashes:
    """Values by hash: a sorted array, entered by a hash's leading bits."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.values = np.append(hashes[by], np.uint64(0)), np.append(values[by], values.dtype.type(0))
        self.bits = max(1, len(hashes).bit_length() + 1)
        self.starts = np.searchsorted(self.hashes[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.starts = np.append(self.starts, len(hashes))

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each wanted hash is, and whether it is there."""
        lead = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        found = (self.hashes[at] == wanted) & (at < end)
        rest = np.flatnonzero(~found & (at + 1 < end))
        while len(rest):
            at[rest] += 1
            hit = self.hashes[at[rest]] == wanted[rest]
            found[rest[hit]] = True
            rest = rest[~hit]
            rest = rest[at[rest] + 1 < end[rest]]
        return at, found


@dataclass
class PerplexityModel:
    """Of each language the n-grams with log probabilities, and contexts with log back-off weights (0 for others)."""

    grams: dict[str, SortedHashes]
    contexts: dict[str, SortedHashes]

    def log_prob(self, name: str, gram: np.ndarray) -> np.ndarray:
        """Log probability of each n-gram's last character after those before: the longest n-gram that is known, with
        the back-off weights of the contexts passed over."""
        known, contexts = self.grams[name], self.contexts[name]
        at, found = known.find(_hash(ORDER, gram))
        out = np.where(found, known.values[at], np.float32(0)).astype(np.float64)
        left = np.flatnonzero(~found)
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                at, found = known.find(_hash(order, gram[left] & np.uint64((1 << BITS * order) - 1)))
                out[left[found]] += known.values[at[found]]
                left = left[~found]
            part = (gram[left] & np.uint64((1 << BITS * order) - 1 if order < ORDER else (1 << 64) - 1)) >> np.uint64(BITS)
            at, found = contexts.find(_hash(order, part))
            out[left[found]] += contexts.values[at[found]]
        out[left] -= np.log(1 << BITS)
        return out


def _level(counts: DataFrame, order: int, below: DataFrame | None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Of the n-grams (name, key, n) of one order: (name, key, n, p, kept) and (name, context, weight). n-grams below the
    share `least` of their language's aren't kept and are discounted whole; with 0 all are kept.

    D1, D2 and D3+ of modified Kneser-Ney are those of the language, where the counts of counts give sound ones."""
    n = F.col("n")
    many = lambda i: F.sum(F.when(n == i, 1).otherwise(0)).cast("double").alias(f"n{i}")
    stats = counts.groupBy("name").agg(F.sum("n").alias("all"), *map(many, (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    sound = F.least("n1", "n2", "n3", "n4") > 0
    d = [F.when(sound, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")) for i in (1, 2, 3)]
    stats = stats.select("name", "all", *(F.when((x > 0) & (x < i), x).otherwise(F.lit(i / 2)).alias(f"d{i}") for i, x in zip((1, 2, 3), d, strict=True)))
    # a row for each language: as many as there are models
    kept = n >= least * F.col("all")
    off = F.when(~kept, n).otherwise(F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3")))
    context = F.shiftrightunsigned("key", BITS) if order > 1 else F.lit(0).cast("long")
    rows = counts.join(F.broadcast(stats), "name").select("name", "key", "n", kept.alias("kept"), off.alias("off"), context.alias("context"))
    weights = rows.groupBy("name", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
    rows = rows.join(weights, ["name", "context"])
    own, weight = (F.col("n") - F.col("off")) / F.col("total"), F.col("weight")
    if below is None:
        made = rows.select("name", "key", "n", "kept", (own + weight / (1 << BITS)).alias("p"))
    else:
        lower = below.select("name", F.col("key").alias("suffix"), F.col("p").alias("lower"))
        rows = rows.withColumn("suffix", F.col("key").bitwiseAND((1 << BITS * (order - 1)) - 1)).join(lower, ["name", "suffix"])
        made = rows.select("name", "key", "n", "kept", (own + weight * F.col("lower")).alias("p"))
    return made, weights.filter("weight < 1").select("name", F.col("context").alias("key"), F.col("weight").alias("p"))


def _levels(docs: DataFrame) -> list[DataFrame]:
    """(name, key, n) of the n-grams of docs (text, lang), of order 1 to ORDER, written: how often those of the highest
    order occur, and how many of the next order end in the others."""
    docs = docs.select(F.col("text").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")).filter("text is not null")

    def keys(part):
        found, first = grams(part.column("text").to_pylist())
        yield from tally.by_name(part.column("lang").to_pylist(), found, first)

    levels = [runtime.written(tally.counted(docs, keys, STEP_BYTES))]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("key").bitwiseAND((1 << BITS * order) - 1).alias("key")
        levels.insert(0, runtime.written(levels[0].groupBy("name", shorter).agg(F.count("*").alias("n"))))
    return levels


def estimated(docs: DataFrame) -> DataFrame:
    """(name, key, n, v) of all n-grams of order ORDER in the texts of docs (text, lang), written: the language, how often
    they occur, and their log probabilities in parts of UNIT. None of any order is left out of the estimate."""
    levels, made, lower = _levels(docs), None, []
    for order, counts in enumerate(levels, 1):
        made, _ = _level(counts, order, made)
        if order < ORDER:
            made = runtime.written(made)
            lower.append(made)
    out = runtime.written(made.select("name", "key", "n", F.round(F.log("p") * UNIT).cast("long").alias("v")))
    runtime.dropped(*levels, *lower)
    return out


@dataclass
class HeldGrams:
    """Of each language the n-grams of order ORDER that occur `least` times or more, with log probabilities in parts of
    UNIT; least is 1 if these are all."""

    grams: dict[str, SortedHashes]
    least: int


def held(table: DataFrame) -> HeldGrams:
    """The most frequent n-grams of a table of estimated(), by powers of two: HELD at most, over all languages."""
    bits = table.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("many")).collect()  # 63 rows at most
    least, many = (1 << 63) - 1, 0
    for r in sorted(bits, reverse=True):
        many += r["many"]
        if many > HELD:
            break
        least = 1 << (r["bits"] - 1)
    if many <= HELD:
        least = 1
    got = table.filter(F.col("n") >= least).select("name", "key", "v").toArrow()
    name = got.column("name").combine_chunks().dictionary_encode()
    which, hashes, value = name.indices.to_numpy(), _hash(ORDER, got.column("key").to_numpy().view(np.uint64)), got.column("v").to_numpy()
    return HeldGrams({n: SortedHashes(hashes[which == i], value[which == i]) for i, n in enumerate(name.dictionary.to_pylist())}, least)


def learn(docs: DataFrame) -> PerplexityModel:
    """Models of the texts of all rows of (text, lang), one for each language, to be applied to other texts.

    What reaches the driver: for each language at most 1 / LEAST_SHARE n-grams of each order, and as many contexts."""
    levels = _levels(docs)
    made, parts, probabilities = None, [], []
    for order, counts in enumerate(levels, 1):
        made, weights = _level(counts, order, made, LEAST_SHARE)
        made = runtime.written(made)
        probabilities.append(made)
        for kind, table in ((0, made.filter("kept")), (1, weights)):
            parts.append(table.select("name", F.lit(kind).alias("kind"), F.lit(order).alias("order"), "key", F.log("p").cast("float").alias("p")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    got = rows.toArrow()
    runtime.dropped(*levels, *probabilities)
    name = got.column("name").combine_chunks().dictionary_encode()
    names, which = name.dictionary.to_pylist(), name.indices.to_numpy()
    kind, order, key, p = (got.column(c).to_numpy() for c in ("kind", "order", "key", "p"))
    hashes = np.empty(len(key), np.uint64)
    for i in range(1, ORDER + 1):
        hashes[order == i] = _hash(i, key[order == i].view(np.uint64))
    tables = [{n: SortedHashes(*(x[(which == i) & (kind == k)] for x in (hashes, p))) for i, n in enumerate(names)} for k in (0, 1)]
    return PerplexityModel(*tables)


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measured(df: DataFrame, shared, sums_of, fields: list[T.StructField], prefix: str) -> DataFrame:
    """df with the word statistics, base_failed, the columns `fields` and language_model of each whole text. sums_of gets
    the broadcast value, a slice's texts, the rows of each language, and all n-grams and where each text's begin."""
    runtime.ship(df.sparkSession)
    new = [*(prefix + c for c in [*_STATS, "base_failed"]), *(f.name for f in fields), prefix + "language_model"]
    kept = df.drop(*new)
    has_lang = "lang" in df.columns

    def run(batches):
        for batch in batches:
            for part in runtime.steps(batch, "text", STEP_BYTES):
                texts = part.column("text")
                stats = word_statistics(texts)
                n, repeated = stats["n_words"], stats["n_repeat_words"]
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
                found, first = grams(texts.to_pylist())
                langs = [NO_LANGUAGE if x is None else str(x) for x in part.column("lang").to_pylist()] if has_lang else [NO_LANGUAGE] * len(part)
                number: dict[str, int] = {}
                marks = np.array([number.setdefault(x, len(number)) for x in langs], np.int64)
                columns = sums_of(shared.value, texts, {name: marks == i for name, i in number.items()}, found, first)
                columns = [*part.columns, *(pa.array(stats[c]) for c in _STATS), pa.array(failed), *columns, pa.array(langs, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *new])

    stats = [*(T.StructField(prefix + c, T.LongType()) for c in _STATS), T.StructField(prefix + "base_failed", T.BooleanType())]
    return kept.mapInArrow(runtime.relieved(run), T.StructType([*kept.schema.fields, *stats, *fields, T.StructField(new[-1], T.StringType())]))


def score(df: DataFrame, model: PerplexityModel, prefix: str = "") -> DataFrame:
    """df with the word statistics, base_failed, log_perplexity (per character) and language_model of each whole text.

    A null text has no words, fails and has a null perplexity; so has a text whose language has no model. Column names
    get the prefix; df's own columns with these names are replaced."""

    def perplexity(model, texts, languages, found, first):
        out = np.full(len(texts), np.nan)
        for name, mine in languages.items():
            if name in model.grams:
                sums = np.concatenate([[0.0], np.cumsum(model.log_prob(name, found[np.repeat(mine, np.diff(first))]))])
                sizes = np.diff(first)[mine]
                ends = np.cumsum(sizes)
                out[mine] = -(sums[ends] - sums[ends - sizes]) / sizes
        return [pa.array(out, mask=np.isnan(out) | texts.is_null().to_numpy(zero_copy_only=False))]

    return _measured(df, df.sparkSession.sparkContext.broadcast(model), perplexity, [T.StructField(prefix + "log_perplexity", T.DoubleType())], prefix)


def _partly(df: DataFrame, model: HeldGrams, names: list[str], prefix: str) -> DataFrame:
    """df with the word statistics, base_failed, four columns of these names and language_model of each whole text: the sum
    over its n-grams that are held (null for a null text), the number of all, and the others with how often each occurs
    there."""

    def parts(model, texts, languages, found, first):
        sizes = np.diff(first)
        values, there = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        for name, mine in languages.items():
            if name in model.grams:
                at = np.flatnonzero(np.repeat(mine, sizes))
                place, there[at] = model.grams[name].find(_hash(ORDER, found[at]))
                values[at] = model.grams[name].values[place]
        values[~there] = 0
        none = texts.is_null().to_numpy(zero_copy_only=False)
        sums = np.concatenate([[0], np.cumsum(values)])
        there |= np.repeat(none, sizes)
        # each text's other n-grams, once
        own, key = np.repeat(np.arange(len(sizes)), sizes)[~there], found[~there]
        order = np.lexsort((key, own))
        own, key = own[order], key[order]
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])) if len(key) else np.empty(0, np.int64)
        offsets = pa.array(np.searchsorted(own[edge], np.arange(len(sizes) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key[edge].view(np.int64), np.diff(np.append(edge, len(key))))]
        return [pa.array(sums[first[1:]] - sums[first[:-1]], mask=none), pa.array(sizes), *lists]

    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.LongType()))
    fields = [T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True)]
    return _measured(df, df.sparkSession.sparkContext.broadcast(model), parts, fields, prefix)


def bands(scored: DataFrame, prefix: str = "") -> dict[str, tuple[float, float]]:
    """By language model, the log perplexities between which documents are kept, from all scored rows that pass the
    word rules. Exact medians of the values rounded to 1/1000: one row for each such value reaches the driver."""
    value = F.round(F.col(prefix + "log_perplexity") * 1000).cast("long")
    rows = scored.filter(~F.col(prefix + "base_failed") & F.col(prefix + "log_perplexity").isNotNull()).groupBy(F.col(prefix + "language_model").alias("name"), value.alias("v")).agg(F.count("*").alias("n")).collect()
    out = {}
    for name in {r["name"] for r in rows}:
        mine = sorted((r["v"], r["n"]) for r in rows if r["name"] == name)
        v, n = np.array(mine).T
        median = lambda x, n: x[np.searchsorted(np.cumsum(n), 0.5 * n.sum())]
        mid = median(v, n)
        away = np.abs(v - mid)
        by = np.argsort(away, kind="stable")
        reach = max(LEAST_REACH, REACH * median(away[by], n[by]) / 1000)
        out[name] = (float(mid / 1000 - reach), float(mid / 1000 + reach))
    return out


def judged(docs: DataFrame, prefix: str = "", keep_text: bool = True) -> DataFrame:
    """All rows of docs (text, and lang if there is one) with statistics, base_failed, log_perplexity, its band and kept;
    without keep_text the text is left out.

    kept: the word rules pass (MIN_WORDS words, at most MAX_REPEATED_PERCENT of them in repeated 5-word windows) and the
    perplexity lies in its language's band. The models learn from all rows, also from those that are rejected. Null and
    empty texts have 0 words and so fail. Texts without a language have a model of their own. Repeated rows count as
    often as they occur; an empty table gives an empty result; very long texts are scored whole.

    The scores are written, and the bands made of them. With keep_text rows are then scored again as they are read, so
    that no copy of all texts is written. N-grams that tasks don't hold are looked up for each different text, which is
    named by its md5 and language; where there are none, nothing is joined."""
    source = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    table = estimated(source)
    model = held(table)
    name, value = prefix + "language_model", prefix + "log_perplexity"
    own = docs.drop(*(prefix + c for c in [*_STATS, "base_failed", "log_perplexity", "language_model"]))
    parts = held_part, n_grams, keys, times = [runtime.fresh(own, c) for c in ("held", "grams", "keys", "times")]
    mark, left = runtime.fresh(own, "mark"), runtime.fresh(own, "left")
    marked = own.withColumn(mark, F.md5(F.col("text").cast("string"))) if model.least > 1 else own
    partly = _partly(marked, model, parts, prefix)
    scores = runtime.written(partly.drop("text"))
    sums = None
    if model.least > 1:
        asked = scores.filter(F.size(keys) > 0).select(mark, name, keys, times).dropDuplicates([mark, name])
        asked = asked.select(mark, F.col(name).alias("name"), F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("x")).select(mark, "name", "x.key", "x.times")
        rare = table.filter(F.col("n") < model.least).select("name", "key", "v")
        rest = asked.join(rare, ["name", "key"]).groupBy(mark, F.col("name").alias(name)).agg(F.sum(F.col("v") * F.col("times")).alias(left))
        sums = runtime.written(rest)
    runtime.dropped(table)

    def summed(rows: DataFrame) -> DataFrame:
        total = F.col(held_part)
        if sums is not None:
            rows = rows.join(sums, [mark, name], "left")
            total = total + F.coalesce(left, F.lit(0).cast("long"))
        columns = [F.col(f"`{c}`") for c in rows.columns if c not in (mark, left, name, *parts)]
        return rows.select(*columns, (-total / UNIT / F.col(n_grams)).alias(value), F.col(name))

    scored, scores = summed(partly), summed(scores)
    if not keep_text:
        scored = scores
    limits = bands(scores, prefix)
    value = F.col(value)
    table = docs.sparkSession.createDataFrame([(k, *v) for k, v in sorted(limits.items())], f"`{prefix}language_model` string, `{prefix}band_low` double, `{prefix}band_high` double")
    judged = scored.join(F.broadcast(table), prefix + "language_model", "left")  # one row for each model
    slack = SHORT_REACH / F.sqrt(F.greatest(F.col(prefix + "word_chars"), F.lit(1)))
    inside = F.coalesce((value >= F.col(prefix + "band_low") - slack) & (value <= F.col(prefix + "band_high") + slack), F.lit(True))
    own = [F.col(f"`{c}`") for c in [*scored.columns, prefix + "band_low", prefix + "band_high"]]
    return judged.select(*own, (~F.col(prefix + "base_failed") & inside).alias(prefix + "kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, with docs' own columns."""
    prefix = "__quality_"
    return judged(docs, prefix).filter(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
