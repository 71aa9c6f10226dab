"""Filters on answers and questions for training and evaluation sets, and label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators.claims import ABSTAIN

# Limits and patterns of the filters.
COVERAGE, GROUNDING, WEAK_SHARE, WEAK_AT, NOVELTY, LEAST_BLOCK, CONTEXT = 0.7, 0.55, 0.25, 0.4, 0.35, 0.20, 0.4
META = (
    r"(?i)\b(?:directly stated|is supported by|as indicated by|classified as|provides? evidence|based on the (?:provided )?(?:information|evidence)"
    r"|the (?:provided )?evidence (?:states|shows|indicates))\b|\bthis (?:information|can be)\b"
)
CITE = r"\[(\d+)\]"
TRAILING_CITES = rf"(?i)^(?:\[\d+\])+(?:\s+(?:{tx.LABELS}))?\W*$"
CITE_ONLY_LINE = rf"(?i)^\s*(?:(?:{tx.LABELS})\s*:?\s*)?((?:\[\d+\]\s*)+)\W*$"
LIST_PREFIX = r"^\s*(?:[-*•]|\d+[.)])\s+"
LABEL_PREFIX = rf"(?i)^\s*(?:\*\*)?(?:{tx.LABELS})(?:\*\*)?\s*:?\s*(?:\*\*)?\s*"


def normalized(answer: Column) -> Column:
    """Lines with only citations are folded into the last line with text above, before its end mark."""

    def step(acc: Column, line: Column) -> Column:
        mine = F.filter(F.transform(acc, lambda x, i: F.when(F.trim(x) != "", i + 1)), lambda i: i.isNotNull())
        at = F.element_at(mine, -1)
        base = F.rtrim(F.element_at(acc, at))
        stop = base.rlike(r"[.!?]$")
        marks = F.array_join(tx.all_of(F.regexp_extract(line, CITE_ONLY_LINE, 1), r"\[\d+\]"), "")
        folded = F.concat(F.when(stop, F.substr(base, F.lit(1), F.length(base) - 1)).otherwise(base), F.lit(" "), marks, F.when(stop, F.right(base, F.lit(1))).otherwise("."))
        put = F.transform(acc, lambda x, i: F.when(i + 1 == at, folded).otherwise(x))
        return F.when(line.rlike(CITE_ONLY_LINE) & (F.size(mine) > 0), put).otherwise(F.concat(acc, F.array(line)))

    return F.trim(F.array_join(F.aggregate(F.split(F.trim(answer), r"\r?\n"), F.array().cast("array<string>"), step), "\n"))


def content_sentences(answer: Column) -> Column:
    """Sentences of six words or more; citations after a sentence's end belong to it."""
    lines = F.filter(F.transform(F.split(answer, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, LIST_PREFIX, ""), LABEL_PREFIX, ""))

    def joined(line: Column) -> Column:
        pieces = F.transform(F.split(line, r"(?<=[.!?])\s+(?=[A-Z\[(\"'*])"), lambda s: F.regexp_replace(s, r"^[ *_]+|[ *_]+$", ""))

        def step(acc: Column, s: Column) -> Column:
            longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.element_at(acc, -1), F.lit(" "), s)))
            return F.when((F.size(acc) > 0) & s.rlike(TRAILING_CITES), longer).when(s != "", F.concat(acc, F.array(s))).otherwise(acc)

        return F.aggregate(pieces, F.array().cast("array<string>"), step)

    every = F.flatten(F.transform(bare, joined))
    return F.filter(every, lambda s: F.size(tx.all_of(F.regexp_replace(s, CITE, ""), r"(?U)\w+")) >= 6)


def _cites(s: Column) -> Column:
    return F.transform(tx.all_of(s, CITE, 1), lambda x: x.cast("int"))


def checked(rows: DataFrame, min_sentences: int = 2) -> DataFrame:
    """rows (answer, evidence map<int,string>, and question if novelty counts) with `reason`: `ok` or the first failure.

    The sentences are looked at in order, and each for number, context and irrelevant blocks in this order."""
    answer, evidence = F.col("answer"), F.col("evidence")
    out = rows.withColumn("__all", content_sentences(answer))
    out = out.withColumn("__some", F.filter("__all", lambda s: s.rlike(CITE) | ~s.rlike(ABSTAIN))).withColumn("__cited", F.filter("__some", lambda s: s.rlike(CITE)))

    def look(s: Column) -> Column:
        bare, ids = F.regexp_replace(s, CITE, ""), _cites(s)
        blocks = F.transform(ids, lambda i: F.coalesce(F.try_element_at(evidence, i), F.lit("")))
        joined = F.array_join(blocks, " ")
        words = tx.training_words(bare)
        missing = F.filter(tx.all_of(bare, tx.NUMBER), lambda n: ~joined.contains(n))
        specific = tx.all_of(bare, tx.SPECIFIC_NUMBER)
        tokens = F.transform(tx.all_of(F.lower(joined), r"[a-z0-9.\-]+"), lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
        best = lambda n: F.coalesce(F.array_max(F.transform(F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"] == n), lambda x: tx.overlap(words, F.slice(tokens, F.greatest(x["i"] - 30, F.lit(0)) + 1, F.least(x["i"], F.lit(30)) + 31)))), F.lit(0.0))
        wrong = (F.size(words) > 0) & F.exists(specific, lambda n: best(n) < CONTEXT)
        padded = ~s.rlike(ABSTAIN) & (F.size(words) > 0) & F.exists(blocks, lambda b: tx.overlap(words, tx.training_words(b)) < LEAST_BLOCK)
        why = F.when(F.size(missing) > 0, F.concat(F.lit("number_not_in_evidence:"), F.element_at(missing, 1))).when(wrong, "number_context_mismatch").when(padded, "irrelevant_citation")
        return F.struct(why.alias("why"), F.when(F.size(words) > 0, tx.overlap(words, tx.training_words(joined))).alias("recall"))

    out = out.withColumn("__looks", F.transform("__cited", look))
    failed = F.filter(F.transform("__looks", lambda x: x["why"]), lambda w: w.isNotNull())
    recalls = F.filter(F.transform("__looks", lambda x: x["recall"]), lambda r: r.isNotNull())
    total = F.aggregate(recalls, F.lit(0.0), lambda a, r: a + r)
    weak = F.size(F.filter(recalls, lambda r: r < WEAK_AT))
    ids = _cites(answer)
    reason = F.when(F.trim(answer) == "", "empty").when(answer.contains("unsupported — could not be verified"), "contains_unsupported_note").when(F.size(ids) == 0, "no_citations")
    reason = reason.when(F.exists(ids, lambda i: ~F.array_contains(F.map_keys(evidence), i)), "invalid_citation_id").when(F.exists("__all", lambda s: s.rlike(META)), "meta_commentary")
    reason = reason.when(F.size("__some") < min_sentences, "too_few_sentences").when(F.coalesce(F.try_divide(F.size("__cited"), F.size("__some")), F.lit(0.0)) < COVERAGE, "low_citation_coverage")
    reason = reason.when(F.size(failed) > 0, F.try_element_at(failed, F.lit(1))).when(F.size(recalls) == 0, "nothing_to_ground")
    reason = reason.when((F.coalesce(F.try_divide(total, F.size(recalls)), F.lit(0.0)) < GROUNDING) | (F.coalesce(F.try_divide(weak, F.size(recalls)), F.lit(0.0)) > WEAK_SHARE), "weak_grounding")
    if "question" in rows.columns:
        words = tx.training_words(F.regexp_replace(F.array_join("__some", " "), CITE, ""))
        new = F.coalesce(F.try_divide(F.size(F.array_except(words, tx.training_words(F.col("question")))), F.size(words)), F.lit(0.0))
        reason = reason.when(F.col("question").isNotNull() & (new < NOVELTY), "restates_question")
    lines = F.filter(F.transform(F.split(answer, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    reason = reason.when((F.size(lines) > 4) & (F.size(lines) > F.size(F.array_distinct(lines))), "repeated_lines").otherwise("ok")
    return out.withColumn("reason", reason).drop("__all", "__some", "__cited", "__looks")
