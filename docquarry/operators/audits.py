"""Checks of questions, labels, reference answers and judges' replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import documents as dc
from docquarry.sources import storage

# Limits and patterns of the checks.
SKIPPED_SECTIONS = ["References", "Abstract", "Acknowledgements", "Acknowledgments", "Unknown"]
META_REFERENCE = (
    r"(?i)\b(this|the|that) (paper|passage|text|study|article|excerpt|section|authors?|work|document|context)\b|"
    r"\b(above|following|given) (text|passage|table|figure|excerpt)\b|\baccording to (the|this)\b"
)
LABEL_REFERENCE = r"(?i)\b(table|figure|fig\.)\s*\d+"
SPECIFIC = r"\b[A-Z][a-z]*[A-Z0-9][A-Za-z0-9\-]*\b|\b[A-Z]{2,}|\d|(?<=\s)[A-Z][a-z]{3,}"
AXIS = r"[A-Za-z][A-Za-z0-9_]*\s*=\s*(-?\d+(?:\.\d+)?)"
TERMS_LEAST, ANSWERABLE_LEAST = 0.5, 0.4
JUDGE_MARKERS = r"\[\d+(?:\s*[,–-]\s*\d+)*\]"
JUDGE_LABELS = rf"(?i)(?:\*\*)?(?:{tx.LABELS})(?:\*\*)?\s*:?"
JUDGE_NOTES = r"\s*\*\(unsupported — could not be verified against retrieved evidence\)\*|\*\*Unverified statements:\*\*"
JUDGE_STOP = """the and for with that this from are was were has have been used using uses use its their they them which when
what where while such into over both each other more most only some than then also can may not but does did
based paper study results method methods model models approach across between within""".split()
NEUTRAL_STOP = """the and for are was were with that this these those from have has had not but can which when where who whom how
what why does did using used use into onto than then them their there here its his her our your you they she him
been being will would could should also such over under each any all both more most one two via per out about some""".split()


def words_of(text: Column) -> Column:
    """Distinct words of three characters or more, without the judge's stop words."""
    return F.array_distinct(tx._without(tx.all_of(F.lower(text), r"[a-z][a-z0-9\-]{2,}"), JUDGE_STOP))


def neutral_words(text: Column) -> Column:
    return F.array_distinct(F.filter(tx._without(tx.tokens(text), NEUTRAL_STOP), lambda w: F.length(w) >= 3))


# Questions ------------------------------------------------------------------------------------------------------------


def eligible(chunk_type: Column, section: Column, text: Column, tokens: Column) -> Column:
    """Whether a chunk may be asked about: prose of 90 to 420 words with few digits, a real table of at most 500 tokens,
    or a caption of 12 words; none of sections that state nothing."""
    words = tx.token_count(text)
    digits = F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^0-9]", "")), F.length(text)), F.lit(0.0))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    kind = F.coalesce(chunk_type, F.lit("text"))
    fits = F.when(kind == "text", words.between(90, 420) & (digits < 0.12)).when(kind == "table", (bars >= 12) & (tokens <= 500)).otherwise(words >= 12)
    return ~F.coalesce(section.isin(SKIPPED_SECTIONS), F.lit(False)) & fits


def question_reason(question: Column, answer: Column, chunk_type: Column, grams_shared: Column, text: Column, grounding: Column) -> Column:
    """Why a question is rejected, the first that holds; null if it passes. grams_shared: whether it has five words in a
    row with the chunk; grounding: the answer's label against the chunk."""
    kind = F.coalesce(chunk_type, F.lit("text"))
    n = tx.token_count(question)
    numbers = tx.all_of(answer, tx.NUMBER)
    of_table = (kind == "table") & (F.size(numbers) > 0)
    return (
        F.when((F.trim(F.coalesce(question, F.lit(""))) == "") | (F.trim(F.coalesce(answer, F.lit(""))) == ""), "empty")
        .when(~F.trim(question).endswith("?") | ~n.between(7, 40), "bad question shape")
        .when(question.rlike(META_REFERENCE), "refers to the paper/text")
        .when((kind == "text") & question.rlike(LABEL_REFERENCE), "refers to a table/figure label")
        .when(~question.rlike(SPECIFIC), "generic question (names nothing specific)")
        .when(grams_shared, "copies the passage")
        .when(of_table & F.exists(numbers, lambda x: ~text.contains(x)), "answer numbers not in the table")
        .when(of_table, None)
        .when(tx.token_count(answer) < 3, "answer too short")
        .when(grounding == "none", "answer not grounded in the passage")
    )


def shares_run(a: Column, b: Column, n: int = 5) -> Column:
    """Whether two token arrays have a run of n in common."""
    return F.arrays_overlap(tx.ngrams(a, n), tx.ngrams(b, n))


# Labels ---------------------------------------------------------------------------------------------------------------


def cell_check(question: Column, answer: Column, markdown: Column) -> Column:
    """For a question with two `name=value` axes, the cell of a Markdown table that it asks for and whether the answer
    has it: a struct (match, cell, transposed), null where there is nothing to check. transposed: the answer has the
    cell of the axes the other way round."""
    axes = tx.all_of(question, AXIS, 1)
    grid = dc.markdown_to_grid(markdown)
    at = lambda i, j: dc.table_cell(grid, F.try_element_at(axes, F.lit(i)), F.try_element_at(axes, F.lit(j)))
    numbers = tx.all_of(answer, tx.NUMBER)
    has = lambda c: F.coalesce(F.array_contains(numbers, c), F.lit(False))
    return F.when((F.size(axes) == 2) & at(1, 2).isNotNull(), F.struct(has(at(1, 2)).alias("match"), at(1, 2).alias("cell"), (~has(at(1, 2)) & has(at(2, 1))).alias("transposed")))


def _all_in(some: str, all_: str) -> Column:
    return F.size(F.array_except(some, all_)) == 0


def _numbers_held(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, held, rows), written: which of the numbers asked of their document chunks hold, as any part
    of their text, and how many equal rows do. Chunks that hold none are left out.

    A number stands within a stretch of digits and single points. So what is looked up are the parts of such stretches,
    of lengths that are asked for, and never pairs of a label and a chunk."""
    wanted = storage.written(asked.select("document_id", F.explode("asked").alias("number")).distinct())
    lengths = F.array(*(F.lit(r["n"]) for r in wanted.select(F.length("number").alias("n")).distinct().collect()) or [F.lit(0)])
    stretches = F.array_distinct(tx.all_of(F.col("text"), r"\d+(?:\.\d+)*"))
    rows = chunks.filter("chunk_id is not null and text is not null").select("document_id", "chunk_id", F.xxhash64("text").alias("copy"), stretches.alias("s"), lengths.alias("lengths"))
    parts = F.flatten(F.transform("s", lambda s: F.flatten(F.transform(F.filter("lengths", lambda n: (n > 0) & (n <= F.length(s))), lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substr(s, i, n))))))
    rows = rows.filter(F.size("s") > 0).select("document_id", "chunk_id", "copy", F.explode(F.array_distinct(parts)).alias("number"))
    met = rows.join(wanted, ["document_id", "number"]).groupBy("document_id", "chunk_id", "copy").agg(F.collect_list("number").alias("all"))
    # equal rows: each has a number once
    met = met.withColumn("held", F.array_sort(F.array_distinct("all")))
    out = storage.written(met.select("document_id", "chunk_id", "held", (F.size("all") / F.size("held")).cast("long").alias("rows")))
    storage.dropped(wanted)
    return out


def _holders(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(document_id, asked, holders): in how many rows of a document each asked set of numbers is held whole.

    A single number is counted. Of several the one that fewest hold is looked up, and those who hold it are compared; what
    holds the same is one row."""
    alike = held.groupBy("document_id", "held").agg(F.sum("rows").alias("rows"))
    each = alike.select("document_id", "held", "rows", F.explode("held").alias("number"))
    counts = each.groupBy("document_id", "number").agg(F.sum("rows").alias("n"))
    sets = asked.select("document_id", "asked").distinct()
    single = sets.filter(F.size("asked") == 1).withColumn("number", F.col("asked")[0]).join(counts, ["document_id", "number"]).select("document_id", "asked", F.col("n").alias("holders"))
    several = sets.filter(F.size("asked") > 1).select("document_id", "asked", F.explode("asked").alias("number")).join(counts, ["document_id", "number"])
    several = several.groupBy("document_id", "asked").agg(F.min_by("number", F.struct("n", "number")).alias("number"), F.count("*").alias("known")).filter(F.col("known") == F.size("asked")).drop("known")
    several = several.join(each, ["document_id", "number"]).filter(_all_in("asked", "held")).groupBy("document_id", "asked").agg(F.sum("rows").alias("holders"))
    return single.unionByName(several)


def audited(items: DataFrame, chunks: DataFrame, spare: DataFrame | None = None) -> DataFrame:
    """items (qid, type, question, reference_answer, chunk_id, document_id) with missing numbers, term_grounding,
    question_answerable, ambiguity, verdict and badness.

    chunks, and after it spare: (chunk_id, document_id, text). ambiguity counts the other chunks of the document that
    have all the reference's numbers. A label is broken if its chunk isn't there, lacks a reference number, or has
    another value in the cell asked for; suspect if its words are hardly there or other chunks fit too; else ok."""
    first = items.join(chunks.select("chunk_id", F.col("text").alias("__a")), "chunk_id", "left")
    if spare is not None:
        first = first.join(spare.select("chunk_id", F.col("text").alias("__b")), "chunk_id", "left")
    source = F.coalesce("__a", "__b") if spare is not None else F.col("__a")
    rows = first.withColumn("source", source).withColumn("numbers", tx.all_of(F.col("reference_answer"), tx.NUMBER))
    asked = rows.filter(F.size("numbers") > 0).select("qid", "document_id", "chunk_id", F.array_sort(F.array_distinct("numbers")).alias("asked"))
    held = _numbers_held(asked, chunks)
    # of the chunks with all numbers, those that aren't the label's own
    own = asked.select("document_id", "chunk_id", "asked").distinct().join(held, ["document_id", "chunk_id"]).filter(_all_in("asked", "held")).groupBy("document_id", "chunk_id", "asked").agg(F.sum("rows").alias("own"))
    fits = asked.filter("chunk_id is not null").join(_holders(asked, held), ["document_id", "asked"]).join(own, ["document_id", "chunk_id", "asked"], "left")
    fits = fits.groupBy("qid").agg(F.sum(F.col("holders") - F.coalesce("own", F.lit(0))).alias("ambiguity"))
    rows = rows.join(fits, "qid", "left").withColumn("ambiguity", F.coalesce("ambiguity", F.lit(0)))
    there, text = F.col("source").isNotNull(), F.coalesce("source", F.lit(""))
    own = words_of(text)
    part = lambda c: F.when(~there, 0.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(words_of(c), own)), F.size(words_of(c))), F.lit(1.0)))
    rows = rows.withColumns(
        {
            "missing": F.when(there, F.filter("numbers", lambda n: ~text.contains(n))).otherwise(F.array().cast("array<string>")),
            "term_grounding": part(F.col("reference_answer")),
            "question_answerable": part(F.col("question")),
            "cell": F.when(F.col("type") == "table", cell_check(F.col("question"), F.col("reference_answer"), text)),
        }
    )
    weak = F.when(F.col("term_grounding") < TERMS_LEAST, 1).otherwise(0) + F.when(F.col("question_answerable") < ANSWERABLE_LEAST, 1).otherwise(0) + F.when(F.col("ambiguity") > 0, 1).otherwise(0)
    none = F.size("missing") == 0
    broken = ~there | ~none | (none & ~F.coalesce(F.col("cell.match"), F.lit(True)))
    verdict = F.when(broken, "broken").when(weak > 0, "suspect").otherwise("ok")
    left = F.round((1 - F.col("term_grounding")) + (1 - F.col("question_answerable")), 2)
    badness = F.when(~there, 1000.0).otherwise(F.when(broken, 100).when(weak > 0, 10).otherwise(0) + F.size("missing") * 5 + weak + left)
    rows = rows.withColumn("verdict", verdict).withColumn("badness", badness)
    return rows.withColumns({c: F.round(c, 3) for c in ("term_grounding", "question_answerable")}).drop("source", "numbers", "__a", "__b", "cell")


def parsed_verdict(reply: Column, allowed: list[str]) -> Column:
    """(verdict, corrected_answer, reason) of a judge's reply in JSON, which may stand in a fence or in other text; null
    where there is none or its verdict isn't allowed."""
    kind = "verdict string, corrected_answer string, reason string"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```(?:json)?|```$", ""), r"^`+|`+$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    read = F.from_json(F.when(inner != "", inner), kind, {"mode": "PERMISSIVE"})
    empty = lambda c: F.coalesce(read[c], F.lit(""))
    return F.when(read["verdict"].isin(allowed), F.struct(read["verdict"].alias("verdict"), empty("corrected_answer").alias("corrected_answer"), empty("reason").alias("reason")))


def digit_set(text: Column) -> Column:
    """The distinct numbers of a text, as digits without points and leading zeros."""
    bare = F.transform(tx.all_of(text, tx.NUMBER), lambda n: F.regexp_replace(F.regexp_replace(n, r"\D", ""), "^0+", ""))
    return F.array_distinct(F.transform(bare, lambda n: F.when(n == "", "0").otherwise(n)))


def transcription(markdown: Column, truth: Column) -> Column:
    """(accepted, invented): whether a transcribed table is one, and which of its numbers the page doesn't have."""
    grid = dc.markdown_to_grid(markdown)
    extra = F.array_sort(F.array_except(digit_set(markdown), digit_set(truth)))
    width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    return F.struct(((F.size(grid) >= 2) & (width >= 2) & (F.size(extra) == 0)).alias("accepted"), F.slice(extra, 1, 8).alias("invented"))


# Answers --------------------------------------------------------------------------------------------------------------


def judge_text(answer: Column) -> Column:
    """An answer as prose for a judge: without notes, citations, labels and bold marks, single spaces, none before . , ; :"""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(answer, JUDGE_NOTES, ""), JUDGE_MARKERS, ""), JUDGE_LABELS, "")
    out = F.regexp_replace(F.replace(out, F.lit("**"), F.lit("")), r"[ \t]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\s+([.,;:])", "$1"), r"^\s+|\s+$", "")


def is_empty(answer: Column) -> Column:
    return ~judge_text(answer).rlike("[A-Za-z0-9]{2,}")


def normal_value(text: Column) -> Column:
    """Without commas between thousands; odd hyphens and spaces as plain ones."""
    return F.translate(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), "‑−  ", "--  ")


def is_value(reference: Column) -> Column:
    """Whether a reference answer is a value: digits, and at most two words."""
    return (F.size(tx.all_of(reference, "[A-Za-z]{3,}")) <= 2) & reference.rlike(r"\d")


def value_present(reference: Column, answer: Column) -> Column:
    """Whether the answer has all numbers of the reference (before any ±), and there is one."""
    numbers = tx.all_of(F.split_part(reference, F.lit("±"), F.lit(1)), tx.NUMBER)
    said = normal_value(judge_text(answer))
    return (F.size(numbers) > 0) & F.forall(numbers, lambda n: said.contains(n))


def fast_score(answer: Column, reference: Column) -> Column:
    """(number_match, term_recall): whether all the reference's numbers are in the answer, and which share of its words;
    null where it has none."""
    said = F.regexp_replace(answer, r"\[\d+(?:\s*,\s*\d+)*\]", "")
    numbers, words = tx.all_of(reference, tx.NUMBER), words_of(reference)
    return F.struct(F.when(F.size(numbers) > 0, F.forall(numbers, lambda n: said.contains(n))).alias("number_match"), F.try_divide(F.size(F.array_intersect(words, words_of(said))), F.size(words)).alias("term_recall"))


def neutral_score(context: Column, reference: Column) -> Column:
    """(answer_coverage, number_covered, context_tokens) of the retrieved text, whatever its chunks: the share of the
    reference's words that it has (1 without any), whether it has all its numbers as numbers, and its length."""
    words = neutral_words(reference)
    numbers = tx.all_of(reference, r"\d+\.?\d*")
    has = lambda n: F.expr("true") & F.regexp_like(context, F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b")))
    return F.struct(
        F.coalesce(F.try_divide(F.size(F.array_intersect(words, tx.tokens(context))), F.size(words)), F.lit(1.0)).alias("answer_coverage"),
        F.when(F.size(numbers) > 0, F.forall(numbers, has)).alias("number_covered"),
        tx.token_count(context).alias("context_tokens"),
    )


def neutral_summary(rows: DataFrame) -> DataFrame:
    """One row on (answer_coverage, number_covered, context_tokens)."""
    return rows.agg(
        F.round(F.avg("answer_coverage"), 4).alias("answer_coverage"),
        F.round(F.avg(F.when(F.col("answer_coverage") >= 0.8, 1.0).otherwise(0.0)), 4).alias("answer_covered_at_80"),
        F.round(F.avg(F.col("number_covered").cast("int")), 4).alias("number_coverage"),
        F.count("number_covered").alias("n_numbers"),
        F.round(F.avg("context_tokens"), 1).alias("context_tokens"),
    )
