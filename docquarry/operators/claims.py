"""Claims of an answer, how well they are grounded, verdicts, and gates on revised answers. All Column expressions over
rows with the answer and its evidence: no shuffle, any number of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import text as tx

STRONG, WEAK, LEAST_BLOCK, LEAST_CONTEXT, NEAR = 0.70, 0.45, 0.15, 0.40, 30

# Patterns of answer formatting.
CITES_ONLY = rf"(?i)^(?:\[\d+(?:\s*,\s*\d+)*\]\s*)+(?:(?:{tx.LABELS})\W*)?$"
TRAILING_LABEL = rf"(?i)\s*(?:{tx.LABELS})\W*$"
NOTE = r"(?i)\*?\(unsupported\s*[—-][^)]*\)\*?"
LIST_MARKER = r"^\s*(?:#{1,6}\s+|[-*•]\s+|\d+[.)]\s+)"
LEADING_LABEL = rf"(?i)^\s*(?:{tx.LABELS})\s*:\s*"
HEADING = r"^\s*#{1,6}\s+"
BOLD_ONLY = r"^\s*(?:\*\*|__)[^*_]+(?:\*\*|__)\s*:?\s*$"
SCAFFOLD = r"(?i)the following statements? from that answer|\bunverified statements\b|^\W*(?:revised answer|here is the revised|your previous answer)\b"
ABSTAIN = (
    r"(?i)\binsufficient (?:evidence|information)\b|\b(?:does|do|did) not (?:explicitly |directly |specifically )?"
    r"(?:specify|provide|mention|state|address|describe|demonstrate|contain|include|discuss|report|cover)\b"
    r"|\bnot (?:explicitly |directly |specifically )?(?:provided|specified|mentioned|stated|described|demonstrated|addressed|covered|reported)\b"
)


def cleaned_line(line: Column) -> Column:
    """Without notes, list markers, bold marks and a leading label; runs of white space become one space."""
    out = F.regexp_replace(F.regexp_replace(line, NOTE, ""), LIST_MARKER, "")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*|__", ""), LEADING_LABEL, "")
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def statements(line: Column) -> Column:
    """Pieces of a cleaned line; one that only cites belongs to the piece before it."""
    pieces = F.filter(F.transform(F.split(line, r"(?<=[.!?])\s+(?=[A-Z\[\-\*])"), lambda x: F.trim(x)), lambda x: x != "")

    def step(acc: Column, piece: Column) -> Column:
        before = F.element_at(acc, -1)
        longer = F.trim(F.regexp_replace(F.concat(before, F.lit(" "), piece), TRAILING_LABEL, ""))
        return F.when((F.size(acc) > 0) & piece.rlike(CITES_ONLY), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), step)


def is_claim(statement: Column) -> Column:
    words = F.size(tx.all_of(F.regexp_replace(statement, r"\[\d+(?:\s*,\s*\d+)*\]", ""), r"(?U)\w+"))
    cited = F.size(tx.citation_ids(statement)) > 0
    return (words > 0) & ~F.rtrim(statement).endswith(":") & ~statement.rlike(SCAFFOLD) & (cited | (~statement.rlike(ABSTAIN) & (words >= 4)))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, text, citation_ids) of answers (answer_id, answer, evidence_ids array<int>).

    Headings, bold lines and lead-ins aren't claims. A line that only cites goes with the claim above it. Ids that no
    evidence has are dropped."""
    lines = F.filter(F.transform(F.split("answer", r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(HEADING) & ~x.rlike(BOLD_ONLY))
    valid = lambda x: F.array_intersect(tx.citation_ids(x), F.col("evidence_ids"))
    claim = lambda t, ids: F.struct(t.alias("text"), ids.alias("citation_ids"))
    none = F.array().cast("array<struct<text:string,citation_ids:array<int>>>")

    def step(acc: Column, line: Column) -> Column:
        found = F.transform(F.filter(statements(line), is_claim), lambda s: claim(s, valid(s)))
        before = F.element_at(acc, -1)
        longer = claim(F.concat(before["text"], F.lit(" "), F.trim(F.regexp_replace(line, TRAILING_LABEL, ""))), F.array_union(before["citation_ids"], valid(line)))
        attached = F.when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(acc)
        return F.when(line.rlike(CITES_ONLY), attached).otherwise(F.concat(acc, found))

    got = answers.withColumn("found", F.aggregate(F.transform(lines, cleaned_line), none, step))
    return got.select("answer_id", F.posexplode("found").alias("claim_no", "claim")).select("answer_id", "claim_no", "claim.text", "claim.citation_ids")


def is_abstention(answer: Column) -> Column:
    """Whether all statements of three words or more say that evidence is lacking, and there is one."""
    lines = F.filter(F.transform(F.split(answer, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    each = F.filter(F.flatten(F.transform(lines, lambda x: statements(cleaned_line(x)))), lambda s: F.size(tx.all_of(s, r"(?U)\w+")) >= 3)
    return (F.size(each) > 0) & F.forall(each, lambda s: s.rlike(ABSTAIN))


def without_scaffold(answer: Column) -> Column:
    """Without echoed instructions and the bullets and blank lines right below them."""
    start = F.struct(F.lit(False).alias("echo"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        heading = line.rlike(SCAFFOLD)
        below = acc["echo"] & (line.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+") | (F.trim(line) == ""))
        return F.struct((heading | below).alias("echo"), F.when(heading | below, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    return F.trim(F.array_join(F.aggregate(F.split(answer, r"\r?\n"), start, step)["kept"], "\n"))


def _evidence_tokens(text: Column) -> Column:
    bare = F.transform(tx.all_of(F.lower(text), r"[a-z0-9.\-]+"), lambda t: F.struct(t.rlike("^[a-z]").alias("word"), F.regexp_replace(t, r"^[.\-]+|[.\-]+$", "").alias("t")))
    return F.transform(bare, lambda x: F.when(x["word"], tx.stem(x["t"])).otherwise(x["t"]))


def number_context_ok(words: Column, claim: Column, evidence: Column) -> Column:
    """Whether each specific number of the claim has enough of its words within NEAR tokens somewhere in the evidence."""
    tokens = _evidence_tokens(evidence)
    near = lambda n: F.transform(
        F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"] == n),
        lambda x: tx.overlap(words, F.slice(tokens, F.greatest(x["i"] - NEAR, F.lit(0)) + 1, F.least(x["i"], F.lit(NEAR)) + NEAR + 1)),
    )
    fits = F.forall(tx.all_of(claim, tx.SPECIFIC_NUMBER), lambda n: F.coalesce(F.array_max(near(n)), F.lit(0.0)) >= LEAST_CONTEXT)
    return (F.size(words) == 0) | fits


def grounded(rows: DataFrame, strong: float = STRONG, weak: float = WEAK) -> DataFrame:
    """rows (text, cited array<string>: the cited blocks in order) with overlap, min_cite_overlap, missing, context_ok,
    grounding and grounding_score."""
    bare = tx.without_markers(F.col("text"))
    out = rows.withColumn("__bare", bare).withColumn("__words", tx.grounding_words(F.col("__bare"))).withColumn("__joined", F.array_join("cited", " "))
    empty = (F.size("cited") == 0) | (F.size("__words") == 0)
    words = F.col("__words")
    numbers = F.filter(tx.all_of(F.col("__bare"), tx.NUMBER), lambda n: ~F.col("__joined").contains(n))
    out = out.withColumns(
        {
            "overlap": F.when(empty, 0.0).otherwise(tx.overlap(words, tx.grounding_words(F.col("__joined")))),
            "min_cite_overlap": F.when(empty, 0.0).otherwise(F.array_min(F.transform("cited", lambda t: tx.overlap(words, tx.grounding_words(t))))),
            "missing": F.when(empty, F.array().cast("array<string>")).otherwise(numbers),
            "context_ok": empty | number_context_ok(words, F.col("__bare"), F.col("__joined")),
        }
    )
    o, missing = F.col("overlap"), F.size("missing") > 0
    shaky = ~F.col("context_ok") | (F.col("min_cite_overlap") < LEAST_BLOCK)
    label = F.when((F.size("cited") == 0) | missing, "none").when(o >= strong, F.when(shaky, "weak").otherwise("strong")).when(o >= weak, "weak").otherwise("none")
    score = F.when(F.size("cited") == 0, 0.0).when(missing, F.least(o, F.lit(0.3))).otherwise(o)
    return out.withColumns({"grounding": label, "grounding_score": F.bround(score, 3)}).drop("__bare", "__words", "__joined")


def verdict(response: Column) -> Column:
    """STATUS: ... if there, else the first of the words that occurs (longer ones first), else UNSUPPORTED."""
    said = F.upper(F.regexp_extract(response, r"(?i)STATUS:\s*(SUPPORTED|PARTIALLY_SUPPORTED|UNSUPPORTED|CONTRADICTED)", 1))
    out = F.when(said != "", said)
    for word in ("PARTIALLY_SUPPORTED", "CONTRADICTED", "UNSUPPORTED", "SUPPORTED"):
        out = out.when(F.upper(response).contains(word), word)
    return out.otherwise("UNSUPPORTED")


def rationale(response: Column) -> Column:
    said = F.trim(F.regexp_extract(response, r"(?is)RATIONALE:\s*(.+)", 1))
    return F.when(said != "", said).otherwise(F.trim(response))


def has_substance(answer: Column) -> Column:
    return F.regexp_replace(tx.without_markers(answer), rf"(?i){tx.LABELS}", "").rlike("[A-Za-z0-9]{2,}")


def better(cited: Column, cited_after: Column, unsupported: Column, unsupported_after: Column) -> Column:
    """Whether a revised answer is taken: not less cited, and strictly less unsupported."""
    return (cited_after >= cited) & (unsupported_after < unsupported)


def annotated(answer: Column, unsupported: Column, note: str = "*(unsupported — could not be verified)*") -> Column:
    """Each unsupported statement marked at its first occurrence; those that don't occur are listed at the end."""
    start = F.struct(answer.alias("t"), F.array().cast("array<string>").alias("rest"))

    def step(acc: Column, s: Column) -> Column:
        at = F.instr(acc["t"], s)
        marked = F.concat(F.substr(acc["t"], F.lit(1), at - 1 + F.length(s)), F.lit(" " + note), F.substr(acc["t"], at + F.length(s)))
        return F.struct(F.when(at > 0, marked).otherwise(acc["t"]).alias("t"), F.when(at > 0, acc["rest"]).otherwise(F.concat(acc["rest"], F.array(s))).alias("rest"))

    done = F.aggregate(unsupported, start, step)
    return F.when(F.size(done["rest"]) == 0, done["t"]).otherwise(F.concat(done["t"], F.lit("\n"), F.array_join(F.transform(done["rest"], lambda s: F.concat(F.lit("- "), s, F.lit(" " + note))), "\n")))
