"""Text functions as Column expressions: tokens, sentences, stems, content words, n-grams, marker handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count as content, and words that speak of the citation instead of the fact.
STOP_WORDS = """that this with from were have been which their these those also than then such using used into over both
each other more most only some when while where about between within across based paper study studies results method
methods approach model models proposed show shown shows however thus therefore they them does not are and the for can may
our its it's""".split()
REPORTING_WORDS = """mention mentions mentioned mentioning specifically specific provide provides provided providing detailed
detail details suggest suggests suggested suggesting indicate indicates indicated highlight highlights highlighted describe
describes described state states stated note notes noted discuss discusses discussed according evidence information context
indeed further additionally overall generally notably""".split()

MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"
NUMBER = r"\d+(?:\.\d+)?"
SPECIFIC_NUMBER = r"\d+\.\d+|\d{3,}"
LABELS = "SUPPORTED CLAIM|INTERPRETATION|LIMITATION"


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs, in order, with repeats."""
    return all_of(F.lower(text), "[a-z0-9]+")


def token_line(text: Column) -> Column:
    """The tokens() with a space between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.size(all_of(text, r"\S+"))


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space where a capital or digit follows; pieces are trimmed, empty ones dropped."""
    parts = F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def stem(word: Column) -> Column:
    """Without the first of -ing, -ed, -es, -s that leaves four letters or more."""
    out = word
    for suffix in ("s", "es", "ed", "ing"):
        long = word.endswith(suffix) & (F.length(word) - len(suffix) >= 4)
        out = F.when(long, F.substr(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def _without(words: Column, *lists: list[str]) -> Column:
    drop = F.array(*(F.lit(w) for w in sorted({w for x in lists for w in x})))
    return F.filter(words, lambda w: ~F.array_contains(drop, w))


def grounding_words(text: Column) -> Column:
    """Distinct stems of words of four characters or more that are neither stop nor reporting words."""
    return F.array_distinct(F.transform(_without(all_of(F.lower(text), r"[a-z][a-z0-9\-]{3,}"), STOP_WORDS, REPORTING_WORDS), stem))


def training_words(text: Column) -> Column:
    """Distinct words of four characters or more that aren't stop words, not stemmed."""
    return F.array_distinct(_without(all_of(F.lower(text), r"[a-z][a-z0-9\-]{3,}"), STOP_WORDS))


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct a that is in b; 0 if a is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(a)), F.lit(0.0))


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words; none if there are fewer. Shifted copies are zipped, so each word is copied n times."""
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), many)
    for shift in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(shift + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(grams)


def citation_ids(text: Column) -> Column:
    """Numbers in [n] and [n, m] markers, each once, in order."""
    groups = F.transform(all_of(text, MARKER, 1), lambda g: F.transform(F.split(g, ","), lambda x: F.trim(x).cast("int")))
    return F.array_distinct(F.flatten(groups))


def without_markers(text: Column) -> Column:
    bare = F.regexp_replace(text, r"\[\d+(?:\s*,\s*\d+)*\]", "")
    return F.regexp_replace(bare, rf"(?i)^\s*(?:{LABELS})\s*:\s*", "")


def inline(line: Column) -> Column:
    """A line as pieces (kind, text): `bold` between double stars, `cite` for each number in a marker, `text` between."""
    cut = F.split(F.regexp_replace(line, r"(\*\*.+?\*\*|\[\d+(?:\s*,\s*\d+)*\])", "\u001f$1\u001f"), "\u001f")
    piece = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    cites = lambda x: F.transform(F.split(F.regexp_replace(x, r"[\[\]\s]", ""), ","), lambda n: piece("cite", n))
    each = F.transform(F.filter(cut, lambda x: x != ""), lambda x: F.when(x.rlike(r"^\*\*.+\*\*$"), F.array(piece("bold", F.regexp_replace(x, r"\*\*", "")))).when(x.rlike(r"^\[\d"), cites(x)).otherwise(F.array(piece("text", x))))
    return F.flatten(each)
