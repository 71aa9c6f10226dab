"""Documents to chunks: sections, reference lists, packing, tables and metadata.

What looks at one document is done with Column expressions, or row by row in Arrow batches where it is a running fold
(packing); section state that runs over pages is a window by document."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions import text as tx
from docquarry.llm import runtime

CHUNK_TOKENS, OVERLAP, LEAST, TOPIC_TOKENS = 400, 60, 40, 220
SCANNED_CHARS = 50
#: Characters of chunks that a task makes before it hands them on.
PACKED_BYTES = 2_000_000

# Section names and the headings that open them.
SECTIONS = {
    "Abstract": ["abstract", "summary"],
    "Introduction": ["introduction", "background"],
    "Methods": ["method", "methods", "materials and methods", "materials & methods", "methodology", "experimental setup", "experimental methods", "materials and method"],
    "Results": ["result", "results", "findings", "results and discussion", "experimental results", "experiments and results"],
    "Discussion": ["discussion"],
    "Limitations": ["limitations", "limitation", "study limitations"],
    "Conclusion": ["conclusion", "conclusions", "concluding remarks", "conclusion and future work", "conclusions and future work"],
    "References": ["references", "bibliography", "works cited", "literature cited"],
}
NUMBERING = r"(?i)^\s*(?:[ivxlc]+[.)]|\d+[.)]?)\s*"
# What reference lists are made of.
SURNAME_INITIAL = r"(?<![A-Z]\. )\b[A-Z][A-Za-z\-]{1,30},\s?[A-Z]\.(?:\s?[A-Z]\.)?"
NUMBERED_INITIAL = r"\[\d{1,3}\]\s*[A-Z]\.\s?(?:[A-Z]\.\s?)?[A-Z][A-Za-z\-]+"
YEAR = r"\b(?:19[5-9]\d|20[0-2]\d)[a-z]?\b"
LOCATOR = r"\b(?:pp\.\s?\d+|vol\.\s?\d+|\d{1,4}\s?\(\d{1,3}\)\s?[:,]\s?[A-Za-z]?\d+|\d{1,5}\s?[–-]\s?\d{1,5}\)?[.,])"
FINITE_VERB = (
    r"(?i)\b(?:is|are|was|were|has|have|had|shows?|shown|showed|propose[sd]?|introduce[sd]?|demonstrate[sd]?|present(?:s|ed)?|use[sd]?|provide[sd]?|found|"
    r"report(?:s|ed)?|achieve[sd]?|outperform(?:s|ed)?|train(?:s|ed)?|evaluate[sd]?|indicate[sd]?|suggest(?:s|ed)?|can|could|will|would|should|"
    r"need(?:s|ed)?|allow(?:s|ed)?|require[sd]?)\b"
)


def heading(line: Column) -> Column:
    """The section that a line opens, or null."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), NUMBERING, ""), r"^[ :.\-]+|[ :.\-]+$", "")
    names: dict[str, str] = {}
    for section, words in SECTIONS.items():
        for word in words:
            names.setdefault(word, section)
            names.setdefault(word + "s", section)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, bare)


def section_runs(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, run, section, text): the stretches between headings of pages (document_id,
    page_number, text). A heading isn't kept; the section carries over pages; References stays to a document's end."""
    lines = pages.select("document_id", "page_number", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).withColumn("opens", heading(F.col("line")))
    by_doc = Window.partitionBy("document_id").orderBy("page_number", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    by_page = Window.partitionBy("document_id", "page_number").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    pinned = F.max(F.when(F.col("opens") == "References", 1).otherwise(0)).over(by_doc)
    lines = lines.withColumn("section", F.when(pinned == 1, "References").otherwise(F.coalesce(F.last("opens", True).over(by_doc), F.lit("Unknown"))))
    lines = lines.withColumn("run", F.sum(F.when(F.col("opens").isNotNull(), 1).otherwise(0)).over(by_page))
    body = lines.filter(F.col("opens").isNull() & (F.trim("line") != ""))
    runs = body.groupBy("document_id", "page_number", "run", "section").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("x"))
    return runs.select("document_id", "page_number", "run", "section", F.array_join(F.transform("x", lambda s: s["line"]), " ").alias("text"))


def reference_score(text: Column) -> Column:
    """1 or more for a reference list: densities of entries, numbers, locators and years against finite verbs."""
    count = lambda p: F.size(tx.all_of(text, p))
    n = tx.token_count(text)
    verbs = count(FINITE_VERB) / F.greatest(n, F.lit(1)) * 100
    authors = count(SURNAME_INITIAL)
    by_author = F.least(authors / 3, authors / F.greatest(n, F.lit(1)) * 100 / 2.0)
    by_place = F.least(count(LOCATOR) / 4, count(YEAR) / 3, F.coalesce(F.try_divide(F.lit(2.0), verbs), F.lit(1e3)))
    return F.when(n < 20, 0.0).otherwise(F.greatest(by_author, count(NUMBERED_INITIAL) / 2, by_place))


_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9])")


def pack_sentences(sentences: list[str], size: int = CHUNK_TOKENS, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Sentences in chunks of at most `size` tokens. A chunk opens with the last sentences of the one before that fit
    `overlap`, unless the next sentence then wouldn't fit. A chunk below `least` joins the one before it."""
    counts = [len(s.split()) for s in sentences]
    chunks: list[list[int]] = []
    now: list[int] = []
    held = 0
    for i, n in enumerate(counts):
        if now and held + n > size:
            chunks.append(now)
            tail, room = [], overlap
            for j in reversed(now):
                if counts[j] > room:
                    break
                room -= counts[j]
                tail.insert(0, j)
            now = tail if sum(counts[j] for j in tail) + n <= size else []
            held = sum(counts[j] for j in now)
        now.append(i)
        held += n
    if now:
        chunks.append(now)
    out: list[str] = []
    for chunk in chunks:
        text = " ".join(sentences[j] for j in chunk)
        if out and len(text.split()) < least:
            out[-1] += " " + text
        else:
            out.append(text)
    return out


def pack_topics(sentences: list[str], distances: list[float], threshold: float, size: int = TOPIC_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Sentences in chunks that end where the distance to the next sentence is over the threshold, and before `size`
    tokens are passed; either way the next chunk opens with the last sentences that fit `overlap`, if the next sentence
    then fits too. A sentence longer than `size` is cut into so many words each."""
    counts = [len(s.split()) for s in sentences]
    out: list[list[int]] = []
    now: list[int] = []

    def tail() -> list[int]:
        kept, room = [], overlap
        for j in reversed(now):
            if counts[j] > room:
                break
            room -= counts[j]
            kept.insert(0, j)
        return kept

    for i, n in enumerate(counts):
        if now and sum(counts[j] for j in now) + n > size:
            out.append(now)
            rest = tail()
            now = rest if sum(counts[j] for j in rest) + n <= size else []
        now = [*now, i]
        if i < len(distances) and distances[i] > threshold:
            out.append(now)
            now = tail()
    if now:
        out.append(now)
    cut = []
    for chunk in out:
        words = " ".join(sentences[j] for j in chunk).split()
        cut += [" ".join(words[k : k + size]) for k in range(0, len(words), size)] if len(words) > size else [" ".join(sentences[j] for j in chunk)]
    return cut


def topic_chunks(documents: DataFrame, size: int = TOPIC_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(document_id, chunk_no, text) of documents (document_id, sentences, distances, threshold), each packed by itself."""

    def packed(sentences: list[str], distances: list[float], threshold: float) -> list[tuple]:
        return [(i, chunk) for i, chunk in enumerate(pack_topics(sentences, distances, threshold, size, overlap))]

    return _packed(documents.select("document_id", "sentences", "distances", "threshold"), packed, {"chunk_no": pa.int64(), "text": pa.string()}, "chunk_no long, text string")


def chunks(pages: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(document_id, chunk_no, text, token_count) of rows (document_id, text), each packed by itself in its task."""

    def packed(text: str | None) -> list[tuple]:
        found = [s.strip() for s in _BREAK.split((text or "").strip())]
        return [(i, chunk, len(chunk.split())) for i, chunk in enumerate(pack_sentences([s for s in found if s], size, overlap, least))]

    return _packed(pages.select("document_id", "text"), packed, {"chunk_no": pa.int64(), "text": pa.string(), "token_count": pa.int64()}, "chunk_no long, text string, token_count long")


def _packed(documents: DataFrame, packed, made: dict[str, pa.DataType], schema: str) -> DataFrame:
    """document_id with the rows that `packed` makes of a document's other columns.

    Documents are read one by one from the batch, and rows are handed on whenever they hold PACKED_BYTES: a task holds
    a batch, one document and so much of what was made, and no Python objects of all of them. Memory is given back after."""
    kind = documents.schema["document_id"].dataType.simpleString()

    def run(batches):
        def out(batch, owner, rows):
            values = zip(*rows, strict=True) if rows else [[] for _ in made]
            ids = batch.column("document_id").take(pa.array(owner, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *(pa.array(list(v), t) for v, t in zip(values, made.values(), strict=True))], names=["document_id", *made])

        for batch in batches:
            owner, rows, held = [], [], 0
            others = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "document_id"]
            for i in range(len(batch)):
                for row in packed(*(c[i].as_py() for c in others)):
                    owner.append(i)
                    rows.append(row)
                    held += len(row[1])
                    if held >= PACKED_BYTES:
                        yield out(batch, owner, rows)
                        owner, rows, held = [], [], 0
            if rows:
                yield out(batch, owner, rows)

    return documents.mapInArrow(runtime.relieved(run), f"document_id {kind}, {schema}")


def hard_split(text: Column, size: int) -> Column:
    """Groups of `size` words, the last with what is left."""
    words = tx.all_of(text, r"\S+")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(size))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " ")))


def topic_breaks(vectors: DataFrame, percentile: float = 0.8) -> DataFrame:
    """vectors (document_id, pos, embedding) with distance to the next and whether a topic ends there: a distance over
    the document's exact percentile."""
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    after = F.lead("embedding").over(Window.partitionBy("document_id").orderBy("pos"))
    rows = vectors.withColumn("next", after)
    dot = F.aggregate(F.zip_with("embedding", "next", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("distance", F.when(F.col("next").isNotNull(), F.round(1 - dot / (norm(F.col("embedding")) * norm(F.col("next")) + 1e-8), 6)))
    limit = F.expr(f"percentile(distance, {percentile})").over(Window.partitionBy("document_id"))
    return rows.withColumn("threshold", F.round(limit, 6)).withColumn("ends", F.col("distance") > F.col("threshold")).drop("next", "embedding")


def is_scanned(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether a document has no pages or fewer than SCANNED_CHARS characters on an average page."""
    mean = pages.groupBy("document_id").agg(F.avg(F.length("text")).alias("mean_chars"))
    return documents.join(mean, "document_id", "left").withColumn("scanned", F.coalesce(F.col("mean_chars") < SCANNED_CHARS, F.lit(True)))


# Tables: grids are array<array<string>>, the header first. ----------------------------------------------------------


def once(value: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def clean_grid(grid: Column) -> Column:
    """Cells with single spaces; rows and columns without any text dropped; short rows filled up."""
    cells = F.transform(grid, lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    width = lambda rows: F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    full = lambda rows: once(width(rows), lambda n: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))))
    columns = lambda rows: F.sequence(F.lit(1), F.greatest(width(rows), F.lit(1)))
    keep = lambda rows: F.filter(columns(rows), lambda i: F.exists(rows, lambda r: F.try_element_at(r, i) != ""))
    kept = lambda rows: once(keep(rows), lambda at: F.transform(rows, lambda r: F.transform(at, lambda i: F.element_at(r, i))))
    return once(F.filter(cells, lambda r: F.exists(r, lambda c: c != "")), lambda rows: once(full(rows), kept))


def grid_to_markdown(grid: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(grid, 1))))
    rest = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(F.element_at(grid, 1)), rule), rest), "\n")


def markdown_to_grid(markdown: Column) -> Column:
    """Rows of lines that begin with a bar, without rules; cells are cut at every bar."""
    lines = F.filter(F.transform(F.split(markdown, r"\r?\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))
    return clean_grid(F.filter(rows, lambda r: F.exists(r, lambda c: (c != "") & ~c.rlike(r"^:?-{2,}:?$"))))


def looks_tabular(grid: Column, captioned: Column) -> Column:
    """Two rows and columns or more, at most 14 columns, short and mostly filled cells; without a caption three rows
    and 40 % of the cells with digits."""
    share = lambda filled, test: F.coalesce(F.try_divide(F.size(F.filter(filled, test)), F.size(filled)), F.lit(0.0))
    prose = lambda filled: share(filled, lambda c: tx.token_count(c) >= 6)
    digits = lambda filled: share(filled, lambda c: c.rlike("[0-9]"))

    def looks(grid: Column, cells: Column, filled: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
        good = (F.size(grid) >= 2) & (width >= 2) & (F.size(filled) > 0) & (F.size(F.element_at(grid, 1)) <= 14) & (prose(filled) < 0.2) & (1 - F.size(filled) / F.greatest(F.size(cells), F.lit(1)) < 0.6)
        return F.coalesce(good & (captioned | ((F.size(grid) >= 3) & (digits(filled) >= 0.4))), F.lit(False))

    return once(grid, lambda g: once(F.flatten(g), lambda cells: once(F.filter(cells, lambda c: c != ""), lambda filled: looks(g, cells, filled))))


def table_cell(grid: Column, row: Column, column: Column) -> Column:
    """The cell of a row label and a column label, null if there is none; of equal row labels the last counts."""
    header = F.slice(F.element_at(grid, 1), 2, F.greatest(F.size(F.element_at(grid, 1)) - 1, F.lit(0)))
    at = F.array_position(header, column)
    mine = F.filter(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: F.element_at(r, 1) == row)
    value = F.try_element_at(F.try_element_at(mine, F.lit(-1)), (at + 1).cast("int"))
    return F.when((at > 0) & (value != ""), value)


def split_tables(tables: DataFrame) -> DataFrame:
    """tables (grid, budget, and others) as parts (the others, n, part): body rows dealt to parts of at most `budget`
    tokens each, in order; each part repeats the header, and a table without rows is one part. A row is in one part
    only and isn't copied for others, so the work is that of the rows, however long the table is."""
    others = [c for c in tables.columns if c not in ("grid", "budget")]
    body = F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))
    counted = tables.select(*others, "grid", "budget", F.transform(body, lambda r: tx.token_count(F.array_join(r, " | "))).alias("counts"))

    def run(batches):
        for batch in batches:
            grids, rows = batch.column("grid"), batch.column("grid").values
            owner, place, chosen, ends = [], [], [], [0]
            for t, (counts, budget) in enumerate(zip(batch.column("counts").to_pylist(), batch.column("budget").to_pylist(), strict=True)):
                if counts is None:
                    continue
                header = grids.offsets[t].as_py()
                n, held = 0, None
                for i, size in enumerate([0, *counts]):
                    if held is None or (i > 1 and held + size > budget):
                        if held is not None:
                            ends.append(len(chosen))
                        owner.append(t)
                        place.append(n)
                        chosen.append(header)
                        n, held = n + 1, 0
                    if i:
                        chosen.append(header + i)
                        held += size
                ends.append(len(chosen))
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows.take(pa.array(chosen, pa.int64())))
            kept = [batch.column(c).take(pa.array(owner, pa.int64())) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(place, pa.int32()), parts], names=[*others, "n", "part"])

    fields = [*(counted.schema[c] for c in others), T.StructField("n", T.IntegerType()), T.StructField("part", counted.schema["grid"].dataType)]
    return counted.mapInArrow(run, T.StructType(fields))


# How captions begin.
CAPTION = r"^\s*(Table|TABLE|Tab\.|Figure|FIGURE|Fig\.)\s*(\d+|[IVX]+)\s*(?:[.:|]\s*\S|\s+[A-Z])"


def caption(block: Column) -> Column:
    """`Table n` or `Figure n` of a caption's text, else null: a number, and behind it a mark and text, or a capital."""
    kind = F.lower(F.regexp_extract(block, CAPTION, 1))
    return F.when(kind != "", F.concat(F.when(kind.startswith("tab"), "Table ").otherwise("Figure "), F.regexp_extract(block, CAPTION, 2)))


def sanitized(text: Column) -> Column:
    """Without NUL; a string column holds no lone surrogates."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def digit_share(grid: Column) -> Column:
    """Which share of the cells with text has a digit; 0 without any."""
    filled = F.filter(F.flatten(grid), lambda c: c != "")
    return F.coalesce(F.try_divide(F.size(F.filter(filled, lambda c: c.rlike("[0-9]"))), F.size(filled)), F.lit(0.0))


def table_chunks(tables: DataFrame, size: int = CHUNK_TOKENS, floor: int = 60) -> DataFrame:
    """Chunks of tables (document_id, page_number, idx, section, caption, label, grid): the caption, or the label, and the
    grid as Markdown. Rows that would be more than `size` tokens with them, or `floor`, go on in another part, under the
    same caption and header."""
    prefix = F.when(F.coalesce(F.col("caption"), F.lit("")) != "", F.col("caption")).otherwise(F.col("label"))
    rows = tables.withColumn("prefix", prefix)
    head = grid_to_markdown(F.array(F.element_at("grid", 1)))
    budget = F.greatest(F.lit(size) - tx.token_count(F.col("prefix")) - tx.token_count(head), F.lit(floor))
    each = split_tables(rows.select("document_id", "page_number", "idx", "section", "label", "prefix", "grid", budget.alias("budget")))
    place = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("idx", "n")) - 1
    text = F.concat("prefix", F.lit("\n"), grid_to_markdown(F.col("part")))
    return _with_ids(each.withColumn("place", place), "t").select("chunk_id", "document_id", "page_number", "section", text.alias("text"), tx.token_count(text).alias("token_count"), F.lit("table").alias("chunk_type"), "label")


def figure_chunks(figures: DataFrame) -> DataFrame:
    """Chunks of figures (document_id, page_number, idx, section, caption, label, figure_text): the caption, and the text
    in the figure if there is any."""
    text = F.concat("caption", F.when(F.coalesce("figure_text", F.lit("")) != "", F.concat(F.lit("\nText in the figure: "), "figure_text")).otherwise(""))
    place = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("idx")) - 1
    return _with_ids(figures.withColumn("place", place), "f").select("chunk_id", "document_id", "page_number", "section", text.alias("text"), tx.token_count(text).alias("token_count"), F.lit("figure").alias("chunk_type"), "label")


def _with_ids(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("chunk_id", F.concat(F.col("document_id").cast("string"), F.lit("_p"), F.col("page_number").cast("string"), F.lit(f"_{kind}"), F.col("place").cast("string")))


def document_chunks(pages: DataFrame, size: int = CHUNK_TOKENS, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """The text chunks of pages (document_id, page_number, text): none reaches over a heading. Ids count on each page;
    a chunk that is a list of references is in that section, whatever it stands under."""
    runs = section_runs(pages)
    packed = chunks(runs.select(F.struct("document_id", "page_number", "run", "section").alias("document_id"), "text"), size, overlap, least)
    rows = packed.select("document_id.*", "chunk_no", "text", "token_count")
    place = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("run", "chunk_no")) - 1
    section = F.when(reference_score(F.col("text")) >= 1, "References").otherwise(F.col("section"))
    return _with_ids(rows.withColumn("place", place), "c").select("chunk_id", "document_id", "page_number", section.alias("section"), "text", "token_count", F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("label"))


def page_section(pages: DataFrame) -> DataFrame:
    """pages (page_id, hint, text) with `section`: what the hint names, else the first heading, else Unknown."""
    heads = F.filter(F.transform(F.split("text", r"\r?\n"), heading), lambda h: h.isNotNull())
    return pages.withColumn("section", F.coalesce(heading(F.col("hint")), F.try_element_at(heads, F.lit(1)), F.lit("Unknown")))


def transcribed(tables: DataFrame, cache: DataFrame) -> DataFrame:
    """tables (page_number, idx, grid) with the grid of an accepted transcription (key p<page>_t<idx>, markdown, accepted)
    in place of theirs, if it is a table."""
    key = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_t"), F.col("idx").cast("string"))
    rows = tables.withColumn("key", key).join(cache, "key", "left").withColumn("new", markdown_to_grid(F.col("markdown")))
    good = F.col("accepted") & (F.size("new") >= 2) & (F.coalesce(F.array_max(F.transform("new", F.size)), F.lit(0)) >= 2)
    return rows.withColumn("grid", F.when(F.coalesce(good, F.lit(False)), F.col("new")).otherwise(F.col("grid"))).drop("key", "markdown", "accepted", "new")


def inside_fraction(inner: list[Column], outer: list[Column]) -> Column:
    """Share of one box's area (x0, y0, x1, y1) that lies in another; 0 for an empty box."""
    area = lambda b: F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))
    shared = [F.greatest(inner[0], outer[0]), F.greatest(inner[1], outer[1]), F.least(inner[2], outer[2]), F.least(inner[3], outer[3])]
    return F.coalesce(F.try_divide(area(shared), area(inner)), F.lit(0.0))


def nearest_captions(grids: DataFrame, captions: DataFrame, gap: float = 60.0) -> DataFrame:
    """Each grid (page, grid_id, top, bottom) with the nearest caption (page, caption_id, at) of its page within `gap`;
    a caption goes to the nearest grid that has it as its nearest."""
    away = F.greatest(F.col("top") - F.col("at"), F.col("at") - F.col("bottom"), F.lit(0.0))
    near = grids.join(captions, "page").withColumn("away", away).filter(F.col("away") <= gap)
    first = F.row_number().over(Window.partitionBy("page", "grid_id").orderBy("away", "caption_id"))
    claimed = F.row_number().over(Window.partitionBy("page", "caption_id").orderBy("away", "grid_id"))
    return near.withColumn("p", first).filter("p = 1").withColumn("p", claimed).filter("p = 1").select("page", "grid_id", "caption_id", "away")


# Metadata ------------------------------------------------------------------------------------------------------------


def document_key(content: Column, name: Column) -> Column:
    """First eight digits of the content's sha1, and the name as a slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.substring(F.sha1(content), 1, 8), F.lit("_"), F.when(slug == "", "document").otherwise(slug))


def title_of(text: Column) -> Column:
    """The first line with text."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)), F.lit("Untitled"))


# A preprint's stamp, what lines of addresses have, where the authors end, and how a name looks.
WATERMARK = r"(?i)^arxiv:\s*\d{4}\.\d{4,5}"
ADDRESS = "university institute department dept college hospital corp inc ltd laboratory lab school center centre faculty division group".split()
AUTHORS_END = ["abstract", "introduction", "keywords", "index terms"]
NAME_LINE = r"^[A-Z][\w.'-]*(\s+[A-Z][\w.'-]*){1,4}$"
TITLE_LINES, AUTHOR_LINES, MOST_AUTHORS = 3, 25, 10


def front_matter(lines: DataFrame) -> DataFrame:
    """(document_id, title, authors) of the lines of first pages (document_id, line_no, size, text).

    The title is the first three lines of the largest type (within half a point), without a preprint's stamp. Authors
    are lines below it that look like a name, up to a heading, 25 lines and ten names."""
    own = Window.partitionBy("document_id")
    rows = lines.filter((F.trim("text") != "") & ~F.col("text").rlike(WATERMARK))
    rows = rows.withColumn("n", F.row_number().over(own.orderBy("line_no"))).withColumn("large", F.col("size") >= F.max("size").over(own) - 0.5)
    nth = F.sum(F.when(F.col("large"), 1).otherwise(0)).over(own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("titled", F.col("large") & (nth <= TITLE_LINES)).withColumn("after", F.max(F.when(F.col("titled"), F.col("n"))).over(own))
    low = F.regexp_replace(F.lower(F.trim("text")), ":+$", "")
    below = (F.col("n") > F.col("after")) & (F.col("n") <= F.col("after") + AUTHOR_LINES)
    rows = rows.withColumn("below", below).withColumn("end", F.max(F.when(F.col("below") & low.isin(AUTHORS_END), 1).otherwise(0)).over(own.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    named = F.col("below") & (F.col("end") == 0) & ~F.col("text").contains("@") & ~low.rlike("|".join(ADDRESS)) & ~F.col("text").rlike("[0-9]") & F.trim("text").rlike(NAME_LINE)
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("n", F.trim("text").alias("t")))))
    got = rows.groupBy("document_id").agg(pick(F.col("titled")).alias("t"), pick(named).alias("a"))
    return got.select("document_id", F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("title"), F.slice(F.transform("a", lambda x: x["t"]), 1, MOST_AUTHORS).alias("authors"))


def authors_of(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r",|;|&| and "), lambda x: F.trim(x)), lambda x: x != "")


def year_of(text: Column, created: Column | None = None) -> Column:
    stamp = F.regexp_extract(created, r"D:(\d{4})", 1) if created is not None else F.lit("")
    return F.coalesce(F.nullif(stamp, F.lit("")), F.nullif(F.regexp_extract(text, r"\b(?:19|20)\d{2}\b", 0), F.lit(""))).cast("int")
