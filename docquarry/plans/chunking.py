"""Queries of chunk assembly, page layout, metadata and the remaining checks, with their SQL; and the SQL of queries of
other modules that fold over sentences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answering as aw
from docquarry.operators import answers as an
from docquarry.operators import claims as cl
from docquarry.operators import documents as dc
from docquarry.operators import geometry as ge
from docquarry.operators import ingest as ig
from docquarry.plans import answering, quality_sets, scoring
from docquarry.plans import views as v
from docquarry.sources import storage
from docquarry.sources.settings import Settings

SQL: dict[str, str] = {}
RUN: dict = {}


def query(sql: str | None = None):
    def add(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Packing: a row for each sentence, with the first sentence of the chunk that it closes or goes on with ---------------

_WORDS = r"regexp_extract_all({0}, '[^\s\x0B]+')"


def _packed(units: str, size: int, overlap: int, least: int) -> str:
    """CTEs sent and packed (key, idx, text) of `units` (key, text)."""
    total = "(c[i + 1] - c[{0} - 1 + 1])"
    return f"""sent AS (SELECT key, s, n, list_transform(range(0, len(n) + 1), lambda j: coalesce(list_sum(n[1:j]), 0)) AS c FROM (SELECT key, s, [len({_WORDS.format('x')}) FOR x IN s] AS n FROM (SELECT key, {v.SENTENCES.format("coalesce(text, '')")} AS s FROM {units}))),
pk AS (SELECT key, 1 AS i, 1 AS a FROM sent WHERE len(s) > 0 UNION ALL
  SELECT key, i + 1, CASE WHEN c[i + 2] - c[a] > {size} THEN CASE WHEN c[i + 2] - c[t] <= {size} THEN t ELSE i + 1 END ELSE a END
  FROM (SELECT pk.*, c, len(s) AS last, list_filter(range(a, i + 2), lambda t: c[i + 1] - c[t] <= {overlap})[1] AS t FROM pk JOIN sent USING (key)) WHERE i < last),
ck AS (SELECT key, a, array_to_string(any_value(s)[a:max(i)], ' ') AS text FROM pk JOIN sent USING (key) GROUP BY key, a),
mk AS (SELECT *, sum(CASE WHEN p = 1 OR len({_WORDS.format('text')}) >= {least} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY a) AS g FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY a) AS p FROM ck)),
packed AS (SELECT key, g - 1 AS idx, string_agg(text, ' ' ORDER BY a) AS text FROM mk GROUP BY key, g)"""


SQL["chunk_fixed"] = f"WITH RECURSIVE units AS (SELECT doc_id AS key, text FROM documents), {_packed('units', 400, 60, 40)} SELECT key AS document_id, idx::BIGINT AS chunk_no, text, len({_WORDS.format('text')})::BIGINT AS token_count FROM packed"

_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_AUTHORS = r"len(list_filter(regexp_extract_all({0}, '([A-Z]\. )?\b[A-Z][A-Za-z\-]{{1,30}},\s?[A-Z]\.(?:\s?[A-Z]\.)?', 1), lambda x: x = ''))"


def _reference_score(text: str) -> str:
    n, s = f"len({_WORDS.format(text)})", _AUTHORS.format(text)
    count = lambda p: _COUNT.format(text, p.replace("'", "''"))
    verbs = f"({count(dc.FINITE_VERB)} / greatest({n}, 1) * 100)"
    return f"CASE WHEN {n} < 20 THEN 0 ELSE greatest(least({s} / 3, {s} / greatest({n}, 1) * 100 / 2), {count(dc.NUMBERED_INITIAL)} / 2, least({count(dc.LOCATOR)} / 4, {count(dc.YEAR)} / 3, CASE WHEN {verbs} > 0 THEN 2 / {verbs} ELSE 1000 END)) END"


SQL["reference_score"] = f"""WITH t AS (SELECT doc_id AS chunk_id, coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN repeat(' [' || doc_id || '] A. Miller, vol. 3, 12(3): 45, 1999. B. Jones, pp. 4, 2004.', 4) ELSE '' END AS text FROM documents),
s AS (SELECT chunk_id, {_reference_score('text')} AS score FROM t) SELECT chunk_id, round(score, 6) AS score, score >= 1 AS is_references FROM s"""


_PAGES = SQL_RUNS = quality_sets.SQL["section_runs"]


def _pages(spark, sf):
    heads = F.element_at(F.array(*map(F.lit, quality_sets._HEADINGS)), (F.col("chunk_id") % 9 + 1).cast("int"))
    return v.corpus(spark, sf).select(F.floor(F.col("chunk_id") / 3).alias("document_id"), (F.col("chunk_id") % 3).alias("page_number"), F.concat(heads, F.lit("\n"), "text").alias("text"))


@query(f"""WITH RECURSIVE runs AS ({_PAGES}), units AS (SELECT {{'d': document_id, 'p': page_number, 'r': run, 's': section}} AS key, text FROM runs), {_packed('units', 120, 30, 20)},
placed AS (SELECT key, text, row_number() OVER (PARTITION BY key.d, key.p ORDER BY key.r, idx) - 1 AS place FROM packed)
SELECT key.d || '_p' || key.p || '_c' || place AS chunk_id, key.d AS document_id, key.p AS page_number, CASE WHEN {_reference_score('text')} >= 1 THEN 'References' ELSE key.s END AS section, md5(text) AS text_md5, len({_WORDS.format('text')})::BIGINT AS token_count FROM placed""")
def chunk_assembly(spark, sf):
    """Pages cut at headings, packed, and given ids and sections."""
    got = dc.document_chunks(_pages(spark, sf), 120, 30, 20)
    return got.select("chunk_id", "document_id", "page_number", "section", F.md5("text").alias("text_md5"), "token_count")


_TOPIC = 40


_TITLE = f"trim(({list(quality_sets._HEADINGS)!r})[(document_id * 3) % 9 + 1])".replace('"', "'")


@query(f"""WITH RECURSIVE runs AS ({_PAGES}), units AS (SELECT {{'d': document_id, 'p': page_number, 'r': run, 's': section}} AS key, text FROM runs), {_packed('units', 120, 30, 20)},
placed AS (SELECT key, text, row_number() OVER (PARTITION BY key.d, key.p ORDER BY key.r, idx) - 1 AS place FROM packed),
made AS (SELECT key.d || '_p' || key.p || '_c' || place AS chunk_id, key.d AS document_id, CASE WHEN {_reference_score('text')} >= 1 THEN 'References' ELSE key.s END AS section, md5(text) AS text_md5 FROM placed),
papers AS (SELECT doc_id // 3 AS document_id, count(*) AS num_pages, avg(length(({list(quality_sets._HEADINGS)!r})[doc_id % 9 + 1] || chr(10) || coalesce(text, ''))) >= 50 AS good FROM documents GROUP BY 1)
SELECT p.document_id, CASE WHEN good THEN num_pages ELSE 0 END AS num_pages, CASE WHEN good THEN 'indexed' ELSE 'scanned_needs_ocr' END AS status, CASE WHEN good THEN {_TITLE.replace('document_id', 'p.document_id')} ELSE 'file' || p.document_id END AS title, coalesce(chunk_id, '') AS chunk_id, coalesce(section, '') AS section, coalesce(text_md5, '') AS text_md5
FROM papers p LEFT JOIN made m ON m.document_id = p.document_id AND good""")
def processed_papers(spark, sf):
    """Documents processed in one call: title, pages, state and chunks, by sizes that settings give."""
    pages = _pages(spark, sf)
    d = F.col("document_id")
    documents = pages.select(d).distinct().select(d, F.concat(F.lit("file"), d.cast("string"), F.lit(".pdf")).alias("filename"), F.lit("upload").alias("source"), F.lit(None).cast("timestamp").alias("uploaded_at"))
    found = ig.processed(documents, pages, settings=Settings.load("chunk_size: 120\noverlap: 30\nmin_tokens: 20", {}))
    rows = found.select(d.cast("long").alias("document_id"), "num_pages", "status", "title", F.explode_outer("chunks").alias("c"))
    none = F.lit("")
    return rows.select("document_id", "num_pages", "status", "title", F.coalesce("c.chunk_id", none).alias("chunk_id"), F.coalesce("c.section", none).alias("section"), F.coalesce(F.md5("c.text"), none).alias("text_md5"))


@query(f"""WITH RECURSIVE sent AS (SELECT key, s, n, list_transform(range(0, len(n) + 1), lambda j: coalesce(list_sum(n[1:j]), 0)) AS c, [(length(x) * 37 % 100) / 100.0 FOR x IN s[1:len(s) - 1]]::DOUBLE[] AS d FROM (SELECT key, s, [len({_WORDS.format('x')}) FOR x IN s] AS n FROM (SELECT doc_id AS key, {v.SENTENCES.format("coalesce(text, '')")} AS s FROM documents))),
pk AS (SELECT key, 1 AS i, 1 AS a, 0 AS k, 0 AS x FROM sent WHERE len(s) > 0 UNION ALL
  SELECT key, i + 1, CASE WHEN b <= i AND c[i + 2] - c[b] > {_TOPIC} THEN CASE WHEN c[i + 2] - c[t] <= {_TOPIC} THEN t ELSE i + 1 END ELSE b END, k + cut + (b <= i AND c[i + 2] - c[b] > {_TOPIC})::INT, CASE WHEN cut = 1 AND b <= i AND c[i + 2] - c[b] > {_TOPIC} THEN b ELSE 0 END
  FROM (SELECT *, CASE WHEN cut = 1 THEN t0 ELSE a END AS b, list_filter(range(CASE WHEN cut = 1 THEN t0 ELSE a END, i + 2), lambda t: c[i + 1] - c[t] <= 10)[1] AS t FROM
    (SELECT pk.*, c, len(s) AS last, (coalesce(d[i], 0) > 0.8)::INT AS cut, list_filter(range(a, i + 2), lambda t: c[i + 1] - c[t] <= 10)[1] AS t0 FROM pk JOIN sent USING (key)) WHERE i < last)),
ck AS (SELECT key, k, array_to_string(any_value(s)[min(a):max(i)], ' ') AS text FROM pk JOIN sent USING (key) GROUP BY key, k UNION ALL SELECT key, k - 1, array_to_string(s[x:i - 1], ' ') FROM pk JOIN sent USING (key) WHERE x > 0),
hs AS (SELECT key, k, unnest(CASE WHEN len(w) > {_TOPIC} THEN [array_to_string(w[j * {_TOPIC} + 1 : j * {_TOPIC} + {_TOPIC}], ' ') FOR j IN range(0, (len(w) + {_TOPIC} - 1) // {_TOPIC})] ELSE [text] END) AS text, unnest(range(0, CASE WHEN len(w) > {_TOPIC} THEN (len(w) + {_TOPIC} - 1) // {_TOPIC} ELSE 1 END)) AS j FROM (SELECT *, {_WORDS.format('text')} AS w FROM ck))
SELECT key AS document_id, count(*) AS n, md5(string_agg(text, '|' ORDER BY k, j)) AS texts_md5 FROM hs GROUP BY 1""")
def chunk_topics(spark, sf):
    """Sentences packed between topic breaks; the distances are made up of their lengths."""
    rows = v.corpus(spark, sf).select(F.col("chunk_id").alias("document_id"), tx.sentences(F.col("text")).alias("sentences")).filter(F.size("sentences") > 0)
    distance = F.transform(F.slice("sentences", 1, F.size("sentences") - 1), lambda x: (F.length(x) * 37 % 100).cast("double") / 100)
    got = dc.topic_chunks(rows.withColumn("distances", distance).withColumn("threshold", F.lit(0.8)), _TOPIC, 10)
    return got.groupBy("document_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "|")).alias("texts_md5"))


@query("""WITH r AS (SELECT c_nationkey AS n, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer), p AS (SELECT n, i // 12 AS part, string_agg('| ' || k || ' | ' || n || ' | x |', chr(10) ORDER BY k) AS body, count(*) AS rows FROM r GROUP BY 1, 2)
SELECT n || '_p1_t' || part AS chunk_id, 'Table 1' AS label, md5('Caption of ' || n || chr(10) || '| key | nation | z |' || chr(10) || '| --- | --- | --- |' || chr(10) || body) AS text_md5, (3 + 7 + 7 + rows * 7)::BIGINT AS token_count FROM p""")
def structural_chunks(spark, sf):
    """A long table for each nation, split under its caption and header."""
    rows = v.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: F.array(k.cast("string"), F.col("c_nationkey").cast("string"), F.lit("x"))).alias("rows"))
    n = F.col("c_nationkey").cast("string")
    tables = rows.select(n.alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("idx"), F.lit("Results").alias("section"), F.concat(F.lit("Caption of "), n).alias("caption"), F.lit("Table 1").alias("label"), F.concat(F.array(F.array(F.lit("key"), F.lit("nation"), F.lit("z"))), "rows").alias("grid"))
    got = dc.table_chunks(tables, size=20)
    return got.select("chunk_id", "label", F.md5("text").alias("text_md5"), "token_count")


@query("""SELECT doc_id || '_p0_f0' AS chunk_id, 'Figure 2. Of ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Text in the figure: ' || lang ELSE '' END AS text, 'Figure 2' AS label FROM documents""")
def figure_chunks(spark, sf):
    d = F.col("doc_id").cast("string")
    figures = v.table(spark, sf, "documents").select(d.alias("document_id"), F.lit(0).alias("page_number"), F.lit(0).alias("idx"), F.lit("Results").alias("section"), F.concat(F.lit("Figure 2. Of "), d).alias("caption"), F.lit("Figure 2").alias("label"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("figure_text"))
    return dc.figure_chunks(figures).select("chunk_id", "text", "label")


# Text and metadata ----------------------------------------------------------------------------------------------------

_CAPTIONS = ["Table 2. Results of", "TABLE IV: Means", "Tab. 3 | x", "Figure 7 Shows it", "figure 3 shows that it works", "Fig. 12. Loss", "Table two is", "FIGURE 1"]


@query("SELECT doc_id, " + str(_CAPTIONS) + "[doc_id % 8 + 1] AS block, coalesce(['Table 2', 'Table IV', 'Table 3', 'Figure 7', NULL, 'Figure 12', NULL, NULL][doc_id % 8 + 1], 'none') AS label, replace('a' || doc_id || 'b', '~', '') AS clean FROM documents")
def caption_parse(spark, sf):
    """Captions and what only looks like one; and a text with NULs."""
    block = F.element_at(F.array(*map(F.lit, _CAPTIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    dirty = F.concat(F.lit("a\0"), F.col("doc_id").cast("string"), F.lit("\0b"))
    return v.table(spark, sf, "documents").select("doc_id", block.alias("block"), F.coalesce(dc.caption(block), F.lit("none")).alias("label"), dc.sanitized(dirty).alias("clean"))


@query("SELECT c_nationkey::BIGINT AS nation, round(sum((c_custkey::VARCHAR <> '')::INT) / (count(*) * 2 + 2), 6) AS digit_share FROM customer GROUP BY 1")
def digit_share(spark, sf):
    rows = v.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(F.array(F.col("c_custkey").cast("string"), F.lit("x"))).alias("rows"))
    return rows.select(F.col("c_nationkey").alias("nation"), F.round(dc.digit_share(F.concat(F.array(F.array(F.lit("key"), F.lit("z"))), "rows")), 6).alias("digit_share"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Methods' WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE 'Results' END AS section FROM documents")
def page_section(spark, sf):
    n = F.col("doc_id")
    rows = v.table(spark, sf, "documents").select("doc_id", F.when(n % 4 == 0, "2. Methods").otherwise("nothing").alias("hint"), F.when(n % 3 == 0, "no heading here").otherwise("some words\nRESULTS:\nmore\nDiscussion").alias("text"))
    return dc.page_section(rows).select("doc_id", "section")


@query("SELECT n_regionkey::BIGINT AS region, CASE WHEN n_regionkey % 3 = 0 THEN 2 ELSE count(*) + 1 END AS n_rows FROM nation GROUP BY 1, n_regionkey")
def transcriptions(spark, sf):
    """Tables of which some have an accepted transcription, some a rejected one and some a broken one."""
    tables = quality_sets._grids(spark, sf).select(F.col("n_regionkey").alias("page_number"), F.lit(0).alias("idx"), "grid")
    md = F.when(F.col("page_number") == 2, "no table").otherwise("| a | b |\n| --- | --- |\n| 1 | 2 |")
    cache = tables.select(F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_t0")).alias("key"), md.alias("markdown"), (F.col("page_number") % 3 != 1).alias("accepted"))
    return dc.transcribed(tables, cache).select(F.col("page_number").alias("region"), F.size("grid").alias("n_rows"))


_LINES = """SELECT doc_id, 0 AS line_no, 30.0 AS size, 'arXiv:2208.06361v1 [q-bio] 6 Jul 2022' AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1, 18.0, 'A Study of ' || source FROM documents UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 3 = 0 THEN 17.6 ELSE 12.0 END, 'in ' || lang FROM documents
UNION ALL SELECT doc_id, 3, 10.0, 'Ann B. Lee' FROM documents UNION ALL SELECT doc_id, 4, 10.0, 'University of Somewhere' FROM documents UNION ALL SELECT doc_id, 5, 10.0, 'ann@host.org' FROM documents UNION ALL SELECT doc_id, 6, 10.0, 'Bob Two 2' FROM documents UNION ALL SELECT doc_id, 7, 10.0, 'Carl Orff' FROM documents
UNION ALL SELECT doc_id, 8, 10.0, CASE WHEN doc_id % 5 = 0 THEN 'some words' ELSE 'Abstract:' END FROM documents UNION ALL SELECT doc_id, 9, 10.0, 'Dan Late' FROM documents"""


@query("SELECT doc_id, 'A Study of ' || source || CASE WHEN doc_id % 3 = 0 THEN ' in ' || lang ELSE '' END AS title, 'Ann B. Lee; Carl Orff' || CASE WHEN doc_id % 5 = 0 THEN '; Dan Late' ELSE '' END AS authors FROM documents")
def title_authors(spark, sf):
    """First pages as lines with sizes of type: the title, and the names below it."""
    lines = spark.sql(_LINES.replace("FROM documents", "FROM {docs}"), docs=v.table(spark, sf, "documents")).withColumnRenamed("doc_id", "document_id").withColumn("size", F.col("size").cast("double"))
    return dc.front_matter(lines).select(F.col("document_id").alias("doc_id"), "title", F.array_join("authors", "; ").alias("authors"))


@query("SELECT doc_id, 'A, B and C; D & E' AS line, 5::BIGINT AS n_authors, CASE WHEN doc_id % 2 = 0 THEN 2000 + doc_id % 24 WHEN doc_id % 3 = 0 THEN 1987 END::BIGINT AS year FROM documents")
def authors_and_year(spark, sf):
    n = F.col("doc_id")
    line = F.lit("A, B and C; D & E")
    created = F.when(n % 2 == 0, F.concat(F.lit("D:"), (n % 24 + 2000).cast("string"), F.lit("0101")))
    year = dc.year_of(F.when(n % 3 == 0, "in 1987 and 2001").otherwise("no year"), F.coalesce(created, F.lit("")))
    return v.table(spark, sf, "documents").select("doc_id", line.alias("line"), F.size(dc.authors_of(line)).alias("n_authors"), year.alias("year"))


@query("SELECT doc_id, (text IS NULL OR length(text) / (doc_id % 4 + 1) < 50) AS scanned FROM documents")
def scanned_pages(spark, sf):
    """Documents as one to four pages: no text layer below fifty characters a page."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    n = (F.col("document_id") % 4 + 1).cast("int")
    pages = docs.filter("text is not null").select("document_id", F.explode(F.sequence(F.lit(1), n)).alias("page"), "text").withColumn("text", F.when(F.col("page") == 1, F.col("text")).otherwise(""))
    return dc.is_scanned(pages, docs.select("document_id")).select(F.col("document_id").alias("doc_id"), "scanned")


# Layout: a page for each document, with eight blocks, three graphics and a grid ---------------------------------------

_P = "repeat('prose word ', 20)"
_BLOCKS = f"""SELECT doc_id AS page, j AS block_id, CAST(CASE WHEN doc_id % 2 = 0 AND j % 2 = 1 THEN 310 ELSE 40 END AS DOUBLE) AS x0, CAST(40 + j * 80 AS DOUBLE) AS y0, CAST(CASE WHEN doc_id % 2 = 0 THEN (CASE WHEN j % 2 = 1 THEN 560 ELSE 290 END) ELSE 560 END AS DOUBLE) AS x1, CAST(40 + j * 80 + 30 AS DOUBLE) AS y1,
CASE WHEN (doc_id + j) % 7 = 0 THEN 'Table ' || (j + 1) || '. Values of it' WHEN (doc_id + j) % 7 = 3 THEN 'Figure ' || (j + 1) || ': A plot' WHEN (doc_id + j) % 3 = 0 THEN {_P} ELSE 'short ' || j END AS text"""
_GRAPHICS = """SELECT doc_id AS page, j AS graphic_id, CAST(50 + j * 10 AS DOUBLE) AS x0, CAST(60 + j * 200 + doc_id % 40 AS DOUBLE) AS y0, CAST(250 + j * 10 AS DOUBLE) AS x1, CAST(60 + j * 200 + doc_id % 40 + 60 AS DOUBLE) AS y1"""


def _layout(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id")
    make = lambda n, sql: docs.crossJoin(spark.range(n).withColumnRenamed("id", "j")).selectExpr(*_columns(sql))
    pages = docs.select(F.col("doc_id").alias("page"), F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(600.0).alias("right"), F.lit(800.0).alias("bottom"))
    return make(8, _BLOCKS), make(3, _GRAPHICS), pages


def _columns(sql: str) -> list[str]:
    from docquarry.plans.reports import _split

    return [x.strip() for x in _split(sql.removeprefix("SELECT "))]


_LAYOUT = rf"""b0 AS ({_BLOCKS} FROM documents, range(0, 8) t(j)), g0 AS ({_GRAPHICS} FROM documents, range(0, 3) t(j)),
b AS (SELECT *, CASE WHEN regexp_matches(text, '^(Table|Figure) \d') THEN regexp_extract(text, '^(Table|Figure) \d+') END AS label FROM b0), bl AS (SELECT *, split_part(label, ' ', 1) AS kind, length(text) >= 200 AND label IS NULL AS prose FROM b),
two AS (SELECT page, sum(prose::INT) >= 3 AND sum((prose AND x1 - x0 < 360)::INT) >= 0.6 * sum(prose::INT) AS two FROM bl GROUP BY 1),
sp AS (SELECT page, block_id, label, kind, y0 AS cap0, y1 AS cap1, CASE WHEN two AND (x0 + x1) / 1200 > 0.58 THEN 294.0 ELSE 20.0 END AS s0, CASE WHEN two AND (x0 + x1) / 1200 < 0.42 THEN 306.0 ELSE 580.0 END AS s1 FROM bl JOIN two USING (page) WHERE label IS NOT NULL)"""


@query(f"WITH {_LAYOUT} SELECT page, block_id, s0 AS span0, s1 AS span1 FROM sp")
def column_spans(spark, sf):
    blocks, _, pages = _layout(spark, sf)
    return ge.column_spans(blocks, pages)


@query(f"""WITH {_LAYOUT} SELECT page, block_id, any_value(s0) AS x0, any_value(cap1) AS y0, any_value(s1) AS x1, least(coalesce(min(CASE WHEN p.y0 > cap1 + 12 THEN p.y0 END), 764.0), 764.0) AS y1 FROM sp LEFT JOIN (SELECT page, y0 FROM bl WHERE prose) p USING (page) WHERE kind = 'Table' GROUP BY 1, 2 HAVING y1 - any_value(cap1) >= 25""")
def regions_below(spark, sf):
    blocks, _, pages = _layout(spark, sf)
    return ge.regions_below(blocks, pages)


_FIGURES = f"""{_LAYOUT}, tp AS (SELECT sp.page, sp.block_id, any_value(label) AS label, any_value(cap0) AS cap0, any_value(s0) AS s0, any_value(s1) AS s1, greatest(coalesce(max(CASE WHEN p.y1 <= cap0 AND p.x0 < s1 AND p.x1 > s0 THEN p.y1 END), 20.0), 20.0) AS r FROM sp LEFT JOIN (SELECT page, x0, x1, y1 FROM bl WHERE prose) p USING (page) WHERE kind = 'Figure' GROUP BY 1, 2),
hd AS (SELECT tp.page, block_id, label, g0.* EXCLUDE (page, graphic_id) FROM tp JOIN g0 USING (page) WHERE greatest(least(x1, s1) - greatest(x0, s0), 0) * greatest(least(y1, cap0 + 2) - greatest(y0, r), 0) / ((x1 - x0) * (y1 - y0)) >= 0.6),
fg AS (SELECT page, block_id, any_value(label) AS label, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM hd GROUP BY 1, 2 HAVING (max(x1) - min(x0)) * (max(y1) - min(y0)) >= 6000),
ins AS (SELECT fg.page, fg.block_id AS box_id, bl.block_id, bl.text FROM fg JOIN bl ON bl.page = fg.page AND bl.block_id <> fg.block_id AND greatest(least(bl.x1, fg.x1) - greatest(bl.x0, fg.x0), 0) * greatest(least(bl.y1, fg.y1) - greatest(bl.y0, fg.y0), 0) / ((bl.x1 - bl.x0) * (bl.y1 - bl.y0)) >= 0.6)"""


@query(f"""WITH {_FIGURES} SELECT fg.*, coalesce(left(trim(regexp_replace(t, '\\s+', ' ', 'g')), 300), '') AS text FROM fg LEFT JOIN (SELECT page, box_id AS block_id, string_agg(text, ' ' ORDER BY block_id) AS t FROM ins GROUP BY 1, 2) USING (page, block_id)""")
def page_figures(spark, sf):
    blocks, graphics, pages = _layout(spark, sf)
    return ge.figures(blocks, graphics, pages)


def _grid_boxes(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id")
    cell = lambda x: F.concat(F.lit(x), F.col("doc_id").cast("string"))
    grid = F.when(F.col("doc_id") % 5 == 0, F.array(F.array(F.lit("one cell")))).otherwise(F.array(F.array(F.lit("k"), F.lit("v")), F.array(cell("a"), cell("1")), F.array(cell("b"), cell("2"))))
    return docs.select(F.col("doc_id").alias("page"), F.lit(0).alias("grid_id"), F.lit(40.0).alias("x0"), (F.col("doc_id") % 8 * 80 + 80).cast("double").alias("y0"), F.lit(560.0).alias("x1"), (F.col("doc_id") % 8 * 80 + 130).cast("double").alias("y1"), grid.alias("grid"))


_TABLES = f"""{_LAYOUT}, gr AS (SELECT doc_id AS page, (doc_id % 8 * 80 + 80)::DOUBLE AS y0, (doc_id % 8 * 80 + 130)::DOUBLE AS y1, doc_id % 5 <> 0 AS good FROM documents),
ng AS (SELECT gr.*, block_id, CASE WHEN cap1 <= y0 + 5 THEN y0 - cap1 WHEN cap0 >= y1 - 5 THEN cap0 - y1 END AS gap FROM gr JOIN sp USING (page) WHERE kind = 'Table' AND good),
nr AS (SELECT page, block_id FROM ng WHERE gap >= -5 AND gap < 60 QUALIFY row_number() OVER (PARTITION BY page ORDER BY gap, block_id) = 1), tb AS (SELECT gr.*, block_id FROM gr LEFT JOIN nr USING (page) WHERE good)"""


@query(f"WITH {_TABLES} SELECT page, coalesce(block_id, -1) AS block_id, y0, y1 FROM tb")
def page_tables(spark, sf):
    """Grids with their captions; one of a single cell is none."""
    blocks, _, _ = _layout(spark, sf)
    return ge.tables(_grid_boxes(spark, sf), blocks).select("page", F.coalesce("block_id", F.lit(-1)).alias("block_id"), "y0", "y1")


@query(f"""WITH {_TABLES}, {_FIGURES[len(_LAYOUT) + 2:]}, gone AS (SELECT bl.page, bl.block_id FROM bl JOIN tb ON tb.page = bl.page WHERE (least(bl.x1, 560) - greatest(bl.x0, 40)) * greatest(least(bl.y1, tb.y1) - greatest(bl.y0, tb.y0), 0) / ((bl.x1 - bl.x0) * (bl.y1 - bl.y0)) >= 0.5
 UNION SELECT page, block_id FROM ins UNION SELECT page, block_id FROM fg UNION SELECT page, block_id FROM tb WHERE block_id IS NOT NULL UNION SELECT fg.page, fg.block_id FROM fg),
lf AS (SELECT page, string_agg(rtrim(text), chr(10) ORDER BY block_id) AS t FROM bl WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.page = bl.page AND gone.block_id = bl.block_id) GROUP BY 1) SELECT doc_id AS page, md5(trim(coalesce(t, ''))) AS text_md5 FROM documents LEFT JOIN lf ON lf.page = doc_id""")
def page_body(spark, sf):
    """What is left of a page without its tables, figures and their captions."""
    blocks, graphics, pages = _layout(spark, sf)
    got = ge.body(blocks, ge.tables(_grid_boxes(spark, sf), blocks), ge.figures(blocks, graphics, pages))
    return got.select("page", F.md5("text").alias("text_md5"))


# Layout of web pages: the title, the links as a table of three columns with a caption, and the paragraphs ---------------

_LINK = r'<li><a href="[^"]*">([^<]*)</a></li>'


def _page_layout(spark, sf):
    """Boxes of each page's blocks and words as a browser might set them, one column wide: words are placed by their
    number in a line or cell, lines below each other, and blocks apart by a gap. Blocks are written, as what is made of
    them reads them several times; words are dealt out of them anew."""
    pages = v.table(spark, sf, "pages").select(F.col("page_id").alias("page"), "html")
    parts = F.split(F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1), "<p>")
    parts = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    cut = pages.select("page", F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)).alias("links"), parts.alias("parts"))
    block = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    made = F.concat(F.array(block("caption", F.lit("Table 1. Links"))), F.transform("links", lambda x: block("cell", x)), F.transform("parts", lambda x: block("prose", x)))
    rows = cut.select("page", F.posexplode(made).alias("block_id", "b")).select("page", "block_id", "b.*").withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    link = F.col("block_id") - 1
    height = F.when(F.col("kind") != "cell", 12.0 * F.greatest(F.ceil(F.size("words") / 12), F.lit(1)) + 28).when(link % 3 == 2, 14.0).otherwise(0.0)
    above = F.coalesce(F.sum(height).over(Window.partitionBy("page").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # a last row of fewer links ends where a full one does
    short = F.max(F.when(F.col("kind") == "cell", F.col("block_id"))).over(Window.partitionBy("page"))
    rows = rows.withColumn("above", above).withColumn("last", short)
    moved = F.when((F.col("kind") == "prose"), F.when(F.col("last") % 3 != 0, 44.0).otherwise(30.0)).otherwise(0.0)
    rows = rows.withColumn("y0", 40 + F.col("above") + moved).withColumn("x0", F.when(F.col("kind") == "cell", 60.0 + link % 3 * 170).otherwise(40.0))
    rows = storage.written(rows.select("page", "block_id", "y0", "x0", "text", "words"))
    placed = rows.select("page", "block_id", "y0", F.col("x0").alias("left"), F.posexplode("words").alias("i", "text"))
    placed = placed.select("page", (F.col("block_id") * 1000000 + F.col("i")).alias("word_id"), "block_id", (F.col("left") + F.col("i") % 12 * 43).alias("x0"), (F.col("y0") + F.floor(F.col("i") / 12) * 12).alias("y0"), F.col("text"))
    words = placed.withColumn("x1", F.col("x0") + F.least(F.length("text") * 5, F.lit(40))).withColumn("y1", F.col("y0") + 10)
    boxes = words.groupBy("page", "block_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    blocks = storage.written(boxes.join(rows.select("page", "block_id", "text"), ["page", "block_id"]))
    sizes = blocks.groupBy("page").agg((F.max("y1") + 60).alias("bottom")).select("page", F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(600.0).alias("right"), "bottom")
    return blocks, words.drop("block_id"), sizes


_LINKS = rf"links AS (SELECT page_id AS page, regexp_extract_all(html, '{_LINK}', 1) AS l FROM pages)"


def _no_grids(spark):
    return spark.createDataFrame([], "page long, grid_id int, x0 double, y0 double, x1 double, y1 double, grid array<array<string>>")


@query(f"""WITH {_LINKS} SELECT page, i // 3 AS row_no, i % 3 AS column_no, CASE WHEN i < len(l) THEN trim(l[i + 1]) ELSE '' END AS cell FROM (SELECT page, l, unnest(range(((len(l) + 2) // 3) * 3)) AS i FROM links WHERE len(l) >= 4)""")
def word_tables(spark, sf):
    """Tables without rules on web pages, made of the boxes of their words."""
    blocks, words, pages = _page_layout(spark, sf)
    found = ge.all_tables(_no_grids(spark), blocks, words, pages).select("page", F.posexplode("grid").alias("row_no", "cells"))
    return found.select("page", "row_no", F.posexplode("cells").alias("column_no", "cell"))


@query(r"""WITH parts AS (SELECT page_id AS page, list_filter(list_transform(string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '') AS p FROM pages)
SELECT page, md5(trim(array_to_string(list_transform(p, lambda x: rtrim(x)), chr(10)))) AS text_md5 FROM parts""")
def page_text(spark, sf):
    """Web pages without their tables and captions."""
    blocks, words, pages = _page_layout(spark, sf)
    none = spark.createDataFrame([], "page long, block_id int, x0 double, y0 double, x1 double, y1 double")
    found = storage.written(ge.all_tables(_no_grids(spark), blocks, words, pages))
    return ge.body(blocks, found, none).select("page", F.md5("text").alias("text_md5"))


# SQL of claims, answer filters and pools ------------------------------------------------------------------------------

_SAID = f"""{v.CLAIMS}, ans AS (SELECT conv_id, turn, string_agg(text, chr(10) ORDER BY pos) AS answer FROM claims GROUP BY 1, 2), evs AS (SELECT conv_id, list(citation_id ORDER BY citation_id) AS ids, map_from_entries(list((citation_id, text))) AS ev FROM evidence GROUP BY 1), said_all AS (SELECT * FROM ans JOIN evs USING (conv_id))"""
_ONLY_CITES = r"'(?i)^(?:\[\d+(?:\s*,\s*\d+)*\]\s*)+(?:(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION)\W*)?$'"
_UWORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}\p{{M}}_]+')"
_NO_MARKS, _NO_CITES = r"regexp_replace(s, '\[\d+(?:\s*,\s*\d+)*\]', '', 'g')", r"regexp_replace(s, '\[(\d+)\]', '', 'g')"
_IDS = r"[x::BIGINT FOR x IN string_split(array_to_string(regexp_extract_all({0}, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), ','), ',') IF x <> '']"
_STATEMENTS = rf"""ln AS (SELECT conv_id, turn, ids, i, trim(l) AS line FROM (SELECT *, string_split_regex(answer, '\r?\n') AS x, unnest(range(1, len(string_split_regex(answer, '\r?\n')) + 1)) AS i, unnest(string_split_regex(answer, '\r?\n')) AS l FROM said_all)),
cln AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '(?i)\*?\(unsupported\s*[—-][^)]*\)\*?', '', 'g'), '^\s*(?:#{{1,6}}\s+|[-*•]\s+|\d+[.)]\s+)', ''), '\*\*|__', '', 'g'), '(?i)^\s*(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION)\s*:\s*', ''), '\s{{2,}}', ' ', 'g')) AS c FROM ln WHERE line <> '' {{0}}),
pcs AS (SELECT conv_id, turn, ids, i, j, p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS j, unnest(ps) AS p FROM (SELECT *, list_filter([trim(x) FOR x IN string_split(regexp_replace(c, '([.!?])\s+([A-Z\[\-\*])', '\1' || chr(31) || '\2', 'g'), chr(31))], lambda x: x <> '') AS ps FROM cln))),
isl AS (SELECT *, sum((NOT regexp_matches(p, {_ONLY_CITES}))::INT) OVER (PARTITION BY conv_id, turn, i ORDER BY j) AS g FROM pcs),
st AS (SELECT conv_id, turn, any_value(ids) AS ids, i, g, CASE WHEN count(*) = 1 THEN any_value(p) ELSE trim(regexp_replace(string_agg(p, ' ' ORDER BY j), '(?i)\s*(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION)\W*$', '')) END AS s FROM isl GROUP BY conv_id, turn, i, g)"""
_NOT_HEADS = r"AND NOT regexp_matches(line, '^\s*#{1,6}\s+') AND NOT regexp_matches(line, '^\s*(?:\*\*|__)[^*_]+(?:\*\*|__)\s*:?\s*$')"
_ABSTAIN = "'" + cl.ABSTAIN + "'"
_SCAFFOLD = "'" + cl.SCAFFOLD + "'"

SQL["claim_extract"] = rf"""WITH {_SAID}, {_STATEMENTS.replace("{0}", _NOT_HEADS)}, cm AS (SELECT *, {_IDS.format('s')} AS cited FROM st)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, g) - 1 AS claim_no, s AS text, len(list_intersect(cited, ids))::BIGINT AS n_ids FROM cm
WHERE len({_UWORDS.format(_NO_MARKS)}) > 0 AND NOT ends_with(rtrim(s), ':') AND NOT regexp_matches(s, {_SCAFFOLD}) AND (len(cited) > 0 OR (NOT regexp_matches(s, {_ABSTAIN}) AND len({_UWORDS.format(_NO_MARKS)}) >= 4))"""

SQL["abstentions"] = rf"""WITH {_SAID}, {_STATEMENTS.replace("{0}", "")}, a AS (SELECT conv_id, turn, count(*) AS n, sum(regexp_matches(s, {_ABSTAIN})::INT) AS k FROM st WHERE len({_UWORDS.format('s')}) >= 3 GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(n = k, false) AS abstains, regexp_matches(regexp_replace(regexp_replace(answer, '\[\d+(?:\s*,\s*\d+)*\]', '', 'g'), '(?i)SUPPORTED CLAIM|INTERPRETATION|LIMITATION', '', 'g'), '[A-Za-z0-9]{{2,}}') AS substance, length(trim(answer))::BIGINT AS chars FROM said_all LEFT JOIN a USING (conv_id, turn)"""

_TRAINING = r"list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z][a-z0-9\-]{{3,}}'), lambda w: NOT list_contains([" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(tx.STOP_WORDS))) + "], w)))"
_FILTER = rf"""{_SAID}, fl AS (SELECT conv_id, turn, i, regexp_replace(regexp_replace(l, '^\s*(?:[-*•]|\d+[.)])\s+', ''), '(?i)^\s*(?:\*\*)?(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION)(?:\*\*)?\s*:?\s*(?:\*\*)?\s*', '') AS l FROM (SELECT conv_id, turn, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS l FROM (SELECT conv_id, turn, [trim(y) FOR y IN string_split_regex(trim(answer), '\r?\n')] AS x FROM said_all)) WHERE l <> '' AND NOT starts_with(l, '#')),
fp AS (SELECT conv_id, turn, i, unnest(range(1, len(ps) + 1)) AS j, unnest(ps) AS p FROM (SELECT *, [regexp_replace(x, '^[ *_]+|[ *_]+$', '', 'g') FOR x IN string_split(regexp_replace(l, '([.!?])\s+([A-Z\[("''*])', '\1' || chr(31) || '\2', 'g'), chr(31))] AS ps FROM fl)),
fi AS (SELECT *, sum((NOT regexp_matches(p, '(?i)^(?:\[\d+\])+(?:\s+(?:SUPPORTED CLAIM|INTERPRETATION|LIMITATION))?\W*$'))::INT) OVER (PARTITION BY conv_id, turn, i ORDER BY j) AS g FROM fp WHERE p <> ''),
fs AS (SELECT conv_id, turn, i, g, string_agg(p, ' ' ORDER BY j) AS s FROM fi GROUP BY ALL), fc AS (SELECT * FROM fs WHERE len({_UWORDS.format(_NO_CITES)}) >= 6),
fx AS (SELECT fc.*, regexp_matches(s, '\[(\d+)\]') AS cited, regexp_matches(s, {_ABSTAIN}) AS abst, [x::BIGINT FOR x IN regexp_extract_all(s, '\[(\d+)\]', 1)] AS cids, regexp_replace(s, '\[(\d+)\]', '', 'g') AS bare, ev, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, g) AS o FROM fc JOIN said_all USING (conv_id, turn)),
fw AS (SELECT *, {_TRAINING.format('bare')} AS w, [coalesce(ev[c], '') FOR c IN cids] AS blocks FROM fx),
fy AS (SELECT *, array_to_string(blocks, ' ') AS joined FROM fw),
fz AS (SELECT conv_id, turn, o, cited, (cited OR NOT abst) AS counts, regexp_matches(s, '{an.META.replace(chr(39), chr(39) * 2)}') AS meta, CASE WHEN NOT cited THEN NULL WHEN len(list_filter(regexp_extract_all(bare, '\d+(?:\.\d+)?'), lambda n: NOT contains(joined, n))) > 0 THEN 'number_not_in_evidence' WHEN NOT abst AND len(w) > 0 AND len(list_filter(blocks, lambda b: len(list_intersect(w, {_TRAINING.format('b')})) / len(w) < 0.2)) > 0 THEN 'irrelevant_citation' END AS why,
  CASE WHEN cited AND len(w) > 0 THEN len(list_intersect(w, {_TRAINING.format('joined')})) / len(w) END AS recall FROM fy),
fa AS (SELECT conv_id, turn, bool_or(meta) AS meta, sum(counts::INT) AS n_some, sum((counts AND cited)::INT) AS n_cited, arg_min(why, o) AS why, count(recall) AS n_recall, avg(recall) AS mean, sum((recall < 0.4)::INT) / nullif(count(recall), 0) AS weak FROM fz GROUP BY 1, 2),
rs AS (SELECT conv_id, turn, CASE WHEN trim(answer) = '' THEN 'empty' WHEN contains(answer, 'unsupported — could not be verified') THEN 'contains_unsupported_note' WHEN NOT regexp_matches(answer, '\[\d+\]') THEN 'no_citations' WHEN len(list_filter([x::BIGINT FOR x IN regexp_extract_all(answer, '\[(\d+)\]', 1)], lambda c: NOT list_contains(ids, c))) > 0 THEN 'invalid_citation_id'
 WHEN coalesce(meta, false) THEN 'meta_commentary' WHEN coalesce(n_some, 0) < 2 THEN 'too_few_sentences' WHEN n_cited / n_some < 0.7 THEN 'low_citation_coverage' WHEN why IS NOT NULL THEN why WHEN coalesce(n_recall, 0) = 0 THEN 'nothing_to_ground' WHEN mean < 0.55 OR weak > 0.25 THEN 'weak_grounding'
 WHEN len(ls) > 4 AND len(ls) > len(list_distinct(ls)) THEN 'repeated_lines' ELSE 'ok' END AS reason FROM (SELECT *, list_filter([trim(x) FOR x IN string_split_regex(answer, '\r?\n')], lambda x: x <> '') AS ls FROM said_all) LEFT JOIN fa USING (conv_id, turn))"""
SQL["answer_filter"] = f"WITH {_FILTER} SELECT * FROM rs"
SQL["rejection_reasons"] = f"WITH {_FILTER} SELECT reason, count(*) AS n FROM rs GROUP BY 1"

SQL["pair_pools"] = f"""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {v.DRAW.format("'42|' || doc_id::VARCHAR")}, doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
q AS (SELECT source, doc_id, n, (p + unnest(range(1, greatest(least(ceil(30 / n)::BIGINT + 1, n // 2), 1) + 1))) % n AS q FROM p WHERE n > 1), u AS (SELECT DISTINCT q.source, least(q.doc_id, o.doc_id) AS first, greatest(q.doc_id, o.doc_id) AS second FROM q JOIN p o ON o.source = q.source AND o.p = q.q)
SELECT source, first, second FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY {v.DRAW.format("'42|' || first::VARCHAR || '|' || second::VARCHAR")}, first, second) <= 30"""


# More of claims and answers -------------------------------------------------------------------------------------------


@query(rf"""WITH {_FILTER} SELECT conv_id, turn, round(sum(cited::INT) / count(*), 6) AS sentence_coverage, bool_or(cited) AS cites_any FROM fz GROUP BY 1, 2""")
def sentence_coverage(spark, sf):
    """Of an answer's content sentences the share that cites."""
    rows = scoring._answers(spark, sf).withColumn("s", an.content_sentences(an.normalized(F.col("answer")))).filter(F.size("s") > 0)
    cites = F.filter("s", lambda x: x.rlike(an.CITE))
    return rows.select("conv_id", "turn", F.round(F.size(cites) / F.size("s"), 6).alias("sentence_coverage"), (F.size(cites) > 0).alias("cites_any"))


@query(rf"""WITH {_FILTER}, c AS (SELECT conv_id, turn, [x::BIGINT FOR x IN regexp_extract_all(answer, '\[(\d+)\]', 1)] AS cids, ids FROM said_all)
SELECT conv_id, turn, len(cids) > 0 AS cites_any, len(cids) > 0 AND len(list_filter(cids, lambda x: NOT list_contains(ids, x))) = 0 AS valid_ids, reason = 'ok' AS passes_checker, len(cids)::BIGINT AS num_citations FROM c JOIN rs USING (conv_id, turn)""")
def citation_eval(spark, sf):
    """Stored answers scored anew: their evidence comes out of the context they were given."""
    rows = scoring._answers(spark, sf)
    blocks = rows.select("conv_id", "turn", F.explode("evidence").alias("citation_id", "text"))
    contexts = aw.context_text(blocks, "conv_id", "turn")
    again = rows.drop("evidence").join(contexts, ["conv_id", "turn"]).withColumn("evidence", aw.evidence_of(F.col("context")))
    checked = an.checked(again.withColumn("answer", an.normalized(F.col("answer"))))
    ids = F.transform(tx.all_of(F.col("answer"), an.CITE, 1), lambda x: x.cast("int"))
    known = F.map_keys("evidence")
    return checked.select("conv_id", "turn", (F.size(ids) > 0).alias("cites_any"), ((F.size(ids) > 0) & F.forall(ids, lambda i: F.array_contains(known, i))).alias("valid_ids"), (F.col("reason") == "ok").alias("passes_checker"), F.size(ids).alias("num_citations"))


@query(rf"""WITH {answering._PAIRS} SELECT count(*) FILTER (block IS NULL OR len(missing) > 0 OR overlap < 0.45) AS flagged, count(*) AS n FROM fx""")
def flagged_claims(spark, sf):
    got = answering._with_blocks(*answering._numbered(spark, sf))
    return got.agg(F.sum(F.when(F.col("grounding") == "none", 1).otherwise(0)).alias("flagged"), F.count("*").alias("n"))


@query(r"""SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS taken, 'First. Bad one.' || ' (!)' || ' Last.' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- gone (!)' ELSE '' END AS annotated, 'kept' AS stripped FROM documents""")
def regeneration(spark, sf):
    """Revised answers: taken if they cite no less and have less that is unsupported; what stays unsupported is marked;
    echoed instructions go."""
    n = F.col("doc_id")
    half = lambda c: F.when(c, 0.5).otherwise(1.0)
    taken = cl.better(F.lit(0.5), F.when(n % 3 == 0, 0.4).otherwise(0.5), F.lit(1.0), half(n % 2 == 0))
    unsupported = F.when(n % 2 == 0, F.array(F.lit("Bad one."), F.lit("gone"))).otherwise(F.array(F.lit("Bad one.")))
    text = cl.without_scaffold(F.lit("The following statements from that answer could not be verified:\n- one\n\nkept"))
    return v.table(spark, sf, "documents").select("doc_id", taken.alias("taken"), cl.annotated(F.lit("First. Bad one. Last."), unsupported, "(!)").alias("annotated"), text.alias("stripped"))


@query(r"""SELECT item_id, '**' || item_id || '** and [2], [3]' AS line, ['bold:' || item_id, 'text: and ', 'cite:2', 'text:, ', 'cite:3']::VARCHAR AS parts FROM benchmark""".replace("::VARCHAR AS parts", " AS p").replace("SELECT item_id, '**'", "SELECT item_id, array_to_string(p, '|') AS parts, line FROM (SELECT item_id, '**'").replace("FROM benchmark", "FROM benchmark)"))
def inline_marks(spark, sf):
    """A line cut into bold stretches, citations and the text between."""
    line = F.concat(F.lit("**"), F.col("item_id").cast("string"), F.lit("** and [2], [3]"))
    return v.table(spark, sf, "benchmark").select("item_id", line.alias("line"), F.array_join(F.transform(tx.inline(line), lambda x: F.concat(x["kind"], F.lit(":"), x["text"])), "|").alias("parts"))
