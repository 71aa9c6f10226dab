"""Queries of sources, sinks, kept indexes, the catalogue and streams, with their SQL: what is written is read back."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import functions as F

from docquarry import sources as so
from docquarry import streaming as st
from docquarry.functions import text as tx
from docquarry.operators import catalogue as ca
from docquarry.operators import index as ix
from docquarry.operators import library as lb
from docquarry.plans import search
from docquarry.plans import views as v
from docquarry.sources import settings, storage
from docquarry.streaming import lifecycle as lc

SQL: dict[str, str] = {}
RUN: dict = {}


def query(sql: str | None = None):
    def add(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Indexes --------------------------------------------------------------------------------------------------------------


def _chunks(spark, sf):
    return v.corpus(spark, sf).select("chunk_id", "text")


_TOP = search._TOP.format("scored", 10)


@query(f"WITH {v.QUESTIONS}, {v.BM25} {_TOP}")
def index_roundtrip(spark, sf):
    """Built, written, loaded from its folder and searched; a folder without an index loads as none."""
    path = storage.folder(spark, "index")
    assert ix.LexicalIndex.load(spark, path) is None
    ix.LexicalIndex.build(_chunks(spark, sf), path)
    return ix.LexicalIndex.load(spark, path).search(v.questions(spark, sf), 10)


@query(f"WITH {v.QUESTIONS}, {v.BM25} {_TOP}")
def index_append(spark, sf):
    """Two thirds indexed, some under other texts; the rest and those appended: what an index of the last texts finds."""
    chunks = _chunks(spark, sf)
    odd = F.col("chunk_id") % 5 == 1
    first = chunks.filter("chunk_id % 3 <> 0").withColumn("text", F.when(odd, F.concat(F.lit("an earlier text "), F.substring("text", 1, 200))).otherwise(F.col("text")))
    index = ix.LexicalIndex.build(first, storage.folder(spark, "index"))
    return index.append(chunks.filter((F.col("chunk_id") % 3 == 0) | odd)).search(v.questions(spark, sf), 10)


_WITHOUT = v.BM25.replace("FROM documents)", "FROM documents WHERE lang <> 'es')")


@query(f"WITH {v.QUESTIONS}, {_WITHOUT} {_TOP}")
def index_remove(spark, sf):
    """Documents taken out of an index: neither found nor counted."""
    gone = v.corpus(spark, sf).filter("lang = 'es'").select("chunk_id")
    return v.lexical(spark, sf).without(gone, storage.folder(spark, "index")).search(v.questions(spark, sf), 10)


@query(f"""WITH {v.DENSE}, kept AS (SELECT * FROM dots WHERE label <> 3) {search._TOP.format('kept', 10)}""")
def vector_roundtrip(spark, sf):
    """Vectors written in two parts with their columns, one label taken out, loaded and searched."""
    rows = v.vectors(spark, sf)
    index = ix.VectorIndex.build(rows.filter("chunk_id % 2 = 0"), storage.folder(spark, "vectors"), 64).append(rows.filter("chunk_id % 2 = 1"), 64, 1)
    left = index.without(rows.filter("label = 3"), storage.folder(spark, "vectors"))
    return ix.VectorIndex.load(spark, left.path).search(v.vector_queries(spark, sf), 10)


# Files ----------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'none', NULL")
def jsonl_roundtrip(spark, sf):
    """Rows written without their internal columns; blank and broken lines, and a missing file, give nothing."""
    path = storage.folder(spark, "jsonl")
    rows = v.table(spark, sf, "conversations").withColumn("internal", F.lit(1))
    so.write_jsonl(rows, path, ["conv_id", "turn", "role", "text"])
    spark.createDataFrame([("",), ("{broken",), ('{"conv_id": -1, "turn": 0, "role": "none"}',)], "value string").write.mode("append").text(path)
    schema = "conv_id long, turn long, role string, text string"
    return so.read_jsonl(spark, path, schema).unionByName(so.read_jsonl(spark, path + "-not-there", schema))


_SECTION = "CASE WHEN doc_id % 6 = 0 THEN 'References' ELSE 'Results' END"


@query(f"""SELECT 'c' || doc_id AS chunk_id, source AS document_id, CASE WHEN source < 'src15' THEN 'Title of ' || source ELSE source END AS title, {_SECTION} AS section, CASE WHEN doc_id % 4 = 0 THEN 'table' ELSE 'text' END AS chunk_type
FROM documents WHERE source <> 'src7' AND NOT ({_SECTION} = 'References' AND doc_id % 4 <> 0)""")
def paper_scan(spark, sf):
    """Papers written as JSON and read as chunks to index: scanned ones, empty ones and broken files are left out."""
    path = storage.folder(spark, "papers")
    fields = [x.strip().split(" ") for x in so.CHUNK.split(",")]
    made = {"chunk_id": F.concat(F.lit("c"), F.col("doc_id").cast("string")), "document_id": F.col("source"), "section": F.expr(_SECTION), "text": F.substring("text", 1, 50), "chunk_type": F.when(F.col("doc_id") % 4 == 0, "table").otherwise("text")}
    chunk = F.struct(*(made.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    papers = v.table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", chunk.alias("c")))).alias("x"))
    papers = papers.select(F.col("source").alias("document_id"), F.when(F.col("source") < "src15", F.concat(F.lit("Title of "), "source")).alias("title"), F.when(F.col("source") == "src7", "scanned_needs_ocr").otherwise("indexed").alias("status"), F.transform("x", lambda s: s["c"]).alias("chunks"))
    empty = papers.limit(1).withColumn("document_id", F.lit("empty")).withColumn("chunks", F.slice("chunks", 1, 0))
    so.write_papers(papers.unionByName(empty), path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path + "/__id=broken")
    return so.read_chunks(spark, path).select("chunk_id", "document_id", "title", "section", "chunk_type")


@query("""SELECT 'indexed' AS variant, 0.5::DOUBLE AS recall, count(*)::BIGINT AS n FROM documents""")
def result_scan(spark, sf):
    """Results in any depth: one under its time and as the latest, beside lists and broken files, which aren't results;
    of each field the first, or the last, that is known."""
    path = storage.folder(spark, "results")
    n = v.table(spark, sf, "documents").agg(F.count("*").alias("n"))
    so.write_result(n.select(F.lit("indexed").alias("variant"), F.lit(None).cast("double").alias("recall"), "n"), path, "2024-01-01")
    so.write_result(spark.createDataFrame([(0.5,)], "recall double"), path + "/deep", "2024-01-02")
    for i, text in enumerate(("[1, 2]", "{broken")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/odd{i}")
    got = so.read_results(spark, path, "variant string, recall double, n long")
    return ca.first_known(got.withColumn("o", F.col("file")), "o", ["recall", "n"], ["variant"])


@query("SELECT item_id * 13 AS chunk_id, CASE WHEN item_id * 13 % 3 = 0 THEN 'a' WHEN item_id * 13 % 3 = 1 THEN 'b' END || left(d.text, 20) AS text FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id * 13 AND d.text IS NOT NULL")
def chunk_lookup(spark, sf):
    """Some chunks by id: from the index's table or else from the papers, or from neither."""
    wanted = v.table(spark, sf, "benchmark").select((F.col("item_id") * 13).alias("chunk_id"))
    docs = _chunks(spark, sf).withColumn("text", F.substring("text", 1, 20))
    kept = v.table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_id"))
    part = lambda i, mark: docs.join(kept, "chunk_id", "left_semi").filter(F.col("chunk_id") % 3 == i).withColumn("text", F.concat(F.lit(mark), "text"))
    return so.looked_up(wanted, part(0, "a"), part(1, "b"))


@query(r"""SELECT chunk_id, i + 1 AS page_number, regexp_replace(x[i + 1], '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS text FROM (SELECT doc_id AS chunk_id, string_split(coalesce(text, ''), chr(10)) AS x, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)""")
def page_scan(spark, sf):
    return so.pages_of(_chunks(spark, sf), "chunk_id")


@query("""SELECT '24' || item_id || '.00001' AS id, 'A title ' || item_id AS title, left(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), 0) || 'Of ' || item_id AS summary, (2000 + item_id % 20)::BIGINT AS year, 2::BIGINT AS n_authors FROM benchmark""")
def atom_scan(spark, sf):
    """A feed of entries: ids lose their version, white space becomes one space."""
    entry = F.concat(F.lit("<entry>\n<id>http://host/abs/24"), F.col("item_id").cast("string"), F.lit(".00001v3</id><title>A\n  title "), F.col("item_id").cast("string"), F.lit("</title><summary> Of\n"), F.col("item_id").cast("string"), F.lit(" </summary><published>"), (F.col("item_id") % 20 + 2000).cast("string"), F.lit("-03-01T00:00:00Z</published><author><name>A B</name></author><author><name>C  D</name></author></entry>"))
    feeds = v.table(spark, sf, "benchmark").groupBy((F.col("item_id") % 3).alias("page")).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), "\n"), F.lit("</feed>")).alias("feed"))
    got = feeds.select(F.explode(so.atom_entries(F.col("feed"))).alias("e")).select("e.*")
    return got.select("id", "title", "summary", "year", F.size("authors").alias("n_authors"))


@query("""SELECT source AS name, n AS page_number, CASE WHEN source = 'src3' THEN NULL WHEN n = 2 THEN 'plain ' || source ELSE source || ' page ' || n END AS text, source = 'src3' OR n = 2 AS has_error FROM (SELECT DISTINCT source FROM documents) s, range(1, 4) t(n) WHERE source <> 'src3' OR n = 1""".replace("n AS page_number", "CASE WHEN source <> 'src3' THEN n END AS page_number"))
def page_files(spark, sf):
    """A folder of files read as pages: a page that can't be parsed falls back to plain text, a broken file stands alone,
    and files of other kinds aren't read."""
    path = storage.folder(spark, "files")
    names = [r["source"] for r in v.table(spark, sf, "documents").select("source").distinct().collect()]  # a few sources
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [*(f"{n}.doc" for n in names), "other.bin"]:
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(name.encode()))
        out.close()

    def parse(content: bytes):
        name = content.decode().removesuffix(".doc")
        if name == "src3":
            raise ValueError("broken")
        return [f" {name} page 1\0", ValueError("odd page"), f"{name} page 3 "]

    got = so.read_pages(spark, path, parse, "*.doc", lambda content, page: "plain " + content.decode().removesuffix(".doc"))
    name = F.regexp_replace(F.regexp_extract("document_id", r"[^/]+$", 0), r"\.doc$", "")
    return got.select(name.alias("name"), "page_number", "text", F.col("parse_error").isNotNull().alias("has_error"))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'status' WHEN page_id % 3 = 0 THEN 'magic' WHEN strlen(html) + 4 > 2000 THEN 'size' ELSE 'ok' END AS outcome FROM pages")
def download_guard(spark, sf):
    """Which downloads are taken: by status, first bytes and size."""
    n = F.col("page_id")
    content = F.concat(F.when(n % 3 == 0, "<htm").otherwise("%PDF"), F.col("html"))
    fault = so.download_fault(F.when(n % 5 == 0, 404).otherwise(200), content, most=2000)
    return v.table(spark, sf, "pages").select("page_id", F.coalesce(fault, F.lit("ok")).alias("outcome"))


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def manifest_missing(spark, sf):
    present = v.table(spark, sf, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id"))
    return so.missing_of(v.table(spark, sf, "pages").select("page_id"), present, "page_id")


@query("SELECT item_id AS n, CASE item_id % 3 WHEN 0 THEN 'Q' || item_id ELSE 'q' || item_id END AS question FROM benchmark WHERE item_id % 3 < 2 UNION ALL SELECT 0, 'What is known?' UNION ALL SELECT 1, 'What is not?'")
def question_source(spark, sf):
    """The question, else the query; without any the built-in ones."""
    n = F.col("item_id")
    rows = v.table(spark, sf, "benchmark").select(n.alias("n"), F.when(n % 3 == 0, F.concat(F.lit("Q"), n.cast("string"))).alias("question"), F.when(n % 3 == 1, F.concat(F.lit("q"), n.cast("string"))).when(n % 3 == 0, "other").alias("query"))
    built_in = ["What is known?", "What is not?"]
    return so.questions_of(rows, built_in).unionByName(so.questions_of(rows.filter("false"), built_in))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY 1")
def splits_roundtrip(spark, sf):
    """A data set written by split and read whole."""
    path = storage.folder(spark, "splits")
    rows = v.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    so.write_splits(rows, path, ["doc_id"])
    return so.read_splits(spark, path, "doc_id long").groupBy("split").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


@query("SELECT 'before' AS state, count(*) AS n FROM documents UNION ALL SELECT 'now', count(*) FROM documents WHERE doc_id % 3 = 0")
def split_finalize(spark, sf):
    """Accepted rows checked anew with today's rule and written; what was there before is kept beside."""
    path = storage.folder(spark, "splits")
    rows = v.table(spark, sf, "documents").select("doc_id", F.lit("train").alias("split"))
    so.write_splits(rows, path, ["doc_id"])
    before = so.write_splits(rows.filter("doc_id % 3 = 0"), path, ["doc_id"])
    count = lambda p, s: so.read_splits(spark, p, "doc_id long").agg(F.lit(s).alias("state"), F.count("*").alias("n"))
    return count(before, "before").unionByName(count(path, "now"))


_DEFAULTS = "[" + ", ".join(f"{{'name': '{f.name}', 'value': '{f.default}'}}" for f in dataclasses.fields(settings.Settings) if f.name != "extra") + "]"


@query(f"""WITH s AS (SELECT source, count(*) AS n, min(lang) AS lang FROM documents GROUP BY 1), base AS (SELECT source, unnest({_DEFAULTS}) AS d FROM s),
own AS (SELECT source, 'chunk_size' AS name, n::VARCHAR AS value FROM s UNION ALL SELECT source, 'overlap', '50' FROM s UNION ALL SELECT source, 'model', lang FROM s),
over AS (SELECT source, 'overlap' AS name, (n % 7)::VARCHAR AS value FROM s WHERE n % 2 = 0 UNION ALL SELECT source, 'k1', '1.2' FROM s WHERE n % 2 = 1),
names AS (SELECT source, d.name AS name FROM base UNION SELECT source, name FROM own UNION SELECT source, name FROM over)
SELECT n.source AS deployment, n.name, coalesce(o.value, w.value, b.d.value) AS value FROM names n LEFT JOIN over o USING (source, name) LEFT JOIN own w USING (source, name) LEFT JOIN base b ON b.source = n.source AND b.d.name = n.name""")
def settings_effective(spark, sf):
    """A deployment for each source: its file's values, those of its environment over them, and defaults."""
    rows = v.table(spark, sf, "documents").groupBy(F.col("source").alias("deployment")).agg(F.count("*").alias("n"), F.min("lang").alias("lang"))
    n = F.col("n").cast("string")
    text = F.concat(F.lit("# file\nchunk_size: "), n, F.lit(" # a size\n\nOverlap = 50\nmodel: '"), F.col("lang"), F.lit("'\nno value here\n"))
    even = F.col("n") % 2 == 0
    name, value = F.when(even, "DOCQUARRY_OVERLAP").otherwise("DOCQUARRY_K1"), F.when(even, (F.col("n") % 7).cast("string")).otherwise("1.2")
    environments = rows.select("deployment", name.alias("name"), value.alias("value")).unionByName(rows.select("deployment", F.lit("OTHER").alias("name"), n.alias("value")))
    return settings.effective(rows.select("deployment", text.alias("text")), environments)


# Catalogue ------------------------------------------------------------------------------------------------------------


@query("SELECT source AS document_id, 'Untitled' AS title, 0::BIGINT AS num_chunks, 'uploaded' AS status, count(*) AS made FROM documents GROUP BY source")
def catalogue_defaults(spark, sf):
    """A table that is made once, filled with ids alone: the rest are its defaults."""
    name, path = f"catalogue_{uuid.uuid4().hex}", storage.folder(spark, "catalogue")
    ca.create_catalogue(spark, name, path)
    ca.create_catalogue(spark, name, path)
    v.table(spark, sf, "documents").createOrReplaceTempView(f"{name}_docs")
    spark.sql(f"INSERT INTO {name} (document_id) SELECT DISTINCT source FROM {name}_docs")
    counts = v.table(spark, sf, "documents").groupBy(F.col("source").alias("document_id")).agg(F.count("*").alias("made"))
    return spark.table(name).drop("error_message").join(counts, "document_id")


@query("SELECT doc_id AS document_id, n_chars AS uploaded_at, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents")
def catalogue_list(spark, sf):
    """Documents, the latest first."""
    rows = v.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("uploaded_at"))
    from docquarry.operators import order as od

    return od.placed(rows.withColumn("away", -F.col("uploaded_at")), "away", "document_id").drop("away")


@query("""WITH p AS (SELECT source, count(*) AS n, CASE WHEN source = 'src3' THEN 'scanned_needs_ocr' ELSE 'indexed' END AS status FROM documents GROUP BY 1)
SELECT source AS document_id, CASE WHEN source IN ('src1', 'src2') THEN source || '.pdf' WHEN source = 'src4' THEN source ELSE 'T ' || source END AS title, n AS num_chunks, status, status = 'scanned_needs_ocr' AS has_error, CASE WHEN source < 'src15' THEN 1 ELSE 2 END::BIGINT AS uploaded_at FROM p""")
def register_papers(spark, sf):
    """Papers put into a catalogue that knows some of them, twice: times of known ones stay, titles fall back."""
    s = F.col("source")
    papers = v.table(spark, sf, "documents").groupBy(s.alias("document_id")).agg(F.count("*").alias("num_chunks"))
    d = F.col("document_id")
    papers = papers.select(d, F.when(d.isin("src1", "src2", "src4"), "").otherwise(F.concat(F.lit("T "), d)).alias("title"), F.when(d == "src4", "").otherwise(F.concat(d, F.lit(".pdf"))).alias("filename"), "num_chunks", F.when(d == "src3", "scanned_needs_ocr").otherwise("indexed").alias("status"), F.lit(2).cast("long").alias("uploaded_at"))
    old = papers.filter(d < "src15").select("document_id", F.lit("old").alias("title"), "num_chunks", "status", F.lit(None).cast("string").alias("error_message"), F.lit(1).cast("long").alias("uploaded_at"))
    got = ca.registered(papers, ca.registered(papers, old))
    return got.select("document_id", "title", "num_chunks", "status", F.col("error_message").isNotNull().alias("has_error"), "uploaded_at")


@query("SELECT 0::BIGINT AS before, count(DISTINCT source) AS after FROM documents")
def publish_order(spark, sf):
    """Papers are in the catalogue only once their index is there."""
    papers = v.table(spark, sf, "documents").select(F.col("source").alias("document_id")).distinct().select("document_id", F.lit("t").alias("title"), F.lit("f").alias("filename"), F.lit(1).alias("num_chunks"), F.lit("indexed").alias("status"), F.lit(1).alias("uploaded_at"))
    none = papers.filter("false").select("document_id", "title", "num_chunks", "status", F.lit("").alias("error_message"), "uploaded_at")
    path = storage.folder(spark, "index")
    before = ca.published(path, papers, none, spark).agg(F.count("*").alias("before"))
    ix.LexicalIndex.build(v.questions(spark, sf).withColumnRenamed("query_id", "chunk_id"), path)
    return before.crossJoin(F.broadcast(ca.published(path, papers, none, spark).agg(F.count("*").alias("after"))))


def _library(spark, sf):
    """Sources as papers, and each document as a chunk of its source."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    papers = docs.groupBy("document_id").agg(F.count("*").alias("num_chunks"))
    papers = papers.select("document_id", F.concat(F.lit("T "), "document_id").alias("title"), F.lit("f").alias("filename"), "num_chunks", F.lit("indexed").alias("status"), F.lit(1).cast("long").alias("uploaded_at"))
    return papers, docs


@query("""WITH a AS (SELECT 'src' || (item_id % 30) AS source FROM benchmark WHERE item_id % 4 = 0), l AS (SELECT * FROM documents WHERE source NOT IN (SELECT source FROM a))
SELECT DISTINCT source, CASE WHEN source IN (SELECT source FROM documents) THEN 'deleted' ELSE 'not_found' END AS outcome, (SELECT count(*) FROM l) AS left_over, (SELECT count(*) FROM l) AS indexed, (SELECT count(DISTINCT source) FROM l) AS listed FROM a""")
def delete_outcomes(spark, sf):
    """Documents deleted from a stored library: which weren't there, and what catalogue, chunks and index have left."""
    papers, chunks = _library(spark, sf)
    library = lb.Library(spark, storage.folder(spark, "library")).put(papers, chunks)
    asked = v.table(spark, sf, "benchmark").filter("item_id % 4 = 0").select(F.concat(F.lit("src"), (F.col("item_id") % 30).cast("string")).alias("document_id"))
    _, outcome = library.delete(asked)
    now = lb.Library(spark, library.path)
    counts = now.table("chunks").agg(F.count("*").alias("left_over")).crossJoin(now.index.chunk_ids.agg(F.count("*").alias("indexed"))).crossJoin(now.catalogue.agg(F.count("*").alias("listed")))  # one row each
    return outcome.withColumnRenamed("document_id", "source").crossJoin(F.broadcast(counts))


@query(f"""WITH corpus AS (SELECT doc_id::VARCHAR AS chunk_id, CASE WHEN source IN ('src1', 'src2') THEN 'replaced ' || left(coalesce(text, ''), 100) ELSE coalesce(text, '') END AS text FROM documents WHERE source NOT IN ('src3', 'src4') AND NOT (source = 'src2' AND doc_id % 2 = 0)),
{v.QUESTIONS}, {v.BM25.split("," + chr(10), 1)[1]} {_TOP}""")
def library_search(spark, sf):
    """A library into which papers are put, two of them again with other chunks, and of which two are deleted: a search
    finds what an index of the last chunks finds."""
    papers, chunks = _library(spark, sf)
    library = lb.Library(spark, storage.folder(spark, "library")).put(papers, chunks)
    again = F.col("document_id").isin("src1", "src2")
    other = chunks.filter(again & ~((F.col("document_id") == "src2") & (F.col("chunk_id").cast("long") % 2 == 0)))
    library = library.put(papers.filter(again), other.withColumn("text", F.concat(F.lit("replaced "), F.substring("text", 1, 100))))
    library.delete(spark.createDataFrame([("src3",), ("src4",)], "document_id string"))
    return lb.Library(spark, library.path).index.search(v.questions(spark, sf), 10)


# Streams --------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_resume(spark, sf):
    """Files worked off in two runs with repeats between them: every key once."""
    src, out, mark = (storage.folder(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    rows = v.table(spark, sf, "events").select("event_id", "event_type", "value")
    rows.filter("event_id % 2 = 0").repartition(3).write.parquet(src)
    st.append_new(spark, src, rows.schema, out, mark, lambda d: d, "event_id", files=2)
    rows.filter("event_id % 2 = 1 or event_id % 10 = 0").repartition(3).write.mode("append").parquet(src)
    st.append_new(spark, src, rows.schema, out, mark, lambda d: d, "event_id", files=2)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH {v.QUESTIONS}, {v.BM25} {_TOP}")
def stream_index(spark, sf):
    """An index that grows with the files that come."""
    src, mark, path = (storage.folder(spark, n) for n in ("stream-in", "stream-mark", "index"))
    chunks = _chunks(spark, sf)
    ix.LexicalIndex.build(chunks.filter("chunk_id % 2 = 0"), path)
    chunks.filter("chunk_id % 2 = 1").repartition(2).write.parquet(src)
    st.index_new(spark, src, chunks.schema, path, mark, files=1)
    return ix.LexicalIndex.load(spark, path).search(v.questions(spark, sf), 10)


@query("SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 16 AS batch FROM conversations")
def micro_batches(spark, sf):
    return st.micro_batches(v.table(spark, sf, "conversations").select("conv_id", "turn"), 16, "conv_id", "turn")


_STATE = "CASE event_type WHEN 'view' THEN 'uploaded' WHEN 'click' THEN 'parsing' WHEN 'purchase' THEN 'indexed' WHEN 'search' THEN 'failed' ELSE 'indexing' END"


@query(f"""WITH e AS (SELECT user_id, ts, {_STATE} AS status FROM events) SELECT user_id AS document_id, arg_max(status, (ts, list_position(['uploaded', 'parsing', 'indexing', 'scanned_needs_ocr', 'failed', 'indexed'], status))) AS status FROM e GROUP BY 1""")
def document_states(spark, sf):
    rows = v.table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.expr(_STATE).alias("status"), F.col("ts").alias("at"))
    return st.latest_states(rows).select("document_id", "status")


@query(f"""WITH e AS (SELECT user_id, ts, {_STATE} AS status FROM events) SELECT user_id AS document_id, arg_max(status, (ts, list_position(['uploaded', 'parsing', 'indexing', 'scanned_needs_ocr', 'failed', 'indexed'], status))) AS status FROM e GROUP BY 1""")
def stream_states(spark, sf):
    """Changes that come in two runs of a stream, not in order of time: what it holds is what all changes together give."""
    src, out, mark = (storage.folder(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    rows = v.table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("document_id"), F.expr(_STATE).alias("status"), F.col("ts").cast("timestamp").alias("at"))
    for half in (0, 1):
        rows.filter(F.col("event_id") % 2 == half).drop("event_id").repartition(2).write.mode("append").parquet(src)
        lc.follow(spark, src, rows.drop("event_id").schema, out, mark, late="36500 days", stuck=10**15, files=8)
    return lc.current(spark, out).select(F.col("document_id").cast("long").alias("document_id"), "status")


@query("SELECT CASE WHEN text IS NULL THEN 'failed' WHEN n_chars < 200 THEN 'scanned_needs_ocr' WHEN doc_id % 50 = 7 THEN 'failed' ELSE 'indexed' END AS status, count(*) AS n FROM documents GROUP BY 1".replace("WHEN n_chars < 200 THEN 'scanned_needs_ocr' WHEN doc_id % 50 = 7 THEN 'failed'", "WHEN doc_id % 50 = 7 THEN 'failed' WHEN n_chars < 200 THEN 'scanned_needs_ocr'"))
def failures_apart(spark, sf):
    """Documents worked on one by one: a failing one fails alone."""
    docs = v.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), (F.col("n_chars") < 200).alias("scanned"), "text")
    fault = F.when(F.col("text").isNull(), "no text").when(F.col("document_id") % 50 == 7, "made up")
    return st.worked(docs, fault).groupBy("status").agg(F.count("*").alias("n"))
