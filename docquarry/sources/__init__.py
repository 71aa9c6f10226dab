"""Readers and writers of the engine's file formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources import storage

CHUNK = "chunk_id string, document_id string, page_number int, section string, text string, token_count int, chunk_type string, label string, image_path string"
PAPER = f"document_id string, title string, authors array<string>, year int, source string, filename string, num_pages int, status string, uploaded_at timestamp, chunks array<struct<{CHUNK.replace(' ', ':').replace(',:', ',')}>>"
CORRUPT = "_corrupt_record string"
#: Fields that a training example keeps on disk.
EXAMPLE_FIELDS = ["instruction", "context", "response", "provenance"]
#: Limits of a downloaded file: what it begins with, and its bytes.
MAGIC, MOST_BYTES = "%PDF", 12 * 1024 * 1024


def _none(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Processed papers, one JSON file each, in any depth; unreadable files and papers without chunks are left out, and a
    folder that isn't there has none."""
    if not storage.exists(spark, path):
        return _none(spark, PAPER)
    papers = spark.read.schema(f"{PAPER}, {CORRUPT}").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return papers.filter(F.col("_corrupt_record").isNull() & (F.size("chunks") > 0)).drop("_corrupt_record")


def searchable(papers: DataFrame) -> DataFrame:
    """Papers that have a text layer."""
    return papers.filter("status is null or status <> 'scanned_needs_ocr'")


def chunks_of(papers: DataFrame) -> DataFrame:
    """Chunks to index: not of scanned papers, and no running text of reference lists. The title comes with each."""
    rows = searchable(papers).select(F.coalesce("title", "document_id").alias("title"), F.explode("chunks").alias("c")).select("title", "c.*")
    return rows.filter(~((F.col("section") == "References") & (F.coalesce("chunk_type", F.lit("text")) == "text")))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return chunks_of(read_papers(spark, path))


def write_papers(papers: DataFrame, path: str) -> None:
    """A folder of JSON for each paper, named by its id; a paper's is replaced when it comes again."""
    papers.withColumn("__id", F.col("document_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__id").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and malformed ones are left out, and a path that isn't there has none."""
    if not storage.exists(spark, path):
        return _none(spark, schema)
    rows = spark.read.schema(f"{schema}, {CORRUPT}").option("mode", "PERMISSIVE").json(path)
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def write_jsonl(rows: DataFrame, path: str, fields: list[str] = EXAMPLE_FIELDS) -> None:
    """Lines of JSON with the named fields; the others are for internal use."""
    rows.select(*fields).write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str, fields: list[str] = EXAMPLE_FIELDS) -> str | None:
    """A folder of JSON lines for each split. A data set that is there already is kept beside the new one; its path."""
    spark = rows.sparkSession
    backup = None
    if storage.exists(spark, path):
        backup = f"{path}-before"
        if not storage.exists(spark, backup):
            storage.move(spark, path, backup)
    rows.select(*fields, "split").write.mode("overwrite").partitionBy("split").json(path)
    return backup


def read_splits(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All splits of a data set, with the column `split`."""
    return spark.read.schema(f"{schema}, split string").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files in any depth, with their paths as `file`: those that hold one JSON object, read by the schema; others (lists, broken
    ones) are left out, and a folder that isn't there has none."""
    if not storage.exists(spark, path):
        return _none(spark, f"file string, {schema}")
    # binaryFile and not text: a file is one value
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)
    text = F.trim(F.decode("content", "UTF-8"))
    rows = files.select(F.col("path").alias("file"), text.alias("t")).filter(F.col("t").startswith("{"))
    rows = rows.withColumn("r", F.from_json("t", f"{schema}, {CORRUPT}", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return rows.filter(F.col("r._corrupt_record").isNull()).select("file", "r.*").drop("_corrupt_record")


def write_result(result: DataFrame, path: str, stamp: str) -> None:
    """A result under its time and as the latest."""
    for name in (stamp, "latest"):
        result.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], glob: str = "*", fallback: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Files of a folder as pages (document_id, page_number, text, parse_error), in order of name and page.

    parse: bytes -> pages, a plug-in; a page may be an error instead of a text. Where a page is one, `fallback` (bytes,
    page from 1) gives its text, and the row keeps the error. A file on which parse fails gives one row with the error
    and the rest of the files are read."""
    import pandas as pd

    def clean(text: str) -> str:
        return text.replace("\0", "").encode("utf-8", "ignore").decode("utf-8").strip()

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for i, page in enumerate(parse(bytes(content)), 1):
                        if isinstance(page, Exception):
                            text = clean(fallback(bytes(content), i)) if fallback else None
                            rows.append((name, i, text, repr(page)))
                        else:
                            rows.append((name, i, clean(page), None))
                except Exception as e:  # one bad file must not end the scan
                    rows.append((name, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "parse_error"]).astype({"page_number": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(run, "document_id string, page_number int, text string, parse_error string").orderBy("document_id", "page_number")


def pages_of(docs: DataFrame, key: str, mark: str = "\f|\n") -> DataFrame:
    """(key, page_number from 1, text) of texts whose pages a mark parts; texts are stripped, empty pages stay."""
    cut = docs.select(key, F.posexplode(F.split("text", mark)).alias("__n", "text"))
    return cut.select(key, (F.col("__n") + 1).alias("page_number"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def looked_up(wanted: DataFrame, first: DataFrame, spare: DataFrame | None = None, key: str = "chunk_id", value: str = "text") -> DataFrame:
    """wanted (key) with the value of first or, where that has none, of spare; null where neither has one."""
    out = wanted.join(first.select(key, F.col(value).alias("__a")), key, "left")
    if spare is None:
        return out.withColumnRenamed("__a", value)
    return out.join(spare.select(key, F.col(value).alias("__b")), key, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def atom_entries(feed: Column) -> Column:
    """(id without version, title, summary, year, authors) of each entry of an Atom feed; white space becomes one space."""
    bare = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    get = lambda x, p: F.xpath_string(x, F.lit(f"entry/{p}"))
    each = F.regexp_extract_all(feed, F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))
    entry = lambda x: F.struct(
        F.regexp_replace(F.regexp_extract(get(x, "id"), r"[^/]+$", 0), r"v\d+$", "").alias("id"),
        bare(get(x, "title")).alias("title"),
        bare(get(x, "summary")).alias("summary"),
        F.substring(get(x, "published"), 1, 4).cast("int").alias("year"),
        F.transform(F.xpath(x, F.lit("entry/author/name/text()")), bare).alias("authors"),
    )
    return F.transform(each, entry)


def download_fault(status: Column, content: Column, magic: str = MAGIC, most: int = MOST_BYTES) -> Column:
    """Why a downloaded file isn't taken: its status, what it begins with, or its size; null if it is."""
    return F.when(status != 200, "status").when(~F.coalesce(content.startswith(magic), F.lit(False)), "magic").when(F.octet_length(content) > most, "size")


def missing_of(manifest: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What a manifest lists and isn't there."""
    return manifest.join(present.select(key), key, "left_anti")


def questions_of(rows: DataFrame, built_in: list[str]) -> DataFrame:
    """(n, question): the field `question`, else `query`; rows with neither are left out, and if none is left the built-in
    questions stand in."""
    spark = rows.sparkSession
    own = rows.select("n", F.coalesce(F.nullif("question", F.lit("")), F.nullif("query", F.lit(""))).alias("question")).filter("question is not null")
    spare = spark.createDataFrame(list(enumerate(built_in)), "n long, question string")
    return own if not own.isEmpty() else spare
