"""From files to processed papers in one call: pages, scanned ones apart, metadata, sections, chunks of text, tables and
figures, a row for each document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import sources as so
from docquarry.operators import documents as dc
from docquarry.sources import storage
from docquarry.sources.settings import Settings

_KINDS = ["text", "table", "figure"]


def processed(documents: DataFrame, pages: DataFrame, tables: DataFrame | None = None, figures: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Processed papers (sources.PAPER), a row for each of documents (document_id, filename, source, uploaded_at).

    pages: (document_id, page_number, text), all there are; tables: (document_id, page_number, idx, caption, label, grid);
    figures: (document_id, page_number, idx, caption, label, figure_text, image_path). A document without pages, or with
    fewer than SCANNED_CHARS characters on a mean page, is `scanned_needs_ocr` and has no chunks, whatever its tables. The
    title is the first line with text of the first page, or the file's name; the year is the first on that page. A table's
    or figure's section is that of its page. Chunk sizes are those of the settings."""
    settings = settings or Settings()
    pages = storage.written(pages.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text")))
    known = dc.is_scanned(pages, documents)
    first = pages.groupBy("document_id").agg(F.min_by("text", "page_number").alias("first"), F.count("*").alias("n"))
    read = known.filter("not scanned").select("document_id")
    text = pages.join(read, "document_id", "left_semi")
    parts = [dc.document_chunks(text, settings.chunk_size, settings.overlap, settings.min_tokens).withColumn("image_path", F.lit(None).cast("string"))]
    sections = dc.page_section(text.withColumn("hint", F.lit(""))).select("document_id", "page_number", "section")
    if tables is not None:
        parts.append(dc.table_chunks(tables.join(sections, ["document_id", "page_number"]), settings.chunk_size).withColumn("image_path", F.lit(None).cast("string")))
    if figures is not None:
        held = figures.join(sections, ["document_id", "page_number"])
        images = held.select("document_id", "page_number", "label", "image_path").dropDuplicates(["document_id", "page_number", "label"])
        parts.append(dc.figure_chunks(held).join(images, ["document_id", "page_number", "label"], "left"))
    names = ["chunk_id", "document_id", "page_number", "section", "text", "token_count", "chunk_type", "label", "image_path"]
    every = parts[0].select(*names)
    for part in parts[1:]:
        every = every.unionByName(part.select(*names))
    number = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int")
    chunk = F.struct(*(F.col(n).cast(t).alias(n) for n, t in (x.strip().split(" ") for x in so.CHUNK.split(","))))
    order = F.struct("page_number", F.array_position(F.array(*map(F.lit, _KINDS)), F.col("chunk_type")).alias("k"), number.alias("i"), chunk.alias("c"))
    made = every.withColumn("o", order).groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: x["c"]).alias("chunks"))
    rows = known.join(first, "document_id", "left").join(made, "document_id", "left")
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    title = F.when(F.col("scanned") | (F.trim(F.coalesce("first", F.lit(""))) == ""), stem).otherwise(dc.title_of(F.col("first")))
    return rows.select(
        F.col("document_id").cast("string").alias("document_id"),
        title.alias("title"),
        F.array().cast("array<string>").alias("authors"),
        F.when(~F.col("scanned"), dc.year_of(F.coalesce("first", F.lit("")))).alias("year"),
        "source",
        "filename",
        F.when(F.col("scanned"), 0).otherwise(F.coalesce("n", F.lit(0))).cast("int").alias("num_pages"),
        F.when(F.col("scanned"), "scanned_needs_ocr").otherwise("indexed").alias("status"),
        F.col("uploaded_at").cast("timestamp").alias("uploaded_at"),
        F.when(F.col("scanned") | F.col("chunks").isNull(), F.array().cast(f"array<struct<{so.CHUNK.replace(' ', ':').replace(',:', ',')}>>")).otherwise(F.col("chunks")).alias("chunks"),
    )


def ingested(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], out: str, glob: str = "*", fallback: Callable[[bytes, int], str] | None = None, settings: Settings | None = None) -> DataFrame:
    """The files of a folder read, processed and written as papers to `out`; what was written, and a row (status `failed`,
    no chunks) for each file that can't be read, which isn't written. parse and fallback: see sources.read_pages. An id is
    made of a file's content and name, so the same file is the same document again."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    listed = storage.written(files.select("path", name.alias("filename"), dc.document_key(F.col("content"), F.regexp_replace(name, r"\.[^.]*$", "")).alias("document_id"), F.col("modificationTime").alias("uploaded_at"), F.lit("upload").alias("source")))
    found = storage.written(so.read_pages(spark, path, parse, glob, fallback).withColumnRenamed("document_id", "path"))
    broken = found.filter("page_number is null").select("path", "parse_error")
    pages = found.filter("page_number is not null").join(listed.select("path", "document_id"), "path")
    good = listed.join(broken, "path", "left_anti")
    papers = storage.written(processed(good, pages, settings=settings))
    so.write_papers(papers, out)
    lost = listed.join(broken, "path").select("document_id", "filename", F.col("parse_error").alias("error"))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in papers.dtypes}
    lost = lost.select(*(F.col(c) if c in ("document_id", "filename") else F.lit("failed").alias(c) if c == "status" else F.col("filename").alias(c) if c == "title" else empty[c] for c in papers.columns), "error")
    return papers.withColumn("error", F.lit(None).cast("string")).unionByName(lost)
