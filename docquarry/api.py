"""The service's routes as functions on tables: many requests at once, each a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import sources as so
from docquarry.operators import answering as aw
from docquarry.operators import catalogue as ca
from docquarry.operators import claims as cl
from docquarry.operators import documents as dc
from docquarry.operators import evaluation as ev
from docquarry.operators import index as ix
from docquarry.operators import retrieval as rt
from docquarry.operators.library import Library
from docquarry.sources import storage

MOST_PAPERS, EVIDENCE = 15, 8


def upload(files: DataFrame) -> DataFrame:
    """Catalogue rows of uploaded files (name, content, uploaded_at): the id is made of the content and the name. A file
    that is empty or no document is `failed`, with the reason."""
    fault = F.when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty file").when(~F.lower("name").rlike(r"\.(pdf|txt|json)$"), "not a document")
    key = dc.document_key(F.coalesce("content", F.lit("")), F.regexp_replace("name", r"\.[^.]*$", ""))
    return files.select(key.alias("document_id"), F.col("name").alias("title"), F.lit(0).cast("long").alias("num_chunks"), F.when(fault.isNull(), "uploaded").otherwise("failed").alias("status"), fault.alias("error_message"), "uploaded_at")


def documents(catalogue: DataFrame) -> DataFrame:
    return ca.listed(catalogue)


def store(library: Library, files: DataFrame) -> Library:
    """Files (name, content, uploaded_at) taken in: each is kept with its catalogue row, and waits to be indexed; a faulty
    one has its row alone."""
    rows = storage.written(upload(files).join(files.select(F.col("name").alias("title"), "content"), "title"))
    rows = rows.select("*", F.col("title").alias("filename")).dropDuplicates(["document_id"])
    kept = rows.filter("status = 'uploaded'").select("document_id", F.col("title").alias("name"), F.col("content").cast("binary").alias("content"))
    return library.put(rows.drop("content", "error_message"), library.table("chunks").limit(0), kept)


def index(library: Library, papers: DataFrame, chunks: DataFrame) -> Library:
    """Papers with their chunks, in the index and in the catalogue at once."""
    return library.put(papers, chunks)


def delete(library: Library, asked: DataFrame) -> tuple[Library, DataFrame]:
    """Documents gone from files, chunks, index and catalogue, and those that weren't there."""
    return library.delete(asked)


def evidence_for(ranked: DataFrame, chunks: DataFrame, catalogue: DataFrame, k: int = EVIDENCE) -> DataFrame:
    """Numbered evidence of ranked rows, written, as an answer reads it several times. chunks: (chunk_id, document_id,
    page_number, section, text)."""
    return storage.written(rt.numbered(chunks.join(rt.sent(ranked), "chunk_id"), catalogue, k))


Generator = Callable[[Column, Column], Column]


def query(questions: DataFrame, evidence: DataFrame, generate: Generator = aw.extractive, verify=aw.overlap_verifier) -> DataFrame:
    """questions (query_id, question, query_type) answered from their evidence: the prompt, the answer, the numbers of its
    claims and how they fare. generate: (question, evidence map) -> answer; a model that wants the prompt joins it."""
    texts = aw.evidence_text(evidence, "query_id")
    blocks = evidence.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("citation_id").cast("int").alias("k"), "text")))).alias("evidence"))
    rows = questions.join(texts, "query_id", "left").join(blocks, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.create_map().cast("map<int,string>")))
    rows = rows.withColumn("prompt", aw.prompt(F.col("query_type"), F.col("question"), F.coalesce("evidence_text", F.lit("")))).drop("evidence_text")
    rows = rows.withColumn("answer", aw.with_substance(generate(F.col("question"), F.col("evidence")))).withColumn("evidence_ids", F.map_keys("evidence"))
    claims = cl.claims(rows.select(F.col("query_id").alias("answer_id"), "answer", "evidence_ids")).withColumnRenamed("answer_id", "query_id")
    judged = aw.verified(claims, evidence.select("query_id", F.col("citation_id").cast("int").alias("citation_id"), "text"), verify, "query_id")
    return rows.join(ev.citation_metrics(judged, "query_id"), "query_id", "left")


def compare(questions: DataFrame, evidence: DataFrame, wanted: DataFrame, **plug) -> DataFrame:
    """Questions on some papers: only their evidence counts. wanted: (query_id, document_id)."""
    return query(questions, evidence.join(wanted, ["query_id", "document_id"], "left_semi"), **plug)


def literature_review(questions: DataFrame, ranked: DataFrame, most: int = MOST_PAPERS) -> DataFrame:
    """ranked rows (query_id, chunk_id, document_id, section, text, rank) of the first `most` papers, by cluster, with the
    prompt of each cluster's part."""
    clustered = rt.clustered(rt.capped(ranked, most))
    order = F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text")).alias("t"))
    parts = clustered.groupBy("query_id", "cluster").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "\n\n").alias("blocks"))
    topic = F.concat(F.col("question"), F.lit(" — "), F.col("cluster"))
    return parts.join(questions.select("query_id", "question"), "query_id").select("query_id", "cluster", "n", aw.prompt(F.lit("literature_review"), topic, F.col("blocks")).alias("prompt"))


def verify(claims: DataFrame, evidence: DataFrame, verifier=aw.overlap_verifier) -> DataFrame:
    """claims (request_id, claim_no, text, citation_ids) with their status."""
    return aw.verified(claims, evidence, verifier, "request_id")


def evaluation(spark: SparkSession, path: str, schema: str, first: list[str], last: list[str]) -> DataFrame:
    """One row of what the result files below a folder say, and whether there is anything."""
    got = so.read_results(spark, path, schema)
    known = got.agg((F.count("*") > 0).alias("evaluated"))
    return ca.first_known(got.withColumn("o", F.col("file")), "o", first, last).crossJoin(F.broadcast(known))


def health(built: ix.LexicalIndex | None, catalogue: DataFrame) -> DataFrame:
    docs = catalogue.agg(F.count("*").alias("num_indexed_documents"))
    if built is None:
        return docs.withColumn("num_indexed_chunks", F.lit(0).cast("long")).withColumn("status", F.lit("degraded"))
    return docs.crossJoin(F.broadcast(built.chunk_ids.agg(F.count("*").alias("num_indexed_chunks")))).withColumn("status", F.lit("ok"))


def conflicts(questions: DataFrame, evidence: DataFrame, **plug) -> DataFrame:
    """What the papers disagree on, with the prompt for it."""
    return query(questions.withColumn("query_type", F.lit("conflict_detection")), evidence, **plug)
