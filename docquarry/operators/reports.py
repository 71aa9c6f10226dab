"""Summaries of scores, comparisons of answer sets, and counts of corpora, splits and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_of(value: Column, digits: int = 3) -> Column:
    """The mean of what isn't null; null without any."""
    return F.round(F.avg(value), digits)


def share(test: Column) -> Column:
    return F.avg(F.when(test, 1.0).otherwise(0.0))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean: null if either is, 0 if both are 0."""
    return F.when(precision.isNotNull() & recall.isNotNull(), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))


def scored(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """A row for each metric (and group): its mean, how many were scored and how many failed (null)."""
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("x")).select(*by, "x.*")
    return long.groupBy(*by, "metric").agg(mean_of(F.col("v")).alias("mean"), F.count("v").alias("n_scored"), (F.count("*") - F.count("v")).alias("n_failed"))


def slices(rows: DataFrame, metrics: list[str], groups: list[str]) -> DataFrame:
    """Means of the metrics and n by each group by itself: (slice, value, n, metrics). A row is in one slice of each."""
    cells = F.explode(F.array(*(F.struct(F.lit(g).alias("slice"), F.col(g).cast("string").alias("value")) for g in groups)))
    return rows.select(cells.alias("c"), *metrics).select("c.*", *metrics).groupBy("slice", "value").agg(F.count("*").alias("n"), *(mean_of(F.col(m)).alias(m) for m in metrics))


def compared(old: DataFrame, new: DataFrame, key: str, test: str) -> DataFrame:
    """One row: of two answer sets' tests by key, rows in both and on either side only, passes, gained and lost. What
    only the old set has counts as not passed in the new one."""
    both = old.select(key, F.col(test).alias("a")).join(new.select(key, F.col(test).alias("b")), key, "full")
    known, passes = F.col("a").isNotNull(), F.coalesce("b", F.lit(False))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.agg(
        count(known & F.col("b").isNotNull()).alias("in_both"),
        count(F.col("b").isNull()).alias("only_old"),
        count(~known).alias("only_new"),
        count(F.col("a")).alias("passed_before"),
        count(known & passes).alias("passed_after"),
        count(known & passes & ~F.col("a")).alias("gained"),
        count(F.col("a") & ~passes).alias("lost"),
    )


def zipped(arms: dict[str, DataFrame], key: str) -> DataFrame:
    """Columns of several score tables by key, for the keys that all of them have."""
    out = None
    for table in arms.values():
        out = table if out is None else out.join(table, key)
    return out


def histogram(rows: DataFrame, cause: str) -> DataFrame:
    """How often each cause is named, with its place: most often first, ties by name."""
    counts = rows.groupBy(cause).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), cause)))  # a row for each cause


def configurations(rows: DataFrame) -> DataFrame:
    """rows (config, split, answer_words, sentence_coverage, cites_any, valid_ids, passes_checker, num_citations): a row
    for each configuration, with the validation and test halves apart."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    half = lambda s: F.col("split") == s
    return rows.groupBy("config").agg(
        F.count("*").alias("n"),
        *(count(F.col(c)).alias(c) for c in ("cites_any", "valid_ids", "passes_checker")),
        *(e for s in ("val", "test") for e in (count(half(s) & F.col("passes_checker")).alias(f"{s}_passes"), count(half(s)).alias(f"{s}_n"))),
        F.round(F.avg("sentence_coverage"), 4).alias("avg_sentence_coverage"),
        F.round(F.avg("answer_words"), 1).alias("avg_answer_words"),
        F.round(F.avg("num_citations"), 2).alias("avg_citations"),
    )


def ingested(papers: DataFrame) -> DataFrame:
    """One row on papers (status, n_pages, n_text, n_table, n_figure): files, pages, chunks by kind, scanned and failed."""
    count = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    sums = [F.sum(c).alias(c) for c in ("n_pages", "n_text", "n_table", "n_figure")]
    return papers.agg(F.count("*").alias("files"), *sums, F.sum(F.col("n_text") + F.col("n_table") + F.col("n_figure")).alias("n_chunks"), *(count(s) for s in ("indexed", "scanned_needs_ocr", "failed")))


def split_matrix(rows: DataFrame, task: str, split: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Counts of each task in each split, with totals of both: the row `TOTAL` is over all tasks."""
    count = lambda s: F.sum(F.when(F.col(split) == s, 1).otherwise(0)).alias(s)
    return rows.rollup(task).agg(*(count(s) for s in splits), F.count("*").alias("total")).withColumn(task, F.coalesce(task, F.lit("TOTAL")))


def paper_hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked chunks (query_id, document_id, rank) as papers: each once, at its best rank, ranked anew, with whether it
    is the query's (relevant: query_id, document_id)."""
    best = ranked.groupBy("query_id", "document_id").agg(F.min("rank").alias("best"))
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best")))
    right = relevant.select("query_id", "document_id", F.lit(1).alias("hit"))
    return placed.join(right, ["query_id", "document_id"], "left").select("query_id", "document_id", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))


def relevant_hits(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked rows (query_id, chunk_id, document_id, page_number, rank) with hit. labels (query_id, chunk_id,
    document_id, page_number): a query with any chunk ids is judged by those, another by (document, page)."""
    by_chunk = labels.filter("chunk_id is not null").select("query_id", "chunk_id", F.lit(1).alias("c")).distinct()
    by_page = labels.filter("chunk_id is null").select("query_id", "document_id", "page_number", F.lit(1).alias("p")).distinct()
    kinds = labels.groupBy("query_id").agg(F.max(F.col("chunk_id").isNotNull()).alias("chunks"))
    got = ranked.join(kinds, "query_id").join(by_chunk, ["query_id", "chunk_id"], "left").join(by_page, ["query_id", "document_id", "page_number"], "left")
    return got.withColumn("hit", F.coalesce(F.when(F.col("chunks"), F.col("c")).otherwise(F.col("p")), F.lit(0))).drop("chunks", "c", "p")


def first_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key in an explicit order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def distinct_questions(rows: DataFrame, question: str, *order: str) -> DataFrame:
    """The first of the questions that are the same but for case and white space at the ends."""
    marked = rows.withColumn("__q", F.lower(F.trim(question)))
    return first_of(marked, ["__q"], *order).drop("__q")


def overlaps(splits: DataFrame, key: str, split: str) -> DataFrame:
    """(a, b, shared): how many keys two splits have in common; leak-free splits have none."""
    pairs = splits.select(key, F.col(split).alias("a")).distinct()
    names = pairs.select("a").distinct()
    both = pairs.join(pairs.withColumnRenamed("a", "b"), key).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    every = names.join(names.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return every.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0).cast("long")).alias("shared"))


def worst(rows: DataFrame, badness: str, key: str, n: int) -> DataFrame:
    """The n rows of largest badness that aren't ok, with their place; ties by key."""
    kept = rows.filter("verdict <> 'ok'").orderBy(F.desc(badness), key).limit(n)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc(badness), key)))  # n rows


def percent(value: Column, digits: int = 0) -> Column:
    """A share as text, a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%.{digits}f%%", F.round(value * 100, digits)))


def perplexity(loss: Column) -> Column:
    """exp of the mean loss."""
    return F.exp(F.avg(loss))
