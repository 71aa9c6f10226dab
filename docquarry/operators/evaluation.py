"""Metrics of retrieval and answers, intervals, comparisons and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.operators import order as od


def draw(*key: Column) -> Column:
    """A reproducible number below 2^32 for a key: the first eight hex digits of its md5. It stands for random choice."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("long")


def judged_hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """ranked with hit and num_relevant, for queries that have judgments; relevant: (query_id, chunk_id)."""
    counts = relevant.groupBy("query_id").agg(F.count("*").alias("num_relevant"))
    marked = relevant.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return ranked.join(counts, "query_id").join(marked, ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def per_query(hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """recall@k (share of the relevant), hit@k (any), reciprocal rank, nDCG@10 with the ideal over retrieved hits."""
    within = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    gain = F.when((F.col("hit") == 1) & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = hits.groupBy("query_id").agg(
        *(F.round(within(k) / F.first("num_relevant"), 6).alias(f"recall_at_{k}") for k in ks),
        *(F.least(within(k), F.lit(1)).cast("double").alias(f"hit_at_{k}") for k in ks),
        F.round(F.coalesce(1 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.sum(gain).alias("dcg"),
        F.sum("hit").alias("found"),
    )
    ideal = F.aggregate(F.when(F.col("found") > 0, F.sequence(F.lit(1), F.least("found", F.lit(10)))).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return got.withColumn("ndcg_at_10", F.round(F.coalesce(F.try_divide("dcg", ideal), F.lit(0.0)), 6)).drop("dcg", "found")


def summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Means over the judged queries and their number."""
    return metrics.agg(F.count("*").alias("num_queries"), *(F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names))


#: Units up to which their values go to all tasks that draw.
UNITS_SENT = 500_000


def bootstrap(values: DataFrame, value: str, resamples: int, low: int, high: int) -> DataFrame:
    """n, mean and the order statistics `low` and `high` (from 0) of the means of resamples with replacement; no row if
    there are no units.

    values: one row for each unit, with `unit` as a key. Draw j of a resample is the unit at place draw(resample, j) mod
    n; so each resample joins positions, not rows of other resamples. There are resamples times as many draws as units, so
    units go to the draws: to all tasks if they are few enough, else both are dealt out by place. Draws are a range of
    numbers, so tasks have equally many; the join's side is named, as Spark takes draws for few and would broadcast them."""
    placed = od.placed(values.select("unit", F.col(value).alias("v")), "unit")  # written there: values are computed once
    units = placed.count()
    n = placed.agg(F.count("*").alias("n"), F.avg("v").alias("mean")).filter("n > 0")
    each = F.lit(max(units, 1)).cast("long")
    drawn = values.sparkSession.range(resamples * units).select(F.call_function("div", F.col("id"), each).alias("resample"), F.pmod("id", each).alias("j"))
    drawn = drawn.select("resample", F.pmod(draw(F.col("resample"), F.col("j")), each).alias("place"))
    places = placed.select("place", "v")
    means = drawn.join(F.broadcast(places) if units <= UNITS_SENT else places.hint("shuffle_hash"), "place").groupBy("resample").agg(F.round(F.avg("v"), 9).alias("m"))
    ordered = F.array_sort(F.collect_list("m"))
    bounds = means.agg(F.try_element_at(ordered, F.lit(low + 1)).alias("ci_low"), F.try_element_at(ordered, F.lit(high + 1)).alias("ci_high"))
    return n.crossJoin(bounds).select("n", F.round("mean", 6).alias("mean"), F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


def citation_metrics(claims: DataFrame, *by: str) -> DataFrame:
    """Coverage, precision, faithfulness and unsupported rate of claims (status, citation_ids) by group.

    Coverage is over all claims. The others are over verified claims: null if there are claims but none verified;
    precision 0 if none verified is cited."""
    verified = F.col("status") != "NOT_VERIFIED"
    cited = F.size("citation_ids") > 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = claims.groupBy(*by).agg(
        F.count("*").alias("total_claims"),
        count(cited).alias("cited"),
        count(verified).alias("verified_claims"),
        count(verified & cited).alias("verified_cited"),
        count(verified & cited & F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED")).alias("good"),
        count(verified & (F.col("status") == "SUPPORTED")).alias("supported"),
        count(verified & F.col("status").isin("UNSUPPORTED", "CONTRADICTED")).alias("flagged_claims"),
        F.sum(F.size("citation_ids")).alias("total_citations"),
    )
    none = F.col("verified_claims") == 0
    rate = lambda a, b: F.round(F.when(F.col("total_claims") == 0, 0.0).when(none, None).otherwise(F.coalesce(F.try_divide(a, b), F.lit(0.0))), 6)
    return got.select(
        *by,
        "total_claims",
        "verified_claims",
        "flagged_claims",
        "total_citations",
        F.round(F.coalesce(F.try_divide("cited", "total_claims"), F.lit(0.0)), 6).alias("coverage"),
        rate("good", "verified_cited").alias("precision"),
        rate("supported", "verified_claims").alias("faithfulness"),
        rate("flagged_claims", "verified_claims").alias("unsupported_rate"),
    )


def confusion(rows: DataFrame, predicted: Column, truth: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn and the rates made of them, with denominators of at least one."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = rows.groupBy(*by).agg(count(predicted & truth).alias("tp"), count(predicted & ~truth).alias("fp"), count(~predicted & truth).alias("fn"), count(~predicted & ~truth).alias("tn"))
    over = lambda a, *b: F.col(a) / F.greatest(sum((F.col(x) for x in b), F.lit(0)), F.lit(1))
    return got.select(
        *by, "tp", "fp", "fn", "tn",
        F.round((F.col("tp") + F.col("tn")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.lit(1)), 6).alias("accuracy"),
        F.round((over("tp", "tp", "fn") + over("tn", "tn", "fp")) / 2, 6).alias("balanced_accuracy"),
        F.round(over("tp", "tp", "fp"), 6).alias("precision"),
        F.round(over("tp", "tp", "fn"), 6).alias("recall"),
    )
