"""Splits, quotas, pools and allocations. Random order is that of a keyed md5: the same rows give the same choice."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.evaluation import draw
from docquarry.operators.order import first_by, first_of_each, placed, placed_in
from docquarry.sources import storage
from docquarry.sources.versions import Conflict, Versions


def stratified(rows: DataFrame, stratum: str, key: str, shares: dict[str, float], n: int, seed: int = 7) -> DataFrame:
    """For each stratum max(1, round(n * share)) rows in random order (rounding half to even)."""
    quotas = rows.sparkSession.createDataFrame([(k, max(1, round(n * v))) for k, v in shares.items()], "stratum string, quota int")
    quotas = quotas.select(F.col("stratum").cast(dict(rows.dtypes)[stratum]).alias(stratum), "quota")
    return first_of_each(rows, stratum, draw(F.lit(seed), F.col(key)), key, F.col("quota"), quotas)


def filled(candidates: DataFrame, kind: str, key: str, quotas: dict[str, int], accept: Callable[[DataFrame], DataFrame], seed: int = 7, ahead: float = 2.0) -> DataFrame:
    """Of each kind the first accepted candidates in random order, up to its quota, with `place` (from 1, among all).

    accept takes candidates and gives back those that are good (asking a model, say), which costs. So candidates are
    looked at in rounds, of each kind `ahead` times as many as it still lacks, and a kind that is full or has no candidate
    left is looked at no more. The result doesn't depend on `ahead`: what is accepted beyond a quota comes after it."""
    order = storage.written(placed_in(candidates.filter(F.col(kind).isin(*quotas)), kind, draw(F.lit(seed), F.col(key)), key))
    there = {r[kind]: r["n"] for r in order.groupBy(kind).agg(F.count("*").alias("n")).collect()}  # a row for each quota
    seen, have, good = dict.fromkeys(there, 0), dict.fromkeys(there, 0), None
    while True:
        upto = {k: min(there[k], seen[k] + max(1, math.ceil(ahead * (quotas[k] - have[k])))) for k in there if have[k] < quotas[k] and seen[k] < there[k]}
        if not upto:
            break
        due = F.lit(False)
        for k, last in upto.items():
            due = due | ((F.col(kind) == k) & (F.col("place") > seen[k]) & (F.col("place") <= last))
        found = storage.written(accept(order.filter(due)).select(*order.columns))
        for r in found.groupBy(kind).agg(F.count("*").alias("n")).collect():
            have[r[kind]] += r["n"]
        seen.update(upto)
        good = found if good is None else good.unionByName(found)
    if good is None:
        return order.limit(0)
    quota = F.create_map(*(x for k, n in quotas.items() for x in (F.lit(k), F.lit(n))))
    nth = F.row_number().over(Window.partitionBy(kind).orderBy("place"))  # a few times the quota
    return good.withColumn("__nth", nth).filter(F.col("__nth") <= F.try_element_at(quota, F.col(kind))).drop("__nth")


def round_robin(rows: DataFrame, group: str, key: str) -> DataFrame:
    """turn, and place (from 0) in a reading that takes one row of each group at a time, groups in order."""
    turned = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    return placed(turned, "turn", group)


def split_papers(ids: DataFrame, key: str, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, split): distinct ids in random order; the first round(n * val) are val, then test, the rest train."""
    rows = first_by(ids.select(key).distinct(), draw(F.lit(seed), F.col(key)), key)
    n = rows.agg(F.count("*").alias("n"))
    nv = F.least(F.bround(F.col("n") * val), F.col("n"))
    nt = F.least(F.bround(F.col("n") * test), F.col("n") - nv)
    return rows.crossJoin(F.broadcast(n)).select(key, F.when(F.col("place") <= nv, "val").when(F.col("place") <= nv + nt, "test").otherwise("train").alias("split"))


def groups_of(rows: DataFrame, pool: str, key: str, size: int, least: int, most: int, seed: int = 42) -> DataFrame:
    """Fixed-size groups of a pool's rows in random order; a remainder below `least` and groups beyond `most` go."""
    nth = first_of_each(rows, pool, draw(F.lit(seed), F.col(key)), key, F.lit(size * most))
    placed = nth.withColumn("group_no", F.floor((F.col("place") - 1) / size)).drop("place")
    sized = placed.withColumn("group_size", F.count("*").over(Window.partitionBy(pool, "group_no")))
    return sized.filter((F.col("group_size") >= least) & (F.col("group_no") < most))


def pairs_of(rows: DataFrame, pool: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` random pairs (first < second) of each pool, in their own order. Each row meets the next rows of
    a random circle, so no more pairs are made than a few times those kept."""
    sizes = rows.groupBy(F.col(pool).alias("__pool")).agg(F.count("*").alias("n"))
    circle = placed_in(rows.select(pool, key), pool, draw(F.lit(seed), F.col(key)), key).withColumn("p", F.col("place") - 1).drop("place")
    placed = circle.join(sizes, F.col(pool).eqNullSafe(F.col("__pool"))).drop("__pool")
    steps = F.least(F.ceil(F.lit(most) / F.col("n")) + 1, F.floor(F.col("n") / 2))
    asked = placed.filter("n > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(steps, F.lit(1)).cast("int")))).withColumn("q", F.pmod(F.col("p") + F.col("step"), F.col("n")))
    other = placed.select(pool, F.col("p").alias("q"), F.col(key).alias("other"))
    pairs = asked.join(other, [pool, "q"]).select(pool, F.least(key, "other").alias("first"), F.greatest(key, "other").alias("second")).distinct()
    drawn = pairs.withColumn("__pair", F.struct("first", "second"))
    return first_of_each(drawn, pool, draw(F.lit(seed), F.col("first"), F.col("second")), "__pair", F.lit(most)).drop("place", "__pair")


def allocated(pools: DataFrame) -> DataFrame:
    """pools (task, pool, ratio) with count: what each task gives so that ratios hold and no pool is exceeded."""
    fits = (F.col("pool") > 0) & (F.col("ratio") > 0)
    total = F.min(F.when(fits, F.col("pool") / F.col("ratio"))).over(Window.partitionBy(F.lit(1)))
    return pools.withColumn("count", F.when(fits, F.least(F.col("pool"), F.bround(total * F.col("ratio")))).otherwise(0).cast("long"))


def proportional(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 33) -> DataFrame:
    """Of each stratum max(1, round(n * its share of the rows)) rows (rounding half to even) in random order."""
    total = rows.agg(F.count("*").alias("__all"))
    quota = rows.groupBy(stratum).agg(F.count("*").alias("__own")).crossJoin(F.broadcast(total))  # one row
    quota = quota.select(stratum, F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("__own") / F.col("__all"))).alias("__quota"))
    return first_of_each(rows, stratum, draw(F.lit(seed), F.col(key)), key, F.col("__quota"), quota).drop("place")


def frozen(sample: DataFrame, path: str) -> DataFrame:
    """The sample that a folder keeps: written when it is first asked for, and read ever after, in this session and in
    others, whatever `sample` would draw then. Of two that ask first, one's is kept and both read that."""
    spark = sample.sparkSession
    store = Versions(spark, path)
    if not store.latest()[0]:
        part = store.new_part("sample")
        sample.write.parquet(part)
        try:
            store.commit(0, {"sample": part})
        except Conflict:
            pass  # another was first
    return spark.read.schema(sample.schema).parquet(store.latest()[1]["sample"])


def candidates(chunks: DataFrame, seed, papers: tuple[str, ...], questions: int) -> DataFrame:
    """(document_id, kind, index): each paper for each kind in `papers`, and each chunk that `seed` takes for each
    question index as `qa`."""
    whole = chunks.select("document_id").distinct().select("document_id", F.explode(F.array(*map(F.lit, papers))).alias("kind"), F.lit(0).alias("index"))
    asked = chunks.filter(seed).select("document_id", F.lit("qa").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(questions - 1))).alias("index"))
    return whole.unionByName(asked)


def pools(chunks: DataFrame, tasks: dict[str, tuple[str, list[str]]], group: int, least: int) -> DataFrame:
    """(task, pool): how many examples each task can have, of the papers with a chunk in one of its sections: papers one
    by one, pairs, or groups of so many with a last one of `least` at the least."""
    rows = None
    for task, (kind, sections) in tasks.items():
        n = F.countDistinct("document_id")
        pool = {"one": n, "pair": F.floor(n * (n - 1) / 2), "group": F.floor(n / group) + F.when(n % group >= least, 1).otherwise(0)}[kind]
        part = chunks.filter(F.col("section").isin(sections)).agg(F.lit(task).alias("task"), pool.cast("long").alias("pool"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
