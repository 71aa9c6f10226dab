"""Places of rows in a global order, without a sort in one task."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.sources import storage


def placed(rows: DataFrame, *by: str) -> DataFrame:
    """rows with `place`, from 0, in ascending order of the columns `by`, which should tell rows apart.

    Rows are dealt into ranges, numbered within each and written; a range's rows before it are counted from one number
    for each range."""
    each = rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id())
    own = Window.partitionBy("__range").orderBy(*by)
    each = storage.written(each.withColumn("__nth", F.row_number().over(own) - 1))
    sizes = each.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("__before", F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    out = each.join(F.broadcast(before.select("__range", F.coalesce("__before", F.lit(0)).alias("__before"))), "__range")
    return out.withColumn("place", (F.col("__before") + F.col("__nth")).cast("long")).select(*rows.columns, "place")


def first_by(rows: DataFrame, number: Column, key: str) -> DataFrame:
    """rows with `place`, from 1, in order of a number spread over 0 .. 2^32 - 1 and then key. Rows are counted by the
    number's upper half, at most 65,536 counts, and ranked within each."""
    cell = F.shiftright(number, 16)
    dealt = rows.withColumn("__number", number).withColumn("__cell", cell)
    sizes = dealt.groupBy("__cell").agg(F.count("*").alias("n"))
    before = sizes.select("__cell", F.coalesce(F.sum("n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__cell").orderBy("__number", key))
    out = dealt.withColumn("__nth", nth).join(before, "__cell")
    return out.withColumn("place", F.col("__before") + F.col("__nth")).select(*rows.columns, "place")


def _cells(rows: DataFrame, group: str, number: Column) -> tuple[DataFrame, DataFrame]:
    """rows with __group, __number and __cell, and the cells (__group, __cell, n, __before) of the number's upper half."""
    dealt = rows.withColumn("__group", F.to_json(F.struct(group))).withColumn("__number", number).withColumn("__cell", F.shiftright("__number", 16))
    earlier = Window.partitionBy("__group").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 cells at most
    cells = dealt.groupBy("__group", "__cell").agg(F.count("*").alias("n"))
    return dealt, cells.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def placed_in(rows: DataFrame, group: str, number: Column, key: str) -> DataFrame:
    """rows with `place`, from 1, within their group (null is one), in order of a number spread over 0 .. 2^32 - 1 and then
    key. A group's rows are ranked by cell of the number, so no task has a whole group."""
    dealt, cells = _cells(rows, group, number)
    nth = F.row_number().over(Window.partitionBy("__group", "__cell").orderBy("__number", key))
    out = dealt.withColumn("__nth", nth).join(cells.drop("n"), ["__group", "__cell"])
    return out.withColumn("place", F.col("__before") + F.col("__nth")).select(*rows.columns, "place")


def first_of_each(rows: DataFrame, group: str, number: Column, key: str, quota: Column, quotas: DataFrame | None = None) -> DataFrame:
    """The rows of placed_in() whose place is within their group's quota: one number for all, or a Column of what quotas
    (group, ...) has, a table of one row for each group; none for groups without one.

    Cells are counted first. Rows beyond the cell in which the quota is met are left before anything is ranked, so a large
    group costs a count, and a rank for about as many rows as are taken."""
    dealt, cells = _cells(rows, group, number)
    if quotas is not None:
        cells = cells.join(quotas.withColumn("__group", F.to_json(F.struct(group))).drop(group), "__group")
    taken = storage.written(cells.withColumn("__quota", quota).filter(F.col("__before") < F.col("__quota")).select("__group", "__cell", "__before", "__quota"))
    last = taken.groupBy("__group").agg(F.max("__cell").alias("__last"))
    few = dealt.join(last, "__group").filter(F.col("__cell") <= F.col("__last"))
    nth = F.row_number().over(Window.partitionBy("__group", "__cell").orderBy("__number", key))
    out = few.withColumn("__nth", nth).join(taken, ["__group", "__cell"]).withColumn("place", F.col("__before") + F.col("__nth"))
    return out.filter(F.col("place") <= F.col("__quota")).select(*rows.columns, "place")


#: Values of a group that are gathered and sorted at the end; cells into which a range is cut.
GATHERED, RANGES = 10_000, 1024


def quantiles(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """(group, n, quantile): the exact quantile of each group's values, between neighbours in proportion, and how many
    values there are. Nulls and NaN don't count; null is a group; a group without values has none.

    No group's values are gathered: the range that holds the wanted place is cut into RANGES, their values are counted,
    and the one that holds it is cut in turn, until it has GATHERED values or one value only."""
    base = rows.select(F.to_json(F.struct(group)).alias("__group"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    state = base.groupBy("__group").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = (F.col("n") - 1) * F.lit(share)
    state = state.withColumn("part", at - F.floor(at)).withColumn("k", F.explode(F.array_distinct(F.array(F.floor(at), F.least(F.floor(at) + 1, F.col("n") - 1)))))
    state = storage.written(state.withColumn("before", F.lit(0).cast("long")).withColumn("m", F.col("n")))
    unsettled = (F.col("m") > GATHERED) & (F.col("low") < F.col("high"))
    while state.filter(unsettled).head(1):
        asked = state.filter(unsettled)
        inner = F.coalesce(F.floor((F.col("v") - F.col("low")) / ((F.col("high") - F.col("low")) / RANGES)), F.lit(1))
        cell = F.when(F.col("v") <= F.col("low"), 0).when(F.col("v") >= F.col("high"), RANGES - 1).otherwise(F.least(F.greatest(inner, F.lit(0)), F.lit(RANGES - 1)))
        within = base.join(asked, "__group").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        keep = ["__group", "n", "part", "k", "before"]
        cells = within.withColumn("cell", cell).groupBy(*keep, "cell").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        earlier = Window.partitionBy("__group", "k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # RANGES cells
        cells = cells.withColumn("b", F.col("before") + F.coalesce(F.sum("m").over(earlier), F.lit(0)))
        found = cells.filter((F.col("b") <= F.col("k")) & (F.col("k") < F.col("b") + F.col("m"))).withColumn("before", F.col("b"))
        state = storage.written(state.filter(~unsettled).unionByName(found.select(*state.columns)))
    one = state.filter("low = high").select("__group", "n", "part", "k", F.col("low").alias("v"))
    several = base.join(state.filter("low < high").withColumnRenamed("n", "n_all"), "__group").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    several = several.groupBy("__group", F.col("n_all").alias("n"), "part", "k", "before").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    several = several.select("__group", "n", "part", "k", F.get("vs", (F.col("k") - F.col("before")).cast("int")).alias("v"))
    both = one.unionByName(several).groupBy("__group", "n", "part").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    kind = rows.select(group).schema.json()
    out = both.select(F.from_json("__group", T.StructType.fromJson(json.loads(kind))).alias("g"), "n", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
    return out.select(F.col("g")[group].alias(group), "n", "quantile")
