"""Places, quotas and quantiles within large groups are those of a plain sort."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docquarry.operators import order as od
from docquarry.operators import sampling as sa


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    return spark.createDataFrame([(i, draw.choice(["a", "a", "a", "b", None, "c"]), draw.choice([1.5, -2.0, 0.0, None, float("nan"), draw.gauss(0, 1e3)])) for i in range(3000)], "id long, kind string, value double").repartition(5)


def by_kind(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["kind"], {})[r["place"]] = r["id"]
    return out


def test_places_within_groups(rows):
    number = sa.draw(F.lit(3), F.col("id"))
    want = by_kind(rows.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(number, "id"))))
    assert by_kind(od.placed_in(rows, "kind", number, "id")) == want
    for quota in (0, 1, 40, 5000):
        got = by_kind(od.first_of_each(rows, "kind", number, "id", F.lit(quota)))
        assert got == {k: {p: i for p, i in v.items() if p <= quota} for k, v in want.items() if quota}
    quotas = rows.sparkSession.createDataFrame([("a", 7), (None, 3), ("z", 9)], "kind string, q int")
    got = by_kind(od.first_of_each(rows, "kind", number, "id", F.col("q"), quotas))
    assert got == {k: {p: i for p, i in want[k].items() if p <= n} for k, n in (("a", 7), (None, 3))}


@pytest.mark.parametrize("gathered,ranges", [(10_000, 1024), (20, 4), (1, 2)])
def test_quantiles(rows, monkeypatch, gathered, ranges):
    monkeypatch.setattr(od, "GATHERED", gathered)
    monkeypatch.setattr(od, "RANGES", ranges)
    values = {}
    for r in rows.collect():
        if r["value"] is not None and r["value"] == r["value"]:
            values.setdefault(r["kind"], []).append(r["value"])
    for share in (0.5, 0.95) if gathered > 1 else (0.5,):
        got = {r["kind"]: (r["n"], r["quantile"]) for r in od.quantiles(rows, "kind", "value", share).collect()}
        assert set(got) == set(values)
        for k, v in values.items():
            assert got[k][0] == len(v) and abs(got[k][1] - np.quantile(v, share)) < 1e-9
    assert od.quantiles(rows.filter("false"), "kind", "value", 0.5).count() == 0


def test_a_quota_is_filled_and_then_nothing_is_asked(rows):
    looked = []

    def accept(some):
        looked.append({r["id"] for r in some.collect()})
        return some.filter("id % 3 = 0")

    quotas = {"a": 20, "b": 2000, "c": 0, "z": 4}
    order = by_kind(od.placed_in(rows, "kind", sa.draw(F.lit(7), F.col("id")), "id"))
    want = {k: dict([(p, i) for p, i in sorted(order[k].items()) if i % 3 == 0][:n]) for k, n in (("a", 20), ("b", 2000))}
    for ahead in (1.0, 4.0):
        looked.clear()
        assert by_kind(sa.filled(rows, "kind", "id", quotas, accept, ahead=ahead)) == want
        asked = set().union(*looked)
        assert sum(map(len, looked)) == len(asked)  # no candidate twice
        assert len(asked & set(order["a"].values())) < 200 and set(order["b"].values()) <= asked and not asked & set(order["c"].values())
    assert sa.filled(rows, "kind", "id", {"z": 3}, accept).count() == 0
