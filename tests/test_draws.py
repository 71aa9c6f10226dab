"""Resampling draws as many units as there are, time and again: units go to the draws, and draws to no broadcast."""

import hashlib

import pytest

from docquarry.operators import evaluation as ev


def broadcast_rows(plan):
    """Rows of each broadcast in a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcast_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcast_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchangeExec" else []
    return own + [n for i in range(plan.children().length()) for n in broadcast_rows(plan.children().apply(i))]


def plain(units, resamples, low, high):
    """The same by loops."""
    vs = [x for _, x in sorted(units.items())]
    place = lambda r, j: int(hashlib.md5(f"{r}|{j}".encode()).hexdigest()[:8], 16) % len(vs)
    means = sorted(sum(vs[place(r, j)] for j in range(len(vs))) / len(vs) for r in range(resamples))
    return len(vs), sum(vs) / len(vs), means[low], means[high]


@pytest.mark.parametrize("sent", [500_000, 0])
def test_draws_are_never_broadcast(spark, monkeypatch, sent):
    monkeypatch.setattr(ev, "UNITS_SENT", sent, raising=False)
    units = {7 * i % 1009 - 300: i * i % 97 / 8 for i in range(300)}
    values = spark.createDataFrame(list(units.items()), "unit long, d double").repartition(5)
    got = ev.bootstrap(values, "d", 2000, 50, 1949)
    rows = got.collect()
    assert [tuple(r) for r in rows] == [tuple(pytest.approx(x, abs=1e-6) for x in plain(units, 2000, 50, 1949))]
    assert max(broadcast_rows(got._jdf.queryExecution().executedPlan())) <= len(units)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_a_unit_alone_and_none(spark, monkeypatch, sent):
    monkeypatch.setattr(ev, "UNITS_SENT", sent, raising=False)
    values = spark.createDataFrame([(4, 0.25)], "unit long, d double")
    assert [tuple(r) for r in ev.bootstrap(values, "d", 20, 0, 19).collect()] == [(1, 0.25, 0.25, 0.25)]
    assert ev.bootstrap(values.limit(0), "d", 20, 0, 19).collect() == []
