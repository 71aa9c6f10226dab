"""Runs of tokens that documents share with passages: of documents only those among the passages' become rows."""

import random
import re

import pytest

from docquarry.operators import bags


@pytest.mark.parametrize("most", [200_000, 3])
def test_runs_are_those_of_plain_sets(spark, monkeypatch, most):
    monkeypatch.setattr(bags, "RUNS", most)
    draw = random.Random(5)
    line = lambda n: " ".join(draw.choice(["A", "b", "C-1", "é", "dd"]) for _ in range(n))
    docs = {i: line(draw.randint(0, 40)) for i in range(40)} | {40: None, 41: "", 42: "...", 43: "a b a b a b a b"}
    passages = {1: "a b a b", 2: "A, b; A! b a B", 3: "dd dd", 4: "", 5: None, 6: line(9), 7: line(9), 8: "x y z w"}

    def runs(text):
        t = re.findall("[a-z0-9]+", (text or "").lower())
        return {tuple(t[i : i + 3]) for i in range(len(t) - 2)}

    want = sorted((q, d, len(runs(p) & runs(x)), len(runs(p))) for q, p in passages.items() for d, x in docs.items() if runs(p) & runs(x))
    table = lambda rows, key: spark.createDataFrame(list(rows.items()), f"{key} long, text string")
    got = bags.runs_shared(table(docs, "chunk_id"), table(passages, "query_id"), 3)
    assert sorted(tuple(r) for r in got.collect()) == want and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("MapInArrow" in plan) == (most > 3)
    none = table({1: "a"}, "query_id")
    assert bags.runs_shared(table(docs, "chunk_id"), none, 3).count() == 0
