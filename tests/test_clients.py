"""Answers of a client in tasks."""

from pyspark.sql import functions as F

from docquarry.operators import clients as cs


class Model:
    name = "m"

    def __init__(self, there=True):
        self.there, self.asked = there, {}

    def available(self):
        return self.there

    def generate(self, prompt):
        self.asked[prompt] = self.asked.get(prompt, 0) + 1
        if prompt == "bad":
            raise ValueError("bad")
        if prompt == "busy" or (prompt == "once" and self.asked[prompt] == 1):
            raise cs.Busy("429")
        return f" {prompt}! ", 3


def test_answers_and_what_they_took(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["good", "bad", "busy", "once", None, ""])], "id int, prompt string").withColumn("Error", F.lit("old")).coalesce(1)
    got = {r["id"]: r for r in cs.generated(rows, Model(), pause=0.0).collect()}
    assert [got[i]["answer"] for i in range(6)] == ["good!", None, None, "once!", None, "!"]
    assert [got[i]["attempts"] for i in range(6)] == [1, 1, 3, 2, 0, 1]
    assert got[0]["error"] is None and "bad" in got[1]["error"] and "429" in got[2]["error"] and got[4]["error"] == "no prompt"
    assert got[0]["eval_count"] == 3 and got[0]["latency_ms"] >= 0 and got[0]["tokens_per_second"] > 0 and got[1]["eval_count"] == 0
    kept = {r["id"]: (r["model"], r["answer"]) for r in cs.generated(rows, Model(there=False), fallback=F.lit("x"), pause=0.0).collect()}
    assert set(kept.values()) == {("fallback", "x")}
    sums = {r["model"]: (r["n"], r["failed"], r["eval_count"]) for r in cs.usage(cs.generated(rows, Model(), pause=0.0)).collect()}
    assert sums == {"m": (6, 3, 9)}
    assert cs.generated(rows.filter("false"), Model()).count() == 0
