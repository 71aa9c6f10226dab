"""A stream of changes of state, over several runs, with documents that hang."""

import datetime as dt

from docquarry import streaming as st
from docquarry.streaming import lifecycle as lc

SCHEMA = "document_id string, status string, at timestamp"
T0 = dt.datetime(2024, 1, 1)


def put(spark, path, *rows):
    spark.createDataFrame([(d, s, T0 + dt.timedelta(minutes=m)) for d, s, m in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_states_over_runs(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    changes = [
        [("a", "uploaded", 0), ("a", "parsing", 5), ("b", "indexed", 3), ("b", "parsing", 3), ("c", "uploaded", 1), ("a", "odd", 9)],
        [("a", "indexed", 20), ("c", "parsing", 15), ("d", "uploaded", 10), ("c", "uploaded", 12)],
    ]
    run = lambda: lc.follow(spark, src, SCHEMA, out, mark, late="2 hours", stuck=10**12)
    states = lambda: {r["document_id"]: r["status"] for r in lc.current(spark, out).collect()}
    put(spark, src, *changes[0])
    run()
    assert states() == {"a": "parsing", "b": "indexed", "c": "uploaded"}
    run()  # nothing has come
    put(spark, src, *changes[1])
    run()
    both = spark.createDataFrame([(d, s, T0 + dt.timedelta(minutes=m)) for d, s, m in changes[0] + changes[1] if s != "odd"], SCHEMA)
    assert states() == {r["document_id"]: r["status"] for r in st.latest_states(both).collect()} == {"a": "indexed", "b": "indexed", "c": "parsing", "d": "uploaded"}


def test_what_hangs_fails_and_what_is_done_is_forgotten(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    run = lambda: lc.follow(spark, src, SCHEMA, out, mark, late="1 minute", stuck=30 * 60_000, keep=60 * 60_000)
    states = lambda: {r["document_id"]: (r["status"], r["error"]) for r in lc.current(spark, out).collect()}
    put(spark, src, ("slow", "parsing", 0), ("done", "indexed", 0))
    run()
    put(spark, src, ("other", "uploaded", 50))
    run()
    put(spark, src, ("other", "parsing", 60))
    run()
    assert states()["slow"] == ("failed", "stuck in parsing") and states()["done"] == ("indexed", None) and states()["other"] == ("parsing", None)
    put(spark, src, ("slow", "indexed", 70))
    run()
    assert states()["slow"] == ("indexed", None)


def test_a_change_asks_the_store_no_more_than_it_must():
    """Each call goes to the store and back: one to read, one to write, and timers only where one is due at another time."""
    from pyspark.sql import Row

    calls, held = [], {}

    class Handle:
        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            def call(*x):
                calls.append(name)
                if name == "update":
                    held["v"] = x[0]
                return held.get("v")

            return call

    row = lambda us, status: Row(us=us, rank=st.STATES.index(status) if status in st.STATES else None, status=status)
    doing = lc.Lifecycle(1000, 1000)
    doing.init(Handle())
    run = lambda *rows: [tuple(r) for r in doing.handleInputRows(("a",), iter(rows), None)]
    assert run(row(5, "parsing"), row(7, "odd"), row(None, "indexed"), row(5, "uploaded")) == [("a", "parsing", 5, None)]
    assert calls == ["get", "registerTimer", "update"]
    calls.clear()
    assert run(row(6, "indexing"), row(6, "parsing")) == [("a", "indexing", 6, None)] and calls == ["get", "update"]
    calls.clear()
    assert run(row(6, "parsing")) == [] == run(row(9, "odd")) and calls == ["get"]
    assert run(row(9000, "failed")) == [("a", "failed", 9000, None)] and "deleteTimer" in calls
