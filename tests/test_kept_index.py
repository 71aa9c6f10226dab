"""Segments, versions and pruned search of the kept index: always what a search without an index finds."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import index as ix
from docquarry.operators import retrieval as rt
from docquarry.sources import versions as vs

WORDS = ["fish", "ham", "egg", "red", "blue", "shoe", "hat", "old", "new", "green"]


def texts(ids, seed, most=12):
    draw = random.Random(seed)
    return {i: " ".join(draw.choice(WORDS[: draw.randint(2, 10)]) for _ in range(draw.randint(0, most))) for i in ids}


def table(spark, found):
    return spark.createDataFrame(list(found.items()), "chunk_id int, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "fish and ham"), (2, "old old hat"), (3, "unknown"), (4, ""), (5, None), (6, "red blue green shoe egg")], "query_id int, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def same(index, spark, have, asked, k=4):
    for pad in (False, True):
        assert rows(index.search(asked, k, pad=pad)) == rows(rt.bm25(table(spark, have), asked, k, pad=pad))


def test_appends_replacements_and_removals(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 8)
    have = texts(range(30), 1)
    index = ix.LexicalIndex.build(table(spark, have), f"file://{tmp_path}/i")
    same(index, spark, have, asked)
    more = texts([*range(25, 40), 3], 2)
    index = index.append(table(spark, more))
    have |= more
    same(index, spark, have, asked)
    assert index.size == len(have) == index.chunk_ids.count() == index.chunk_ids.distinct().count()
    gone = [0, 3, 26, 39, 77]
    index = index.removed(table(spark, dict.fromkeys(gone, "")))
    have = {i: t for i, t in have.items() if i not in gone}
    same(index, spark, have, asked)
    again = texts([3, 39], 3)  # taken out, and back with another text
    index = index.append(table(spark, again))
    have |= again
    same(index, spark, have, asked)
    want = {(r["token"], r["df"], round(r["idf"], 9)) for r in ix.LexicalIndex.build(table(spark, have), f"file://{tmp_path}/j").terms.collect()}
    assert {(r["token"], r["df"], round(r["idf"], 9)) for r in index.terms.collect()} == want
    assert rows(index.search(asked, 3, allowed=table(spark, {5: "", 6: "", 30: "", 0: ""}))) == rows(rt.bm25(table(spark, have), asked, 3, allowed=table(spark, {5: "", 6: "", 30: "", 0: ""})))


def test_segments_become_larger_ones(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(ix, "FAN_OUT", 3)
    have = texts(range(4), 5)
    index = ix.LexicalIndex.build(table(spark, have), f"file://{tmp_path}/i")
    for step in range(1, 6):
        more = texts(range(3 * step, 3 * step + 4), step)
        index = index.append(table(spark, more))
        have |= more
    same(index, spark, have, asked)
    assert len(index.state["segments"]) <= 4 and len(index.state["deletes"]) < 3
    assert vs.Versions(spark, index.path).collected() > 0
    same(ix.LexicalIndex.load(spark, index.path), spark, have, asked)


def test_batches_are_put_in_once(spark, tmp_path, asked):
    index = ix.LexicalIndex.build(table(spark, {1: "fish"}), f"file://{tmp_path}/i").append(table(spark, {2: "ham"}), 0)
    again = index.append(table(spark, {2: "other"}), 0)
    assert again.number == index.number and rows(again.search(asked, 3)) == rows(index.search(asked, 3))


def test_a_writer_that_stops_leaves_the_old_version(spark, tmp_path, asked, monkeypatch):
    have = texts(range(12), 7)
    path = f"file://{tmp_path}/i"
    ix.LexicalIndex.build(table(spark, have), path)

    def stop(self):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ix.LexicalIndex, "_committed", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            ix.LexicalIndex.load(spark, path).append(table(spark, {1: "fish fish", 50: "ham"}))
    same(ix.LexicalIndex.load(spark, path), spark, have, asked)


def test_of_two_writers_one_wins(spark, tmp_path, asked):
    path = f"file://{tmp_path}/i"
    ix.LexicalIndex.build(table(spark, {1: "fish"}), path)
    a, b = ix.LexicalIndex.load(spark, path), ix.LexicalIndex.load(spark, path)
    a.append(table(spark, {2: "ham"}))
    with pytest.raises(vs.Conflict):
        b.append(table(spark, {3: "egg"}))
    same(ix.LexicalIndex.load(spark, path), spark, {1: "fish", 2: "ham"}, asked)
    assert rows(b.search(asked, 3)) == rows(rt.bm25(table(spark, {1: "fish"}), asked, 3))  # readers keep their version


def test_the_scan_is_told_the_tokens(spark, tmp_path, asked):
    index = ix.LexicalIndex.build(table(spark, texts(range(20), 9)), f"file://{tmp_path}/i")
    plan = index.search(asked, 3)._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(token, [" in plan.replace("\n", "")


@pytest.mark.parametrize("pushed,turns", [(0, 200_000), (4000, 3)])
def test_searches_beyond_the_bounds(spark, tmp_path, asked, monkeypatch, pushed, turns):
    monkeypatch.setattr(ix, "PUSHED", pushed)
    monkeypatch.setattr(ix, "ASKED", turns)
    have = texts(range(20), 11)
    index = ix.LexicalIndex.build(table(spark, have), f"file://{tmp_path}/i").append(table(spark, {3: "fish hat"}))
    same(index, spark, have | {3: "fish hat"}, asked)


def test_blocks_that_cant_count_are_skipped():
    import pyarrow as pa

    weight = lambda tf, dl: tf / (tf + dl)
    ranking = ix.Ranking([[(0, 2.0), (1, 1.0)], [(1, 1.0)]], 2, weight, False, False)
    draw, blocks, all_rows = random.Random(4), [], []
    for block in range(12):
        n = 6
        ids, dls = list(range(block * n, block * n + n)), [draw.randint(5, 9) for _ in range(n)]
        blocks.append((block, 0, None, ids, dls, None, None, None, None))
        scores = [[0.0] * n, [0.0] * n]
        for token in (0, 1):
            places = sorted(draw.sample(range(n), 3))
            tfs = [draw.randint(1, 5) if block == 2 else 1 for _ in places]
            blocks.append((block, 3, f"t{token}", None, None, max(tfs), min(dls[p] for p in places), places, tfs))
            for p, tf in zip(places, tfs):
                w = tf / (tf + dls[p])
                scores[0][p] += (2.0 if token == 0 else 1.0) * w
                scores[1][p] += w if token == 1 else 0
        all_rows.append((ids, scores))
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("token", pa.string()), ("ids", pa.list_(pa.int64())), ("dls", pa.list_(pa.int32())), ("most", pa.int32()), ("short", pa.int32()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
    ranking.take(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*blocks), schema)], schema=schema), {"t0": 0, "t1": 1})
    ranking.finish()
    for q in (0, 1):
        want = sorted((-round(s[q][i], 6), ids[i]) for ids, s in all_rows for i in range(6) if s[q][i] > 0)[:2]
        assert ranking.best[q] == want
    assert ranking.skipped > 0


def test_tokens_are_kept_as_a_line_and_taken_off_again(spark, tmp_path):
    """An array of tokens is several times as large as their text, also while it is put in order."""
    rows = [(5, "B a, a"), (3, ""), (4, "..."), (1, None), (2, "İstanbul a-1 K")]
    index = ix.LexicalIndex.build(spark.createDataFrame(rows, "chunk_id long, text string"), str(tmp_path / "index"))
    docs = {r["chunk_id"]: (r["dl"], r["words"]) for r in index._table("docs").collect()}
    assert docs == {1: (0, ""), 2: (5, "i stanbul a 1 k"), 3: (0, ""), 4: (0, ""), 5: (3, "b a a")}
    left = index.removed(spark.createDataFrame([(5,), (3,), (4,)], "chunk_id long"))
    assert {r["token"]: r["df"] for r in left.terms.collect()} == {"i": 1, "stanbul": 1, "a": 1, "1": 1, "k": 1}


def test_an_append_moves_no_texts(spark, tmp_path, asked, monkeypatch):
    """Chunks are computed once and written with the segment; those known before are found by id."""
    monkeypatch.setattr(ix, "PUSHED", 0)
    have = texts(range(30), 21)
    index, seen = ix.LexicalIndex.build(table(spark, have), f"file://{tmp_path}/i"), []
    written = ix.storage.written
    monkeypatch.setattr(ix.storage, "written", lambda df, *name: (seen.append(df), written(df, *name))[1])
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    more = texts(range(20, 40), 22)
    index = index.append(table(spark, more).mapInPandas(counted, "chunk_id int, text string"))
    assert computed.value == len(more)
    assert seen and not any({"text", "words"} & set(df.columns) for df in seen)
    same(index, spark, have | more, asked)


def test_counts_of_all_widths_are_kept_as_bytes(spark, tmp_path):
    have = {1: "fish " * 300 + "ham", 2: "egg " * 70_000 + "fish", 3: "hat", 4: ""}
    index = ix.LexicalIndex.build(table(spark, have), f"file://{tmp_path}/i")
    widths = {r["token"]: len(r["tfs"]) // r["n"] for r in index._table("postings").filter("token in ('egg', 'hat')").collect()}
    assert widths == {"egg": 4, "hat": 1}
    same(index, spark, have, spark.createDataFrame([(1, "fish"), (2, "egg hat"), (3, "ham")], "query_id int, text string"))


def test_a_large_file_of_a_stream_is_dealt_to_all_tasks(spark, tmp_path):
    from docquarry import streaming as st

    path = f"file://{tmp_path}/one"
    table(spark, texts(range(200), 23)).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    dealt = st.spread(one, "chunk_id")
    if spark.sparkContext.defaultParallelism > 1:
        assert "REPARTITION_BY_COL" in dealt._jdf.queryExecution().executedPlan().toString()
    many = one.repartition(4 * spark.sparkContext.defaultParallelism)
    assert st.spread(many, "chunk_id") is many
    assert sorted(dealt.collect()) == sorted(one.collect())
