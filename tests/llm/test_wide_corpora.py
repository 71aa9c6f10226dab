"""What changes only for very large corpora: occurrences that are dealt twice."""

import numpy as np

from docquarry.llm import cross_entropy, near_duplicates, substrings

PASSAGE = " ".join(f"word{i}" for i in range(45))


def rows(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_repeats_are_the_same_when_dealt_twice(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(10_000 + i, f"start {i} {PASSAGE} end {i % 3} {PASSAGE if i % 5 == 0 else ''}") for i in range(60)] + [(None, PASSAGE), (None, PASSAGE), (20_000, None), (20_001, PASSAGE), (20_001, PASSAGE)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = rows(substrings.removed(docs, digest=True))
    assert sum(r[2] for r in want) > 1000
    for wide, hashes, again in ((3, 2_000, 500), (7, 20_000, 10_000_000)):
        monkeypatch.setattr(substrings, "WIDE", wide)
        monkeypatch.setattr(substrings, "HASHES_A_TASK", hashes)
        monkeypatch.setattr(substrings, "REGATHERED", again)
        assert rows(substrings.removed(docs, digest=True)) == want


def test_rows_of_a_gather_dont_grow_with_the_corpus():
    n = 50_000
    draw = np.random.default_rng(1)
    hashes = draw.integers(0, 1 << 62, n, dtype=np.uint64)
    docs = np.sort(draw.integers(0, 100, n))
    made = list(substrings._packed(hashes, docs, docs, np.arange(n), substrings.WIDE, False))
    assert len(made) <= substrings.WIDE + 1


def test_scores_are_the_same_through_finer_buckets(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a b c"), (9_999, ""), (9_998, None), (9_997, "the the the")], "doc_id long, text string"))
    good = docs.filter("doc_id % 3 = 0").select("doc_id")
    scores = lambda: sorted((tuple(r) for r in cross_entropy.score(docs, good).select("doc_id", "n_words", "target_loss", "background_loss", "score").collect()), key=repr)
    monkeypatch.setattr(cross_entropy, "GATHER_CHARS", 20_000)
    want = scores()
    for wide, merged in ((2, 1), (3, 4), (5, 1000)):
        monkeypatch.setattr(cross_entropy, "BUCKET_CHARS", 5_000)
        monkeypatch.setattr(cross_entropy, "WIDE", wide)
        monkeypatch.setattr(cross_entropy, "MERGED", merged)
        got = scores()
        assert [r[:2] for r in got] == [r[:2] for r in want]
        assert all(a == b or abs(a - b) < 1e-12 for x, y in zip(got, want) for a, b in zip(x[2:], y[2:]))


def test_groups_are_the_same_when_dealt_twice(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    base = [f"term{i}" for i in range(60)]
    more = [(5_000 + i, " ".join(base[: i % 7] + ["other"] * (i % 2) + base[i % 7 :])) for i in range(40)] + [(6_000, None), (6_001, "one"), (None, " ".join(base))]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    groups = lambda settings: sorted((tuple(r) for r in near_duplicates.groups(docs, settings).collect()), key=repr)
    for settings in (near_duplicates.Settings(shingle=2), near_duplicates.Settings(crowded=8)):
        monkeypatch.undo()
        want = groups(settings)
        assert sum(not r[3] for r in want) > 20
        monkeypatch.setattr(near_duplicates, "GATHERED", 1 << 5)
        monkeypatch.setattr(near_duplicates, "KEYS_A_TASK", 3_000)
        for wide, nodes, keys in ((2, 60_000, 1_000_000), (5, 64, 500)):
            monkeypatch.setattr(near_duplicates, "WIDE", wide)
            monkeypatch.setattr(near_duplicates, "NODES_AGAIN", nodes)
            monkeypatch.setattr(near_duplicates, "KEYS_AGAIN", keys)
            assert groups(settings) == want
