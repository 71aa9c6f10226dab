"""Periodic runs, the multi-index and product codes against plain versions, and on awkward tables."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from docquarry.llm import multi_index, periodic_runs, registry, vector_codes

SF = os.environ.get("DOCQUARRY_SF", "/root/testdata/sf0.001")


# Periodic runs ---------------------------------------------------------------------------------------------------------


def plain_runs(words, least=6, exponent=4):
    """All maximal runs by trying each period."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, exponent * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("least,exponent", [(6, 4), (1, 2), (2, 3), (10, 2)])
def test_runs_of_random_words(least, exponent):
    draw = random.Random(least * 10 + exponent)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(0, 6)):
            n, kinds = draw.choice([0, 1, 2, 5, 20, 60, 120]), draw.choice([1, 2, 3, 5])
            words = [draw.randrange(kinds) for _ in range(n)]
            if n > 20 and draw.random() < 0.6:
                a = draw.randrange(n)
                p = min(draw.randint(1, 8), n - a)
                words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
            texts.append(words)
        first = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        start, end, period = periodic_runs.runs(np.array([c for t in texts for c in t], np.int64), first, least, exponent)
        wanted = [(s + at, n, q) for t, at in zip(texts, first.tolist()) for s, n, q in plain_runs(t, least, exponent)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == wanted


def test_runs_of_fibonacci_words_and_of_one_word():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    first = np.array([0, len(b)])
    start, end, period = periodic_runs.runs(np.array(b), first, 2, 2)
    assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain_runs(b, 2, 2)
    n = 100_000
    assert [x.tolist() for x in periodic_runs.runs(np.zeros(n, np.int64), np.array([0, n]))] == [[0], [n], [1]]


def test_leaves_are_asked_in_slices(monkeypatch):
    words = np.array([random.Random(3).randrange(2) for _ in range(500)])
    whole = periodic_runs.runs(words, np.array([0, 500]), 2, 2)
    monkeypatch.setattr(periodic_runs, "ASKED", 7)
    assert [x.tolist() for x in periodic_runs.runs(words, np.array([0, 500]), 2, 2)] == [x.tolist() for x in whole]


LONG = " ".join(["alpha beta gamma"] * 20_000)
TEXTS = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "a a a a a a"),
    (5, "a a a a a a"),
    (None, "x y x y x y x y z"),
    (7, "say it  again\nsay it again\tsay it again say it again and stop stop stop stop stop stop"),
    (8, LONG),
    (9, "naïve Ünïcode naïve Ünïcode naïve Ünïcode naïve Ünïcode é"),
    (10, "no run a a a a a here"),
]


def test_collapsed_on_awkward_rows(spark):
    rows = spark.createDataFrame([(i, t, "r", 1) for i, t in TEXTS], "doc_id long, text string, Runs string, collapsed int")
    out = periodic_runs.collapsed(rows)
    assert out.columns == ["doc_id", "text", "collapsed", "runs"]
    got = sorted(((r["doc_id"] or 0, r["text"], [tuple(x) for x in r["runs"]]) for r in out.collect()), key=repr)
    wanted = []
    for i, t in TEXTS:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words) if t is not LONG else [(0, 60_000, 3)]
        wanted.append((i or 0, plain_collapsed(words, runs), runs))
    assert got == sorted(wanted, key=repr)
    assert periodic_runs.collapsed(rows.filter("false")).count() == 0


def test_op11_query_is_the_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op11_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]] or "")
        h = zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["n_runs"] == len(runs) and r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


# Multi-index -----------------------------------------------------------------------------------------------------------


def plain_nearest(rows, queries, k):
    """All candidates by cosine, then id."""
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in rows.items()}
    out = {}
    for q in queries:
        ranked = sorted((-sum(x * y for x, y in zip(rows[q], v)) / (norm[q] * norm[i]), i) for i, v in rows.items() if i != q)
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def clustered(n, width, seed):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((5, width))
    rows = random.standard_normal((n, width))
    rows[: n // 3] = centres[random.integers(0, 5, n // 3)] + 0.1 * rows[: n // 3]
    return rows


@pytest.mark.parametrize("n", [1, 3, 300, 2500])
def test_every_code_in_the_radius_is_found(n):
    random = np.random.default_rng(n)
    codes = random.integers(0, 1 << 63, n, dtype=np.uint64)
    codes[: n // 2] = codes[0] ^ (np.uint64(1) << random.integers(0, 64, n // 2, dtype=np.uint64))
    block = multi_index.Block(np.arange(n), random.standard_normal((n, 4)), codes, multi_index.tables_of(codes))
    balls = {}
    for radius in (0, 1, 2, 5, 11, 20, 31, 40, 64):
        for code in codes[:3].tolist() + [0, (1 << 64) - 1]:
            wanted = [i for i, c in enumerate(codes.tolist()) if (c ^ code).bit_count() <= radius]
            assert block.within(np.uint64(code), radius, balls).tolist() == wanted


def test_recall_against_brute_force(spark):
    for n, width, seed in ((3000, 24, 0), (5000, 96, 1)):
        rows = clustered(n, width, seed)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
        got = multi_index.MultiIndex.build(table, sample=1000).search(table.filter("vec_id % 50 = 0"), 5).collect()
        wanted = plain_nearest(dict(enumerate(rows.tolist())), range(0, n, 50), 5)
        found = {}
        for r in got:
            found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
        assert set(found) == set(wanted) and all(len(f) == 5 for f in found.values())
        hits = sum(i in found[q] for q in wanted for i, _ in wanted[q])
        assert hits >= 0.95 * 5 * len(wanted)
        assert all(abs(found[q][i] - s) < 1e-12 for q in wanted for i, s in wanted[q] if i in found[q])


def test_op12_query(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    wanted = plain_nearest(rows, [i for i in rows if i % 50 == 0], 5)
    out = registry.op12_multi_index(spark, SF)
    assert out.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert all([x[0] for x in g] == [1, 2, 3, 4, 5] and [(-x[2], x[1]) for x in g] == sorted((-x[2], x[1]) for x in g) for g in got.values())
    assert sum(len({i for _, i, _ in got[q]} & {i for i, _ in w}) for q, w in wanted.items()) >= 0.9 * 5 * len(wanted)


NAN, INF = float("nan"), float("inf")


def test_multi_index_on_awkward_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [1.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, []), (6, [1.0, None, 0.0]), (7, [NAN, 1.0, 0.0]), (8, [INF, 0.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (2, [1.0, 0.1, 0.0]), (100, [1e-200, 0.0, 0.0]), (50, [0.0, 1e200, 0.0]), (150, None)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, Rank int, id string")
    index = multi_index.MultiIndex.build(table)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in index.search(table.filter("vec_id % 50 = 0"), 4).collect())
    assert got == [
        (0, 1, 1, 1.0), (0, 2, 100, 1.0), (0, 3, 2, 0.995037), (0, 4, 50, 0.0),
        (50, 1, 2, 0.707107), (50, 2, 0, 0.0), (50, 3, 1, 0.0), (50, 4, 10, 0.0),
        (100, 1, 0, 1.0), (100, 2, 1, 1.0), (100, 3, 2, 0.995037), (100, 4, 50, 0.0),
    ]
    assert index.search(table.filter("vec_id = 0"), 50).count() == 5  # all candidates, if fewer
    assert index.search(table.filter("false"), 5).count() == 0
    none = multi_index.MultiIndex.build(table.filter("embedding is null"))
    assert none.search(table, 5).count() == 0


def test_equal_vectors_are_ranked_by_id(spark):
    rows = [(i, [float(np.float32(math.sin(j + i % 3))) for j in range(64)]) for i in range(700)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = multi_index.MultiIndex.build(table).search(table.filter("vec_id in (0, 1, 650)"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted((q, k + 1, v) for q in (0, 1, 650) for k, v in enumerate([i for i in range(700) if i % 3 == q % 3 and i != q][:5]))


# Product codes ---------------------------------------------------------------------------------------------------------


def test_multi_index_sends_no_queries_by_cell_to_all_tasks(spark):
    """Queries were copied for each cell and then broadcast, through the driver; the sample came from each task whole."""
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = multi_index.MultiIndex.build(vecs).search(vecs.filter("vec_id % 50 = 0"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    table = spark.createDataFrame([(i % 40, [float(i % 7), 1.0]) for i in range(200)], "id long, v array<double>")
    every = sorted(table.selectExpr("xxhash64(id) h", "id", "v").collect())
    assert [(r["id"], r["v"]) for r in multi_index._sample(table, 33)] == [(r["id"], r["v"]) for r in every[:33]]
    assert multi_index._sample(table.filter("id < 0"), 33) == []


@pytest.mark.parametrize("width", [1, 4, 7])
def test_annuli_find_the_nearest_entry_and_the_smaller_number_of_a_tie(width):
    random = np.random.default_rng(width)
    entries = random.integers(-30, 30, (64, width))
    entries[40:] = entries[:24]  # ties
    entries[3] = 0
    points = np.concatenate([random.integers(-40, 40, (3000, width)), entries, random.integers(-(1 << 28), 1 << 28, (200, width))])
    got, least = vector_codes.Annuli(entries).nearest(points)
    distance = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (got == distance.argmin(1)).all() and (least == distance.min(1)).all()
    spread = vector_codes.Annuli(np.outer(2 ** np.arange(20), np.ones(width)).astype(np.int64))
    begin, end = spread.intervals(spread.entries)
    assert (end - begin).max() == 1  # a point that is an entry is measured against no other


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label), in order of id."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        sums[label] = sums.get(label, 0) + out[-1][2]
    return sorted((i, code, error, sums[label], digest) for i, code, error, label in out)


def test_op13_query_is_the_plain_version(spark):
    rows = sorted((r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    got = sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in registry.op13_annular_codes(spark, SF).collect())
    assert got == plain_codes(rows)


def test_codes_on_awkward_rows(spark):
    width = 32
    random = np.random.default_rng(5)
    good = [(i, np.round(random.standard_normal(width), 3).tolist(), None if i % 3 == 0 else i % 2) for i in range(40)]
    good[7] = (7, good[6][1], 1)
    bad = [(100, None, 1), (101, [NAN] * width, 1), (102, [INF] + [0.0] * (width - 1), 1), (103, [None] + [0.0] * (width - 1), 1), (104, [1.0] * 16, 1), (105, [1e300] * width, 1), (106, [], 1)]
    table = spark.createDataFrame([(*r, "c", 1) for r in good + bad], "vec_id long, embedding array<double>, label int, Code string, point int").repartition(3)
    points = vector_codes.prepared(table)
    books = vector_codes.learn(points)
    coded = vector_codes.with_label_errors(vector_codes.encode(points, books))
    assert coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], books.digest()) for r in coded.collect()) == plain_codes(good)
    twice = vector_codes.prepared(table.unionByName(table).withColumn("vec_id", vector_null(table)))
    assert vector_codes.encode(twice, vector_codes.learn(twice)).count() == 80
    none = vector_codes.prepared(table.filter("vec_id >= 100"))
    assert vector_codes.with_label_errors(vector_codes.encode(none.filter("vec_id = 104"), vector_codes.learn(none))).count() == 1
    empty = vector_codes.prepared(table.filter("false"))
    assert vector_codes.with_label_errors(vector_codes.encode(empty, vector_codes.learn(empty))).count() == 0


def vector_null(table):
    from pyspark.sql import functions as F

    return F.when(F.col("vec_id") == 7, None).otherwise(F.col("vec_id"))


def test_hot_labels_and_seldom_ones(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_LABELS", 3)
    rows = spark.createDataFrame([(i, None if i < 20 else i, "c", i) for i in range(40)], "vec_id long, label int, code string, error long")
    got = {r["vec_id"]: r["label_error"] for r in vector_codes.with_label_errors(rows).collect()}
    assert got == {i: sum(range(20)) if i < 20 else i for i in range(40)}
