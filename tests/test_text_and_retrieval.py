"""Small cases of retrieval, claims, grounding and data-set operators, with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answers as an
from docquarry.operators import catalogue as ca
from docquarry.operators import claims as cl
from docquarry.operators import documents as dc
from docquarry.operators import evaluation as ev
from docquarry.operators import retrieval as rt
from docquarry.operators import sampling as sa


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_stem_falls_through_to_shorter_suffixes(spark):
    got = [one(spark, tx.stem(F.lit(w))) for w in ("training", "networks", "utilizes", "used", "sing", "class")]
    assert got == ["train", "network", "utiliz", "used", "sing", "clas"]


def test_citation_ids_keep_order_and_drop_repeats(spark):
    assert one(spark, tx.citation_ids(F.lit("a [3] b [1, 3] c [2][x]"))) == [3, 1, 2]


@pytest.mark.parametrize("words,want", [([], []), (["a"], []), (list("abc"), ["a b", "b c"]), (list("aaa"), ["a a"])])
def test_ngrams(spark, words, want):
    assert one(spark, tx.ngrams(F.lit(words).cast("array<string>"), 2)) == want


def test_fusion_orders_by_sum_then_first_list(spark):
    rows = lambda x: spark.createDataFrame(x, "query_id int, chunk_id string, rank int")
    a, b = rows([(1, "c1", 1), (1, "c2", 2)]), rows([(1, "c2", 1), (1, "c3", 2)])
    got = rt.fuse([(a, 1.0), (b, 1.0)], 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c2", "c1", "c3"]
    assert got[0]["score"] == round(1 / 61 + 1 / 62, 9)


def test_bm25_against_the_formula(spark):
    texts = {1: "red fish blue fish", 2: "one fish", 3: "green eggs and ham", 4: "old hat", 5: "new shoes"}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id int, text string")
    asked = spark.createDataFrame([(9, "fish fish")], "query_id int, text string")
    docs = {k: t.split() for k, t in texts.items()}
    avg = sum(map(len, docs.values())) / 5
    idf = math.log(5 - 2 + 0.5) - math.log(2 + 0.5)
    score = lambda d: 2 * idf * d.count("fish") * 2.5 / (d.count("fish") + 1.5 * (0.25 + 0.75 * len(d) / avg))
    got = {r["chunk_id"]: r["score"] for r in rt.bm25(chunks, asked, 5).collect()}
    assert got == {k: round(score(d), 6) for k, d in docs.items() if "fish" in d}
    padded = rt.bm25(chunks, asked, 4, pad=True).orderBy("rank").collect()
    assert [r["chunk_id"] for r in padded][2:] == [3, 4] and padded[3]["score"] == 0


def test_single_hit_at_rank_three(spark):
    ranked = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcd")], "query_id int, chunk_id string, rank int")
    relevant = spark.createDataFrame([(1, "c")], "query_id int, chunk_id string")
    got = ev.per_query(ev.judged_hits(ranked, relevant)).first()
    assert (got["recall_at_1"], got["recall_at_3"], got["mrr"], got["ndcg_at_10"]) == (0.0, 1.0, 0.333333, 0.5)


def test_citation_metrics_in_their_three_regimes(spark):
    schema = "g int, status string, citation_ids array<int>"
    mixed = [(1, "SUPPORTED", [1]), (1, "PARTIALLY_SUPPORTED", [2]), (1, "UNSUPPORTED", []), (1, "CONTRADICTED", [3])]
    rows = spark.createDataFrame([*mixed, (2, "NOT_VERIFIED", [1]), (3, "SUPPORTED", [])], schema)
    got = {r["g"]: r for r in ev.citation_metrics(rows, "g").collect()}
    assert (got[1]["coverage"], got[1]["precision"], got[1]["faithfulness"], got[1]["unsupported_rate"]) == (0.75, 0.666667, 0.25, 0.5)
    assert (got[2]["precision"], got[2]["faithfulness"]) == (None, None)
    assert got[3]["precision"] == 0.0
    assert ev.citation_metrics(rows.filter("g = 9")).first()["coverage"] == 0.0


def test_claims(spark):
    answer = "# Findings\nThe main points are:\n- The model works well on long texts. [1]\n[2]\nIt is fast [9]. Short one.\n**Bold**"
    rows = spark.createDataFrame([(1, answer, [1, 2])], "answer_id int, answer string, evidence_ids array<int>")
    got = [(r["text"], r["citation_ids"]) for r in cl.claims(rows).orderBy("claim_no").collect()]
    assert got == [("The model works well on long texts. [1] [2]", [1, 2]), ("It is fast [9].", [])]


@pytest.mark.parametrize(
    "text,cited,label",
    [
        ("graph networks learn molecular structure", [], "none"),
        ("graph networks learn molecular structure [1]", ["graph networks learn molecular structure"], "strong"),
        ("graph networks learn molecular structure [1]", ["cooking pasta needs water"], "none"),
        ("accuracy of graph networks reaches 93.5 [1]", ["accuracy of graph networks reaches high values"], "none"),
        ("graph networks learn molecular structure [1][2]", ["graph networks learn molecular structure", "cooking pasta"], "weak"),
    ],
)
def test_grounding_labels(spark, text, cited, label):
    rows = spark.createDataFrame([(text, cited)], "text string, cited array<string>")
    assert cl.grounded(rows).first()["grounding"] == label


@pytest.mark.parametrize("response,want", [("STATUS: supported\nRATIONALE: yes", "SUPPORTED"), ("it is NOT SUPPORTED", "SUPPORTED"), ("partially_supported", "PARTIALLY_SUPPORTED"), ("", "UNSUPPORTED")])
def test_verdicts(spark, response, want):
    assert one(spark, cl.verdict(F.lit(response))) == want


def test_annotation_marks_the_first_occurrence_and_lists_the_rest(spark):
    got = one(spark, cl.annotated(F.lit("A b. A b."), F.array(F.lit("A b."), F.lit("zzz")), "(!)"))
    assert got == "A b. (!) A b.\n- zzz (!)"


EVIDENCE = {1: "the encoder improves translation accuracy on long documents by 12.5 points", 2: "bread needs flour and water"}


@pytest.mark.parametrize(
    "answer,reason",
    [
        ("", "empty"),
        ("The encoder improves translation accuracy on documents.", "no_citations"),
        ("The encoder improves translation accuracy on long documents [7].", "invalid_citation_id"),
        ("The encoder improves translation accuracy on long documents [1].", "ok"),
        ("The encoder improves translation accuracy on long documents by 99 points [1].", "number_not_in_evidence:99"),
        ("The encoder improves translation accuracy on long documents [1][2].", "irrelevant_citation"),
        ("This is supported by the given evidence on long documents [1].", "meta_commentary"),
    ],
)
def test_answer_filter(spark, answer, reason):
    rows = spark.createDataFrame([(answer, EVIDENCE)], "answer string, evidence map<int,string>")
    assert an.checked(rows, min_sentences=1).first()["reason"] == reason


def test_packing_overlaps_and_merges_small_rests():
    s = [f"w{i} " * 4 + "." for i in range(6)]
    chunks = dc.pack_sentences([x.strip() for x in s], size=12, overlap=5, least=3)
    assert all(len(c.split()) <= 12 for c in chunks)
    assert chunks[1].startswith("w1")
    assert dc.pack_sentences(["a " * 50], size=10, overlap=5, least=3) == ["a " * 50]
    assert dc.pack_sentences(["a b c d", "e"], size=4, overlap=0, least=3) == ["a b c d e"]


def test_sections_carry_over_pages_and_stay_in_references(spark):
    pages = [("d", 1, "Abstract\none\ntwo"), ("d", 2, "three\nReferences\nfour"), ("d", 3, "Methods\nfive")]
    got = dc.section_runs(spark.createDataFrame(pages, "document_id string, page_number int, text string")).orderBy("page_number", "run").collect()
    assert [(r["section"], r["text"]) for r in got] == [("Abstract", "one two"), ("Abstract", "three"), ("References", "four"), ("References", "five")]


def test_tables_round_trip(spark):
    grid = spark.createDataFrame([([["a", "b|c", ""], ["1", " 2  3 "], ["", ""]],)], "grid array<array<string>>").select(dc.clean_grid(F.col("grid")).alias("g"))
    assert grid.first()["g"] == [["a", "b|c"], ["1", "2 3"]]
    md = grid.select(dc.grid_to_markdown(F.col("g")).alias("m")).first()["m"]
    assert md == "| a | b\\|c |\n| --- | --- |\n| 1 | 2 3 |"


def test_upsert_keeps_and_overwrites(spark):
    schema = "id int, title string, at int"
    table, changes = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], schema), spark.createDataFrame([(2, "B", 99), (3, "C", 30)], schema)
    got = sorted(tuple(r) for r in ca.upsert(table, changes, "id", keep=("at",)).collect())
    assert got == [(1, "a", 10), (2, "B", 20), (3, "C", 30)]
    again = ca.upsert(ca.upsert(table, changes, "id", keep=("at",)), changes, "id", keep=("at",))
    assert sorted(tuple(r) for r in again.collect()) == got


def test_splits_don_t_leak_and_are_whole(spark):
    got = sa.split_papers(spark.range(10).withColumnRenamed("id", "k"), "k").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"val": 1, "test": 1, "train": 8}
    assert sa.split_papers(spark.range(1).withColumnRenamed("id", "k"), "k").first()["split"] == "train"


def test_allocation_never_exceeds_a_pool(spark):
    pools = spark.createDataFrame([("a", 10, 0.5), ("b", 100, 0.5), ("c", 0, 0.2)], "task string, pool long, ratio double")
    assert {r["task"]: r["count"] for r in sa.allocated(pools).collect()} == {"a": 10, "b": 10, "c": 0}


def test_stream_resumes_without_repeats(spark, tmp_path):
    from docquarry.streaming import append_new

    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    first = spark.range(5)
    first.write.parquet(src)
    append_new(spark, src, first.schema, out, mark, lambda d: d, "id")
    spark.range(3, 8).write.mode("append").parquet(src)
    append_new(spark, src, first.schema, out, mark, lambda d: d, "id")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_entry_and_registry(spark, sf_dir):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_no_row_holds_a_block_of_queries_and_of_vectors(spark, monkeypatch):
    """Rows that hold both are batched by number, so a task's memory grew with the tables."""
    monkeypatch.setattr(rt, "SENT", 5)
    monkeypatch.setattr(rt, "VECTOR_BLOCK", 20)
    draw = np.random.default_rng(4)
    values = draw.integers(-3, 4, (150, 6)).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(values)] + [(200, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    queries = vectors.filter("chunk_id % 9 = 0 or chunk_id = 200").withColumnRenamed("chunk_id", "query_id")
    got = rt.dense(vectors, queries, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    want = {(q, c, float(s), n + 1) for q in range(0, 150, 9) for n, (s, c) in enumerate(sorted(((values[c] @ values[q], c) for c in range(150)), key=lambda x: (-x[0], x[1]))[:4])}
    assert {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in got.collect()} == want
    assert rt.dense(vectors, queries.limit(0), 4).count() == 0


def test_few_ranked_rows_go_to_the_texts(spark):
    """Texts aren't shuffled to be joined with what was found of them."""
    from docquarry import api

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranked = spark.createDataFrame([(1, 7, 1.0, 1), (1, 8, 0.5, 2)], "query_id long, chunk_id long, score double, rank int")
        chunks = spark.createDataFrame([(7, "a", 0, "s", "x"), (8, "b", 1, "s", "y"), (9, "b", 2, "s", "z")], "chunk_id long, document_id string, page_number int, section string, text string")
        joined = chunks.join(rt.sent(ranked), "chunk_id")
        assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
        titles = spark.createDataFrame([("a", "A")], "document_id string, title string")
        got = api.evidence_for(ranked, chunks, titles)
        assert sorted((r["chunk_id"], r["citation_id"], r["document_title"], r["text"]) for r in got.collect()) == [(7, 1, "A", "x"), (8, 2, "b", "y")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
