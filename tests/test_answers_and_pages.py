"""Small cases of answering, audits, kept indexes, page layout and files, with results worked out by hand."""

import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docquarry import sources as so
from docquarry import streaming as st
from docquarry.operators import answering as aw
from docquarry.operators import answers as an
from docquarry.operators import audits as au
from docquarry.operators import bags
from docquarry.operators import catalogue as ca
from docquarry.operators import documents as dc
from docquarry.operators import geometry as ge
from docquarry.operators import order as od
from docquarry.operators import reports as rp
from docquarry.operators import retrieval as rt
from docquarry.operators.index import LexicalIndex, VectorIndex
from docquarry.sources.settings import Settings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


TEXTS = {1: "red fish blue fish", 2: "one fish", 3: "green eggs and ham", 4: "", 5: "new shoes and old hat"}


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


def test_an_index_finds_what_a_search_without_one_finds(spark, tmp_path):
    chunks = spark.createDataFrame(list(TEXTS.items()), "chunk_id int, text string")
    asked = spark.createDataFrame([(7, "fish and ham"), (8, "nothing here"), (9, "")], "query_id int, text string")
    want = found(rt.bm25(chunks, asked, 3, pad=True))
    index = LexicalIndex.build(chunks.filter("chunk_id < 3"), f"file://{tmp_path}/i").append(chunks.filter("chunk_id >= 3"), 1)
    assert found(index.search(asked, 3, pad=True)) == want and len(want) == 9
    assert found(LexicalIndex.load(spark, f"file://{tmp_path}/i").search(asked, 3, pad=True)) == want
    assert LexicalIndex.load(spark, f"file://{tmp_path}/none") is None
    # the same part again replaces it
    assert found(index.append(chunks.filter("chunk_id >= 3"), 1).search(asked, 3, pad=True)) == want
    left = index.without(chunks.filter("chunk_id = 1"), f"file://{tmp_path}/j")
    assert found(left.search(asked, 3)) == found(rt.bm25(chunks.filter("chunk_id <> 1"), asked, 3))
    empty = LexicalIndex.build(chunks.filter("false"), f"file://{tmp_path}/e")
    assert empty.search(asked, 3).count() == 0


def test_vectors_of_another_length_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    index = VectorIndex.build(rows, f"file://{tmp_path}/v", 2)
    assert index.search(rows.select(F.col("chunk_id").alias("query_id"), "embedding"), 1).filter("query_id = chunk_id").count() == 2
    with pytest.raises(Exception, match="hasn't 2 values"):
        index.append(spark.createDataFrame([(3, [1.0])], rows.schema), 2, 1)


@pytest.mark.parametrize("blocks", [(8192, 512), (3, 2)])
def test_dense_search_in_blocks(spark, blocks, monkeypatch):
    monkeypatch.setattr(rt, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(rt, "QUERY_BLOCK", blocks[1])
    draw = random.Random(3)
    rows = [(i, [float(draw.randint(-2, 2)) for _ in range(4)]) for i in range(40)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    asked = table.filter("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in rt.dense(table, asked, 5).collect()}
    for q, a in rows[::7]:
        best = sorted(rows, key=lambda r: (-sum(x * y for x, y in zip(a, r[1])), r[0]))[:5]
        assert [got[q, k + 1] for k in range(5)] == [r[0] for r in best]


def test_passages_are_found_where_they_stand(spark):
    docs = {1: "before the quick brown fox jumps over", 2: "the quick brown fox", 3: "xthe quick brown foxes y", 4: "quick", 5: "a b"}
    asked = {10: "the quick brown fox", 11: "quick", 12: "e quick brown f", 13: "a b", 14: "not there at all"}
    table = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} int, text string")
    got = {(r["query_id"], r["chunk_id"]) for r in rt.containing(table(docs, "chunk_id"), table(asked, "query_id")).collect()}
    assert got == {(q, d) for q, p in asked.items() for d, t in docs.items() if p in t}


def test_places_in_order(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    assert all(r["k"] == r["place"] for r in od.placed(rows, "k").collect())
    drawn = od.first_by(rows, F.col("k") * 8589934, "k").collect()
    assert all(r["place"] == r["k"] + 1 for r in drawn)


def _contained(spark, left, right, least=0.8):
    table = lambda d, k: spark.createDataFrame(list(d.items()), f"{k} int, text string")
    got = bags.contained(table(left, "left_id"), table(right, "right_id"), least).collect()
    assert len({(r["left_id"], r["right_id"]) for r in got}) == len(got)
    return {(r["left_id"], r["right_id"]): (round(r["containment"], 6), round(r["jaccard"], 6)) for r in got}


def _all_pairs(left, right, least):
    out = {}
    for (i, a), (j, b) in itertools.product(left.items(), right.items()):
        x, y = Counter(re.findall(r"\w+", (a or "").lower())), Counter(re.findall(r"\w+", (b or "").lower()))
        common, n, m = sum((x & y).values()), sum(x.values()), sum(y.values())
        if n and m and common / min(n, m) >= least:
            out[i, j] = round(common / min(n, m), 6), round(common / (n + m - common), 6)
    return out


def test_bags_within_bags(spark):
    assert _contained(spark, {1: "a b c d e f g", 2: "x"}, {1: "z a b c d e f a a", 2: "a b c"}) == {(1, 1): (round(6 / 7, 6), 0.6), (1, 2): (1.0, round(3 / 7, 6))}
    assert _contained(spark, {1: "five words and no more"}, {2: "Five words, and no more!"}) == {(1, 2): (1.0, 1.0)}  # below six words
    assert _contained(spark, {1: "a b c d e f g h"}, {2: "h g f e d c b a"}) == {(1, 2): (1.0, 1.0)}  # no run in common
    assert _contained(spark, {1: None, 2: "", 3: "?!"}, {1: None, 2: "", 3: "a"}) == {}
    assert _contained(spark, {1: "a a a a b"}, {2: "a b c", 3: "a a a a"}) == {(1, 3): (1.0, 0.8)}  # repeats count
    assert _contained(spark, {}, {1: "a"}) == {} == _contained(spark, {1: "a"}, {})


@pytest.mark.parametrize("sent", [bags.SENT, 0])
@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_every_pair_of_bags_is_found(spark, monkeypatch, least, sent):
    monkeypatch.setattr(bags, "SENT", sent)
    draw = random.Random(int(least * 10))
    text = lambda: " ".join("abcdefghijklmnop"[min(int(draw.expovariate(0.4)), 15)] for _ in range(draw.choice([0, 1, 2, 5, 10, 15, 30])))
    left, right = {i: text() for i in range(60)}, {i: text() for i in range(80)}
    assert _contained(spark, left, right, least) == _all_pairs(left, right, least)


def test_labels_move_to_new_chunks(spark):
    items = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (3, 12, 1), (4, 99, 1), (5, 10, 7), (6, 13, 2), (7, 14, 2), (8, 15, 3)], "item_id int, chunk_id int, document_id int")
    old = spark.createDataFrame([(10, 1, "a b c d e"), (11, 2, "f g h i j k"), (12, 9, "a b c d e"), (13, None, "m n o p"), (14, 5, "q"), (15, 1, "")], "chunk_id int, page_number int, text string")
    new = spark.createDataFrame(
        [(100, 1, 1, "e d c b a z"), (101, 1, 1, "a b c d"), (102, 1, 2, "f g x y z w"), (103, 1, 3, "a b c d e"), (104, 2, None, "m n o"), (105, 2, 4, "m n o p"), (106, 3, 1, "u"), (107, 3, 1, "v")],
        "chunk_id int, document_id int, page_number int, text string",
    )
    got = {r["item_id"]: (r["chunk_id_old"], r["chunk_id"], r["chunk_ids"], r["remap_overlap"], r["status"]) for r in bags.remapped(items, old, new).collect()}
    assert got == {
        1: (10, 100, [100, 101], 1.0, "confident"),  # on its page only; a tie goes to the more alike
        2: (11, 102, [102], 0.3333, "ambiguous"),  # on its page, though nothing there is close
        3: (12, 103, [103, 100, 101], 1.0, "confident"),  # its page is gone: the whole document
        4: (99, 99, [], None, "failed"),
        5: (10, 10, [], None, "failed"),
        6: (13, 104, [104], 1.0, "confident"),  # no page is a page
        7: (14, 104, [104], 0.0, "ambiguous"),
        8: (15, 106, [106], 0.0, "ambiguous"),
    }


def test_the_last_change_of_a_key_counts(spark):
    table = spark.createDataFrame([(1, "a", 5)], "id int, title string, at int")
    changes = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "p", 1), (2, "q", 1)], table.schema)
    assert sorted(tuple(r) for r in ca.upsert(table, changes, "id", order="at").collect()) == [(1, "x", 2), (2, "q", 1)]
    log = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "c", 2)], "id int, v string, at int")
    assert ca.latest(log, "id", "at").first()["v"] == "b"


@pytest.mark.parametrize(
    "text,want",
    [("Table 2. Results", "Table 2"), ("TABLE IV: x", "Table IV"), ("Figure 3 Shows", "Figure 3"), ("figure 3 shows that it works", None), ("Fig. 1", None), ("Tables 2. x", None)],
)
def test_captions(spark, text, want):
    assert one(spark, dc.caption(F.lit(text))) == want


QUESTION = "Which value of ABC-7 was found for the larger model?"


@pytest.mark.parametrize(
    "question,answer,kind,shares,text,grounding,want",
    [
        ("", "a", "text", False, "t", "strong", "empty"),
        ("Which?", "a b c", "text", False, "t", "strong", "bad question shape"),
        ("What does this paper say of the ABC value at all?", "a b c", "text", False, "t", "strong", "refers to the paper/text"),
        ("What value does Table 3 give for the ABC model?", "a b c", "text", False, "t", "strong", "refers to a table/figure label"),
        ("what value is given for the larger of both models?", "a b c", "text", False, "t", "strong", "generic question (names nothing specific)"),
        (QUESTION, "a b c", "text", True, "t", "strong", "copies the passage"),
        (QUESTION, "12", "table", False, "| 13 |", "none", "answer numbers not in the table"),
        (QUESTION, "12", "table", False, "| 12 |", "none", None),
        (QUESTION, "a b", "text", False, "t", "strong", "answer too short"),
        (QUESTION, "a b c", "text", False, "t", "none", "answer not grounded in the passage"),
        (QUESTION, "a b c", None, False, "t", "weak", None),
    ],
)
def test_question_reasons(spark, question, answer, kind, shares, text, grounding, want):
    lit = lambda x: F.lit(x).cast("string")
    assert one(spark, au.question_reason(lit(question), lit(answer), lit(kind), F.lit(shares), lit(text), lit(grounding))) == want


def test_audits(spark):
    items = [("a", "text", "what of the encoder", "encoder wins 12", "c1", "d"), ("b", "text", "what of the encoder", "encoder wins 99", "c1", "d"), ("c", "text", "quite other", "bread", "c2", "d"), ("d", "text", "q", "r", "gone", "d")]
    chunks = [("c1", "d", "the encoder wins 12 points"), ("c2", "d", "nothing but 12")]
    got = {r["qid"]: r for r in au.audited(spark.createDataFrame(items, "qid string, type string, question string, reference_answer string, chunk_id string, document_id string"), spark.createDataFrame(chunks, "chunk_id string, document_id string, text string")).collect()}
    assert {q: r["verdict"] for q, r in got.items()} == {"a": "suspect", "b": "broken", "c": "suspect", "d": "broken"}
    assert got["a"]["ambiguity"] == 1 and got["a"]["badness"] == 11 and got["b"]["missing"] == ["99"] and got["d"]["badness"] == 1000


def test_ambiguity_is_counted_without_pairs(spark):
    """Numbers that stand within others, several at once, repeated rows and ids, and no row for a label and a chunk."""
    random.seed(3)
    texts = ["12 and 3.5", "112.35", "3.5.12", "12", "no digits", None, "3 5 12.", "1.2.3.5"]
    chunks = [(random.choice(["c1", "c2", "c3", "c4", None]), random.choice("de"), random.choice(texts)) for _ in range(60)]
    items = [(f"q{i % 25}", "text", "q", random.choice(["12", "3.5 and 12", "2.3", "5 5", "77", "none", "12 3 5 1"]), random.choice(["c1", "c2", "zz", None]), random.choice(["d", "e", None])) for i in range(30)]
    frames = spark.createDataFrame(items, "qid string, type string, question string, reference_answer string, chunk_id string, document_id string"), spark.createDataFrame(chunks, "chunk_id string, document_id string, text string")
    want = Counter()
    for q, _, _, answer, c, d in items:
        numbers = re.findall(r"\d+(?:\.\d+)?", answer)
        fits = sum(x is not None and c is not None and x != c and y == d and t is not None and all(n in t for n in numbers) for x, y, t in chunks) if numbers else 0
        want[q] += fits * max(1, sum(x == c for x, _, _ in chunks if c is not None))  # a label meets each row of its chunk
    got = au.audited(*frames)
    assert {r["qid"]: r["ambiguity"] for r in got.collect()} == {q: want[q] for q, *_ in items}
    # pairs would be 4 million rows; joins by document alone have gone
    n = F.col("id").cast("string")
    many = spark.range(2000).select(n.alias("chunk_id"), F.lit("d").alias("document_id"), F.concat(F.lit("value 77 of "), n).alias("text"))
    asks = spark.range(2000).select(n.alias("qid"), F.lit("text").alias("type"), F.lit("q").alias("question"), F.lit("77").alias("reference_answer"), n.alias("chunk_id"), F.lit("d").alias("document_id"))
    big = au.audited(asks, many)
    assert big.agg(F.sum("ambiguity")).first()[0] == 2000 * 1999
    assert not re.search(r"Join\w* \[document_id#\d+L?\], ", big._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("reply,want", [('{"verdict": "ok"}', "ok"), ('```json\n{"verdict": "ok"}\n```', "ok"), ('So: {"verdict": "ok"}!', "ok"), ('{"verdict": "odd"}', None), ("none", None), ("{", None)])
def test_judge_replies(spark, reply, want):
    got = one(spark, au.parsed_verdict(F.lit(reply), ["ok"]))
    assert (got and got["verdict"]) == want


def test_values_and_scores(spark):
    assert one(spark, au.value_present(F.lit("1234 ± 5"), F.lit("It is 1,234 [2]."))) and not one(spark, au.value_present(F.lit("1234"), F.lit("It is 123.")))
    assert one(spark, au.is_value(F.lit("12 mm"))) and not one(spark, au.is_value(F.lit("It was twelve in the end")))
    assert tuple(one(spark, au.fast_score(F.lit("red fish 12 [3]"), F.lit("blue fish 12")))) == (True, 0.5)
    assert tuple(one(spark, au.neutral_score(F.lit("fish 123"), F.lit("fish 12")))) == (1.0, False, 2)
    assert one(spark, au.judge_text(F.lit("**LIMITATION**: It is [1, 2] so [3–4] ."))) == "It is so."
    assert one(spark, au.is_empty(F.lit("[4]")))


def test_second_tries(spark):
    lit = F.lit
    assert one(spark, aw.with_substance(lit("[4]"), lit("[2]"), lit("It is 4 [2]."))) == "It is 4 [2]."
    assert one(spark, aw.with_substance(lit("[4]"))) == aw.NO_ANSWER
    ids = F.array(lit(1))
    assert one(spark, aw.with_citations(lit("It grows."), lit("It grows [1]."), ids)) == "It grows [1]."
    assert one(spark, aw.with_citations(lit("It grows."), lit("It grows [2]."), ids)) == "It grows."
    assert one(spark, aw.with_citations(lit("The evidence does not specify this."), lit("It grows [1]."), ids)) == "The evidence does not specify this."
    two, same = F.array(lit("1"), lit("2")), F.array(lit("1"), lit("3"))
    assert one(spark, aw.with_values(lit("a"), lit("b"), two, F.array(lit("1")))) == "b" and one(spark, aw.with_values(lit("a"), lit("b"), two, same)) == "a"
    none = F.array().cast("array<struct<text:string,citation_ids:array<int>>>")
    assert one(spark, aw.cited_fraction(none)) == 0 and one(spark, aw.unsupported_rate(none, none)) == 1


def test_evidence_goes_into_a_context_and_out(spark):
    rows = spark.createDataFrame([(1, 1, "one\n\nmore"), (1, 2, "two [3] x")], "q int, citation_id int, text string")
    context = aw.context_text(rows, "q")
    assert context.first()["context"] == "[1] one\n\nmore\n\n[2] two [3] x"
    assert context.select(aw.evidence_of(F.col("context")).alias("e")).first()["e"] == {1: "one\n\nmore", 2: "two [3] x"}


def test_a_budget_takes_the_largest_choice_that_fits(spark):
    rows = spark.createDataFrame([(q, c, n) for q, n in ((1, 10), (2, 20), (3, 50)) for c in range(1, 6)], "query_id int, citation_id int, n int")
    got = aw.fitted(rows, "n", 90).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in got} == {1: 5, 2: 3}


def test_reranking_keeps_order_among_equals(spark):
    rows = spark.createDataFrame([(1, "a b", "x", "a", 2), (1, "a b", "y", "b", 1), (1, "a b", "z", "a b", 3)], "query_id int, query string, chunk_id string, text string, rank int")
    assert [r["chunk_id"] for r in aw.reranked(rows, 2).orderBy("rank").collect()] == ["z", "y"]
    assert aw.reranked(rows, 2, score=None).count() == 3


def test_embeddings_have_length_one(spark):
    got = aw.embedded(spark.createDataFrame([("red fish",), ("",)], "text string")).collect()
    assert sum(x * x for x in got[0]["embedding"]) == pytest.approx(1) and not any(got[1]["embedding"])


def test_comparisons_and_f1(spark):
    old, new = spark.createDataFrame([(1, True), (2, False), (3, True)], "q int, ok boolean"), spark.createDataFrame([(1, False), (2, True), (4, True)], "q int, ok boolean")
    assert rp.compared(old, new, "q", "ok").first().asDict() == {"in_both": 2, "only_old": 1, "only_new": 1, "passed_before": 2, "passed_after": 1, "gained": 1, "lost": 2}
    f = lambda p, r: one(spark, rp.f1(F.lit(p).cast("double"), F.lit(r).cast("double")))
    assert f(0, 0) == 0 and f(None, 1) is None and f(1, 0.5) == pytest.approx(2 / 3)
    assert one(spark, rp.percent(F.lit(0.125))) == "13%" and one(spark, rp.percent(F.lit(None).cast("double"))) == "—"


def test_tables_are_split_under_their_header(spark):
    grid = [["a", "b"], *([str(i), "x"] for i in range(40))]
    table = spark.createDataFrame([("d", 1, 0, "S", "", "Table 1", grid)], "document_id string, page_number int, idx int, section string, caption string, label string, grid array<array<string>>")
    got = dc.table_chunks(table, size=10).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["d_p1_t0", "d_p1_t1"] and all(r["text"].startswith("Table 1\n| a | b |") for r in got)


def test_lines_lose_their_spaces_and_no_digits(spark):
    """Trimming by name took a line's number for what was to be trimmed."""
    assert one(spark, dc.title_of(F.lit("  \n 4072490 \nmore"))) == "4072490"
    assert one(spark, dc.title_of(F.lit("0 of 5550"))) == "0 of 5550"
    assert one(spark, dc.markdown_to_grid(F.lit("  | a | b |\n | --- | --- |\n | 1 | 2 |"))) == [["a", "b"], ["1", "2"]]


def test_a_long_table_is_split_in_time_of_its_rows(spark):
    """20,000 rows took minutes while each row copied the parts before it."""
    grid = F.concat(F.array(F.array(F.lit("a"), F.lit("b"))), F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.array(i.cast("string"), F.lit("x"))))
    table = spark.range(1).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("idx"), F.lit("S").alias("section"), F.lit("").alias("caption"), F.lit("Table 1").alias("label"), grid.alias("grid"))
    began = time.monotonic()
    got = dc.table_chunks(table, size=20).select("text").collect()
    assert time.monotonic() - began < 20
    rows = [line for r in got for line in r["text"].split("\n")[3:]]
    assert len(got) == 1000 and len(rows) == len(set(rows)) == 20_000
    assert dc.table_chunks(table.withColumn("grid", F.slice("grid", 1, 1))).count() == 1 and dc.table_chunks(table.withColumn("grid", F.expr("cast(null as array<array<string>>)"))).count() == 0


def test_chunks_are_handed_on_before_a_batch_is_done(spark, monkeypatch):
    """A batch's documents were all packed, as Python objects, before any row went on."""
    texts = ["One two three. Four five six. Seven.", "", None, "Word. " * 30]
    pages = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").coalesce(1)
    want = sorted((i, n, c, len(c.split())) for i, t in enumerate(texts) for n, c in enumerate(dc.pack_sentences([x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", (t or "").strip()) if x], 4, 1, 1)))
    for most in (dc.PACKED_BYTES, 1, 30):
        monkeypatch.setattr(dc, "PACKED_BYTES", most)
        assert sorted(map(tuple, dc.chunks(pages, 4, 1, 1).collect())) == want


def test_topics_end_chunks(spark):
    assert dc.pack_topics(["a b", "c d", "e f"], [0.1, 0.9], 0.5, size=10, overlap=0) == ["a b c d", "e f"]
    assert dc.pack_topics(["a b c d e"], [], 0.5, size=2, overlap=0) == ["a b", "c d", "e"]


def test_front_matter(spark):
    lines = [(1, 30.0, "arXiv:2208.06361v1 [x]"), (2, 18.0, "A Title"), (3, 17.8, "of Two Lines"), (4, 9.0, "Ann Lee"), (5, 9.0, "Some University"), (6, 9.0, "Bob de Vries"), (7, 9.0, "Abstract"), (8, 9.0, "Carl Doe")]
    got = dc.front_matter(spark.createDataFrame([("d", *x) for x in lines], "document_id string, line_no int, size double, text string")).first()
    assert got["title"] == "A Title of Two Lines" and got["authors"] == ["Ann Lee"]


def test_a_page_without_its_table_and_figure(spark):
    prose = "word " * 50
    blocks = [(1, 0, 40.0, 40.0, 560.0, 80.0, prose), (1, 1, 40.0, 100.0, 560.0, 115.0, "Table 1. Values"), (1, 2, 60.0, 130.0, 200.0, 140.0, "1 2"), (1, 3, 40.0, 300.0, 560.0, 340.0, prose), (1, 4, 50.0, 380.0, 100.0, 390.0, "axis"), (1, 5, 40.0, 500.0, 560.0, 515.0, "Figure 2: A plot"), (1, 6, 40.0, 600.0, 560.0, 640.0, "the end")]
    blocks = spark.createDataFrame(blocks, "page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(1, 0.0, 0.0, 600.0, 800.0)], "page int, left double, top double, right double, bottom double")
    grids = spark.createDataFrame([(1, 0, 50.0, 120.0, 550.0, 200.0, [["k", "v"], ["a", "1"], ["b", "2"]])], "page int, grid_id int, x0 double, y0 double, x1 double, y1 double, grid array<array<string>>")
    graphics = spark.createDataFrame([(1, 0, 45.0, 360.0, 300.0, 480.0)], "page int, graphic_id int, x0 double, y0 double, x1 double, y1 double")
    tables, figures = ge.tables(grids, blocks), ge.figures(blocks, graphics, pages)
    assert [(r["block_id"], r["label"]) for r in tables.collect()] == [(1, "Table 1")]
    assert [(r["label"], r["text"]) for r in figures.collect()] == [("Figure 2", "axis")]
    assert ge.body(blocks, tables, figures).first()["text"] == f"{prose.rstrip()}\n{prose.rstrip()}\nthe end"
    assert ge.regions_below(blocks, pages).first()["y1"] == 300


def test_settings():
    got = Settings.load("chunk_size: 100\n# no\nk1=2 # yes\nname: 'x'", {"DOCQUARRY_K1": "3", "HOME": "/"})
    assert (got.chunk_size, got.k1, got.overlap, dict(got.extra)) == (100, 3.0, 60, {"name": "x"})


def test_files(spark, tmp_path):
    assert so.read_jsonl(spark, f"file://{tmp_path}/none", "a int").count() == 0 and so.read_papers(spark, f"file://{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "a int, split string")
    assert so.write_splits(rows, f"file://{tmp_path}/s", ["a"]) is None
    before = so.write_splits(rows.filter("a = 1"), f"file://{tmp_path}/s", ["a"])
    assert so.read_splits(spark, before, "a int").count() == 2 and so.read_splits(spark, f"file://{tmp_path}/s", "a int").count() == 1
    assert st.micro_batches(spark.range(10), 4, "id").groupBy("batch").count().orderBy("batch").collect()[2]["count"] == 2
    entry = "<feed><entry><id>http://x/abs/2401.1v2</id><title> A\n B </title><summary>s</summary><published>2024-01-02</published><author><name>N</name></author></entry></feed>"
    got = one(spark, so.atom_entries(F.lit(entry)))[0]
    assert tuple(got) == ("2401.1", "A B", "s", 2024, ["N"])


def test_a_long_table_of_words_is_made_in_time_that_grows_with_its_cells(spark):
    lines, columns = 120, 12
    rows = [(1, i * columns + j, 40.0 + 45 * j, 50.0 + 14 * i, 60.0 + 45 * j, 60.0 + 14 * i, f"w{i}.{j}") for i in range(lines) for j in range(columns) if (i + j) % 7]
    words = spark.createDataFrame(rows, "page long, word_id long, x0 double, y0 double, x1 double, y1 double, text string")
    region = spark.createDataFrame([(1, 0, 0.0, 40.0, 600.0, 5000.0)], "page long, block_id int, x0 double, y0 double, x1 double, y1 double")
    began = time.time()
    got = ge.text_grids(words, region).collect()
    assert [r["grid"] for r in got] == [[[f"w{i}.{j}" if (i + j) % 7 else "" for j in range(columns)] for i in range(lines)]]
    assert time.time() - began < 20
