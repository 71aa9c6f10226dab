"""A library's catalogue, files, chunks and index change together, and last."""

import pytest
from pyspark.sql import functions as F

from docquarry import api
from docquarry.operators import library as lb
from docquarry.operators import retrieval as rt
from docquarry.operators import sampling as sa
from docquarry.sources import versions as vs

PAPER = "document_id string, title string, filename string, num_chunks long, status string, uploaded_at long"
CHUNK = "chunk_id string, document_id string, text string"


def papers(spark, *rows):
    return spark.createDataFrame([(i, t, f"{i}.pdf", 1, s, at) for i, t, s, at in rows], PAPER)


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNK)


def state_of(library):
    asked = library.spark.createDataFrame([(1, "fish ham egg shoe")], "query_id int, text string")
    listed = {r["document_id"]: (r["title"], r["status"], r["uploaded_at"]) for r in library.catalogue.collect()}
    kept = {r["chunk_id"]: r["text"] for r in library.table("chunks").collect()}
    found = {r["chunk_id"]: r["score"] for r in library.index.search(asked, 50, pad=True).collect()}
    table = library.spark.createDataFrame(list(kept.items()) or [("", "")], "chunk_id string, text string")
    want = {r["chunk_id"]: r["score"] for r in rt.bm25(table, asked, 50, pad=True).collect()} if kept else {}
    assert found == want  # the index is that of the chunks
    return listed, kept


def test_put_replace_and_delete(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    library = lb.Library(spark, path)
    assert state_of(library) == ({}, {})
    library = library.put(papers(spark, ("a", "A", "indexed", 1), ("b", "", "indexed", 1), ("c", "C", "scanned_needs_ocr", 1)), chunks(spark, ("a1", "a", "fish"), ("a2", "a", "ham"), ("b1", "b", "egg egg"), ("c1", "c", "shoe"), ("x1", "x", "shoe")))
    assert state_of(library) == ({"a": ("A", "indexed", 1), "b": ("b.pdf", "indexed", 1), "c": ("C", "scanned_needs_ocr", 1)}, {"a1": "fish", "a2": "ham", "b1": "egg egg"})
    before = lb.Library(spark, path)
    library = library.put(papers(spark, ("a", "A2", "indexed", 9)), chunks(spark, ("a1", "a", "shoe"), ("a3", "a", "ham fish")))
    want = {"a": ("A2", "indexed", 1), "b": ("b.pdf", "indexed", 1), "c": ("C", "scanned_needs_ocr", 1)}, {"a1": "shoe", "a3": "ham fish", "b1": "egg egg"}
    assert state_of(library) == want == state_of(lb.Library(spark, path))
    assert state_of(before)[1] == {"a1": "fish", "a2": "ham", "b1": "egg egg"}  # a reader keeps its version
    library, outcome = api.delete(library, spark.createDataFrame([("b",), ("nope",), ("b",)], "document_id string"))
    assert {r["document_id"]: r["outcome"] for r in outcome.collect()} == {"b": "deleted", "nope": "not_found"}
    assert state_of(library)[1] == {"a1": "shoe", "a3": "ham fish"}
    same, _ = api.delete(library, spark.createDataFrame([("nope",)], "document_id string"))
    assert same.number == library.number
    assert vs.Versions(spark, path).collected() > 0
    assert state_of(lb.Library(spark, path))[1] == {"a1": "shoe", "a3": "ham fish"}


def test_many_changes_keep_few_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lb, "FAN_OUT", 3)
    library = lb.Library(spark, f"file://{tmp_path}/l")
    for i in range(5):
        library = library.put(papers(spark, ("a", "A", "indexed", i), (f"d{i}", "D", "indexed", i)), chunks(spark, (f"a{i}", "a", "fish"), (f"d{i}1", f"d{i}", "egg")))
    assert state_of(library)[1] == {"a4": "fish", **{f"d{i}1": "egg" for i in range(5)}}
    assert len(library.state["chunks"]) < 3 and len(library.state["outdated"]) < 3


@pytest.mark.parametrize("step", ["catalogue", "outdated", "chunks", "index", "commit"])
def test_a_stop_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/l"
    library = lb.Library(spark, path).put(papers(spark, ("a", "A", "indexed", 1)), chunks(spark, ("a1", "a", "fish")))
    part = lb.Library._part

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(vs.Versions, "commit", stop)
        elif step == "index":
            m.setattr(lb.LexicalIndex, "changed", stop)
        else:
            m.setattr(lb.Library, "_part", lambda self, name, rows: stop() if name == step else part(self, name, rows))
        with pytest.raises(RuntimeError, match="stopped"):
            library.put(papers(spark, ("a", "B", "indexed", 2), ("b", "B", "indexed", 2)), chunks(spark, ("a1", "a", "egg"), ("b1", "b", "egg")))
    assert state_of(lb.Library(spark, path)) == ({"a": ("A", "indexed", 1)}, {"a1": "fish"})


def test_files_are_stored_and_deleted(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    files = spark.createDataFrame([("one.pdf", b"%PDF 1", 1), ("two.pdf", b"", 2), ("three.exe", b"x", 3)], "name string, content binary, uploaded_at long")
    library = api.store(lb.Library(spark, path), files)
    rows = {r["title"]: (r["document_id"], r["status"]) for r in library.catalogue.collect()}
    assert {t: s for t, (_, s) in rows.items()} == {"one.pdf": "uploaded", "two.pdf": "failed", "three.exe": "failed"}
    assert [(r["name"], bytes(r["content"])) for r in library.table("files").collect()] == [("one.pdf", b"%PDF 1")]
    done = rows["one.pdf"][0]
    library = api.index(library, papers(spark, (done, "One", "indexed", 9)), chunks(spark, ("c", done, "fish")))
    assert state_of(library)[0][done] == ("One", "indexed", 1)
    library, _ = api.delete(library, spark.createDataFrame([(done,)], "document_id string"))
    assert library.table("files").count() == 0 and state_of(library)[1] == {}


def test_a_frozen_sample_outlives_its_session(spark, tmp_path):
    rows = spark.range(100).select("id", F.lit("x").alias("kind"))
    first = {r["id"] for r in sa.frozen(sa.proportional(rows, "kind", "id", 7, seed=1), f"file://{tmp_path}/s").collect()}
    other = spark.newSession()
    again = sa.frozen(sa.proportional(other.range(50).select("id", F.lit("x").alias("kind")), "kind", "id", 7, seed=2), f"file://{tmp_path}/s")
    assert len(first) == 7 and {r["id"] for r in again.collect()} == first
