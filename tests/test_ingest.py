"""Files to processed papers, and tables from words, on small cases worked out by hand."""

from pyspark.sql import functions as F

from docquarry import sources as so
from docquarry import streaming as st
from docquarry.operators import geometry as ge
from docquarry.operators import ingest as ig
from docquarry.sources import settings
from docquarry.sources.settings import Settings

BODY = "This is the first sentence of it. Here is a second one that goes on. A third follows in 2019 and ends."


def test_files_to_papers(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "Good File.doc").write_text(f"A Title\n{BODY}\fMethods\n{BODY} {BODY}")
    (folder / "scan.doc").write_text("x\f\f")
    (folder / "bad.doc").write_text("!broken")
    (folder / "other.bin").write_text("not read")

    def parse(content: bytes):
        if content.startswith(b"!"):
            raise ValueError("broken")
        return content.decode().split("\f")

    out = f"file://{tmp_path}/out"
    got = {r["filename"]: r for r in ig.ingested(spark, f"file://{folder}", parse, out, "*.doc", settings=Settings(chunk_size=40, overlap=5, min_tokens=5)).collect()}
    assert set(got) == {"Good File.doc", "scan.doc", "bad.doc"}
    good = got["Good File.doc"]
    assert (good["title"], good["year"], good["num_pages"], good["status"], good["error"]) == ("A Title", 2019, 2, "indexed", None)
    assert good["document_id"].endswith("_good-file")
    assert [(c["page_number"], c["section"]) for c in good["chunks"]][0] == (1, "Unknown") and {c["section"] for c in good["chunks"] if c["page_number"] == 2} == {"Methods"}
    assert [c["chunk_id"] for c in good["chunks"]][:1] == [f"{good['document_id']}_p1_c0"] and all(c["token_count"] <= 45 for c in good["chunks"])
    assert (got["scan.doc"]["status"], got["scan.doc"]["title"], got["scan.doc"]["num_pages"], got["scan.doc"]["chunks"]) == ("scanned_needs_ocr", "scan", 0, [])
    assert got["bad.doc"]["status"] == "failed" and "broken" in got["bad.doc"]["error"]
    read = so.read_chunks(spark, out)
    assert read.count() == len(good["chunks"]) and {r["title"] for r in read.collect()} == {"A Title"}


def test_papers_with_tables_and_figures(spark):
    documents = spark.createDataFrame([(1, "a.pdf", "upload", None)], "document_id int, filename string, source string, uploaded_at timestamp")
    pages = spark.createDataFrame([(1, 1, BODY), (1, 2, f"Results\n{BODY}")], "document_id int, page_number int, text string")
    tables = spark.createDataFrame([(1, 2, 0, "Table 1. Sizes", "Table 1", [["k", "v"], ["a", "1"]])], "document_id int, page_number int, idx int, caption string, label string, grid array<array<string>>")
    figures = spark.createDataFrame([(1, 2, 0, "Figure 1. A plot", "Figure 1", "axis", "f.png")], "document_id int, page_number int, idx int, caption string, label string, figure_text string, image_path string")
    paper = ig.processed(documents, pages, tables, figures).first()
    assert [(c["chunk_type"], c["page_number"], c["section"], c["image_path"]) for c in paper["chunks"]] == [("text", 1, "Unknown", None), ("text", 2, "Results", None), ("table", 2, "Results", None), ("figure", 2, "Results", "f.png")]


def test_tables_from_words(spark):
    lines = [["model", "size", "score"], ["small net", "10", "0.5"], ["large", "200", ""], ["huge net", "", "0.9"]]
    words, n = [], 0
    for i, line in enumerate(lines):
        for j, cell in enumerate(line):
            for k, w in enumerate(cell.split()):
                words.append((1, n, 50.0 + 120 * j + 30 * k, 100.0 + 14 * i + (k % 2), 50.0 + 120 * j + 30 * k + 27, 110.0 + 14 * i + (k % 2), w))
                n += 1
    words += [(1, 500 + k, 50.0 + 30 * k, 220.0, 78.0 + 30 * k, 230.0, "after") for k in range(12)]  # behind a gap, all across
    words += [(2, 900, 50.0, 100.0, 80.0, 110.0, "alone")]
    schema = "page int, word_id int, x0 double, y0 double, x1 double, y1 double, text string"
    regions = spark.createDataFrame([(1, 7, 20.0, 90.0, 580.0, 700.0), (2, 8, 20.0, 90.0, 580.0, 700.0)], "page int, block_id int, x0 double, y0 double, x1 double, y1 double")
    got = ge.text_grids(spark.createDataFrame(words, schema), regions).collect()
    assert [(r["page"], r["block_id"], r["grid"]) for r in got] == [(1, 7, lines)]
    assert (got[0]["x0"], got[0]["y0"], got[0]["y1"]) == (50.0, 100.0, 152.0 + 1)
    assert ge.text_grids(spark.createDataFrame([], schema), regions).count() == 0


def test_ruled_tables_keep_their_captions(spark):
    blocks = spark.createDataFrame([(1, 0, 40.0, 80.0, 300.0, 92.0, "Table 1. Ruled"), (1, 1, 40.0, 300.0, 300.0, 312.0, "Table 2. Plain")], "page int, block_id int, x0 double, y0 double, x1 double, y1 double, text string")
    pages = spark.createDataFrame([(1, 0.0, 0.0, 600.0, 800.0)], "page int, left double, top double, right double, bottom double")
    grids = spark.createDataFrame([(1, 0, 40.0, 100.0, 300.0, 160.0, [["a", "b"], ["1", "2"]])], "page int, grid_id int, x0 double, y0 double, x1 double, y1 double, grid array<array<string>>")
    cells = [(1, i * 2 + j, 60.0 + 100 * j, 320.0 + 14 * i, 90.0 + 100 * j, 330.0 + 14 * i, f"c{i}{j}") for i in range(3) for j in range(2)]
    words = spark.createDataFrame(cells, "page int, word_id int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r["label"]: (r["how"], r["grid"]) for r in ge.all_tables(grids, blocks, words, pages).collect()}
    assert got == {"Table 1": ("lines", [["a", "b"], ["1", "2"]]), "Table 2": ("text", [["c00", "c01"], ["c10", "c11"], ["c20", "c21"]])}


def test_settings_of_many_deployments(spark):
    files = spark.createDataFrame([("a", "k1: 1.2\n# k1: 9\nModel = 'x' # c\nbroken"), ("b", "")], "deployment string, text string")
    over = spark.createDataFrame([("a", "DOCQUARRY_K1", "1.4"), ("b", "OTHER", "1"), ("b", "DOCQUARRY_NEW", "y")], "deployment string, name string, value string")
    got = {(r["deployment"], r["name"]): r["value"] for r in settings.effective(files, over).collect()}
    assert got["a", "k1"] == "1.4" and got["b", "k1"] == "1.5" and got["a", "model"] == "x" and got["b", "new"] == "y" and ("b", "other") not in got
    one = Settings.load("k1: 1.2\n# k1: 9\nModel = 'x' # c\nbroken", {"DOCQUARRY_K1": "1.4"})
    assert one.k1 == 1.4 and one.extra == {"model": "x"}


def test_keys_are_known_for_a_while(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    put = lambda *rows: spark.createDataFrame(list(rows), "k int, at string").select("k", F.col("at").cast("timestamp").alias("at")).coalesce(1).write.mode("append").parquet(src)
    run = lambda: st.append_new(spark, src, "k int, at timestamp", out, mark, lambda d: d, "k", at="at", within="2 days")
    put((1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"))
    run()
    put((1, "2024-01-02 00:00:00"), (3, "2024-01-02 00:00:00"))
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
