"""Labels moved to new chunks, when there are more than go to all tasks."""

from docquarry.operators import bags


def test_many_labels_bring_their_texts_along(spark, monkeypatch):
    chunk = lambda i: (i, i // 4, i % 4 // 2, f"a b c{i} d{i % 3}")
    new = spark.createDataFrame([chunk(i) for i in range(40)], "chunk_id long, document_id long, page_number int, text string")
    items = spark.createDataFrame([(d, d * 4 + d % 4, d) for d in range(12)], "item_id long, chunk_id long, document_id long")
    old = new.select("chunk_id", "page_number", "text")
    rows = lambda df: sorted(map(str, df.collect()))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    few = bags.remapped(items, old, new)
    monkeypatch.setattr(bags, "SENT", 0)
    many = bags.remapped(items, old, new)
    assert rows(many) == rows(few) and joins(many) == joins(few) - 1
