"""Page layout on extracted boxes: columns, regions, tables, figures and what is left as body text.

Boxes are rows, as a page parser gives them: blocks (page, block_id, x0, y0, x1, y1, text), graphics (page, graphic_id,
x0, y0, x1, y1), grids (page, grid_id, x0, y0, x1, y1, grid) and pages (page, left, top, right, bottom). All joins are
within a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators import documents as dc

PARAGRAPH, CAPTION_GAP, FIGURE_AREA, FIGURE_TEXT = 200, 60.0, 6000.0, 300


def _box(*names: str):
    return [F.col(n) for n in names]


def _area(x0, y0, x1, y1):
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def marked(blocks: DataFrame) -> DataFrame:
    """blocks with `label` (of a caption, else null), `kind` and whether they are prose."""
    label = dc.caption(F.col("text"))
    rows = blocks.withColumn("label", label)
    return rows.withColumn("kind", F.split_part("label", F.lit(" "), F.lit(1))).withColumn("prose", (F.length("text") >= PARAGRAPH) & F.col("label").isNull())


def column_spans(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, block_id, span0, span1): the x-range that what belongs to a caption can take. On a page of two columns (three
    blocks of prose, six tenths of them narrow) a caption clearly to one side has its own column, else the whole width."""
    width = F.col("right") - F.col("left")
    rows = marked(blocks).join(pages, "page")
    narrow = F.sum(F.when(F.col("prose") & (F.col("x1") - F.col("x0") < 0.6 * width), 1).otherwise(0))
    prose = F.sum(F.when(F.col("prose"), 1).otherwise(0))
    kinds = rows.groupBy("page").agg(((prose >= 3) & (narrow >= 0.6 * prose)).alias("two"))
    caps = rows.filter("label is not null").join(kinds, "page")
    centre = ((F.col("x0") + F.col("x1")) / 2 - F.col("left")) / width
    to_left, to_right = F.col("two") & (centre < 0.42), F.col("two") & (centre > 0.58)
    first = F.when(to_right, F.col("left") + width / 2 - 6).otherwise(F.col("left") + 20)
    last = F.when(to_left, F.col("left") + width / 2 + 6).otherwise(F.col("right") - 20)
    return caps.select("page", "block_id", first.alias("span0"), last.alias("span1"))


def regions_below(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, block_id, x0, y0, x1, y1): below each table caption, to the next prose or the page's margin; those lower than
    25 points go."""
    rows = marked(blocks)
    caps = rows.filter("kind = 'Table'").select("page", "block_id", F.col("y1").alias("cap"))
    prose = rows.filter("prose").select("page", F.col("y0").alias("next"))
    ends = caps.join(prose, "page", "left").groupBy("page", "block_id", "cap").agg(F.min(F.when(F.col("next") > F.col("cap") + 12, F.col("next"))).alias("next"))
    out = ends.join(pages, "page").join(column_spans(blocks, pages), ["page", "block_id"])
    out = out.withColumn("end", F.least(F.coalesce("next", F.col("bottom") - 36), F.col("bottom") - 36)).filter("end - cap >= 25")
    return out.select("page", "block_id", F.col("span0").alias("x0"), F.col("cap").alias("y0"), F.col("span1").alias("x1"), F.col("end").alias("y1"))


def tables(grids: DataFrame, blocks: DataFrame) -> DataFrame:
    """grids that look like tables, with the caption they have (block_id and label, null without) and the cells.

    A grid's caption is the nearest table caption within CAPTION_GAP above or below it; a caption goes to one grid, the
    nearest, and of equally near ones that with most cells."""
    caps = marked(blocks).filter("kind = 'Table'").select("page", "block_id", "label", F.col("y0").alias("c0"), F.col("y1").alias("c1"))
    rows = grids.withColumn("grid", dc.clean_grid(F.col("grid"))).withColumn("cells", F.size("grid") * F.coalesce(F.size(F.try_element_at("grid", F.lit(1))), F.lit(0)))
    gap = F.when(F.col("c1") <= F.col("y0") + 5, F.col("y0") - F.col("c1")).when(F.col("c0") >= F.col("y1") - 5, F.col("c0") - F.col("y1"))
    near = rows.join(caps, "page").withColumn("gap", gap).filter((F.col("gap") >= -5) & (F.col("gap") < CAPTION_GAP) & dc.looks_tabular(F.col("grid"), F.lit(True)))
    own = F.row_number().over(Window.partitionBy("page", "grid_id").orderBy("gap", "block_id"))
    claim = F.row_number().over(Window.partitionBy("page", "block_id").orderBy("gap", F.desc("cells"), "grid_id"))
    claimed = near.withColumn("n", own).filter("n = 1").withColumn("n", claim).filter("n = 1").select("page", "grid_id", "block_id", "label")
    out = rows.join(claimed, ["page", "grid_id"], "left")
    return out.filter(dc.looks_tabular(F.col("grid"), F.col("block_id").isNotNull()))


#: Gaps between words that part columns, of which the best grid's is taken; a gap between lines that ends a table.
COLUMN_GAPS, LINE_GAP = (4.0, 9.0, 18.0), 20.0


def text_grids(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, block_id, x0, y0, x1, y1, grid): the table that the words of a region make, where they look like one.

    words: (page, word_id, x0, y0, x1, y1, text); regions: (page, block_id, x0, y0, x1, y1), see regions_below(). Words
    whose heights overlap are a line; a gap of LINE_GAP ends the table. Words of all its lines whose widths overlap, or
    are nearer than a gap, are a column; of the grids of several gaps the one with most cells is taken, then that of the
    smallest gap."""
    outer = regions.select("page", "block_id", *(F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = words.join(outer, "page").filter((x >= F.col("r_x0")) & (x <= F.col("r_x1")) & (y >= F.col("r_y0")) & (y <= F.col("r_y1"))).select("page", "block_id", "word_id", "x0", "y0", "x1", "y1", "text")
    down = Window.partitionBy("page", "block_id").orderBy("y0", "x0", "word_id")
    reach = F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    rows = inside.withColumn("gap", F.col("y0") - reach)
    rows = rows.withColumn("line", F.sum(F.when(F.col("gap") >= -1, 1).otherwise(0)).over(down)).withColumn("cut", F.sum(F.when(F.col("gap") > LINE_GAP, 1).otherwise(0)).over(down)).filter("cut = 0")
    tried = rows.withColumn("apart", F.explode(F.array(*map(F.lit, COLUMN_GAPS))))
    across = Window.partitionBy("page", "block_id", "apart").orderBy("x0", "x1", "word_id")
    end = F.max("x1").over(across.rowsBetween(Window.unboundedPreceding, -1))
    tried = tried.withColumn("fresh", F.when(F.col("x0") - end > F.col("apart"), 1).otherwise(0)).withColumn("column", F.sum("fresh").over(across))
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "word_id", "text"))), lambda w: w["text"]), " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    cells = tried.groupBy("page", "block_id", "apart", "line", "column").agg(in_order.alias("cell"), *box)
    # cells are put into their lines first: each is looked for in its own line, not among all cells
    lines = cells.groupBy("page", "block_id", "apart", "line").agg(F.collect_list(F.struct("column", "cell")).alias("cells"), F.max("column").alias("columns"), *box)
    grids = lines.groupBy("page", "block_id", "apart").agg(F.array_sort(F.collect_list(F.struct("line", "cells"))).alias("lines"), F.max("columns").alias("columns"), *box)
    by_column = F.transform("lines", lambda row: F.map_from_entries(row["cells"]))
    grid = F.transform(by_column, lambda row: F.transform(F.sequence(F.lit(0).cast("long"), "columns"), lambda j: F.coalesce(F.try_element_at(row, j), F.lit(""))))
    # without a filter, for which Spark would make each grid anew: what doesn't look like a table has no size
    made = grids.withColumn("grid", dc.clean_grid(grid)).withColumn("tabular", dc.looks_tabular(F.col("grid"), F.lit(True)))
    size = F.when(F.col("tabular"), F.struct(F.size("grid") * F.size(F.try_element_at("grid", F.lit(1))), -F.col("apart")))
    best = F.max_by(F.struct("x0", "y0", "x1", "y1", "grid"), size)
    return made.groupBy("page", "block_id").agg(best.alias("b")).filter("b is not null").select("page", "block_id", "b.*")


def all_tables(grids: DataFrame, blocks: DataFrame, words: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, grid_id, block_id, label, x0, y0, x1, y1, grid, how): tables with rules (`lines`), and for captions that have
    none the words below them (`text`), whose grid_id is negative."""
    ruled = tables(grids, blocks).withColumn("how", F.lit("lines"))
    free = regions_below(blocks, pages).join(ruled.select("page", "block_id").filter("block_id is not null"), ["page", "block_id"], "left_anti")
    labels = marked(blocks).select("page", "block_id", "label")
    text = text_grids(words, free).join(labels, ["page", "block_id"]).withColumn("grid_id", -1 - F.col("block_id")).withColumn("how", F.lit("text"))
    names = ["page", "grid_id", "block_id", "label", "x0", "y0", "x1", "y1", "grid", "how"]
    return ruled.select(*names).unionByName(text.select(*names))


def covered(blocks: DataFrame, boxes: DataFrame, least: float) -> DataFrame:
    """(page, block_id, box_id): blocks of which at least so much lies in a box (page, box_id, x0, y0, x1, y1)."""
    outer = boxes.select("page", "box_id", *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    meets = blocks.join(outer, "page").filter("x0 < o_x1 and x1 > o_x0 and y0 < o_y1 and y1 > o_y0")
    return meets.filter(dc.inside_fraction(_box("x0", "y0", "x1", "y1"), _box("o_x0", "o_y0", "o_x1", "o_y1")) >= least).select("page", "block_id", "box_id")


def figures(blocks: DataFrame, graphics: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, block_id, label, x0, y0, x1, y1, text) of figure captions with graphics above them: the box around all
    graphics that lie by six tenths between the prose above and the caption, if it is large enough, and the first
    FIGURE_TEXT characters of the text in it."""
    rows = marked(blocks)
    caps = rows.filter("kind = 'Figure'").join(column_spans(blocks, pages), ["page", "block_id"]).select("page", "block_id", "label", F.col("y0").alias("cap"), "span0", "span1")
    above = rows.filter("prose").select("page", "x0", "x1", F.col("y1").alias("end"))
    tops = caps.join(above, "page", "left").withColumn("fits", (F.col("end") <= F.col("cap")) & (F.col("x0") < F.col("span1")) & (F.col("x1") > F.col("span0")))
    tops = tops.groupBy("page", "block_id", "label", "cap", "span0", "span1").agg(F.max(F.when(F.col("fits"), F.col("end"))).alias("end"))
    tops = tops.join(pages, "page").withColumn("r_top", F.greatest(F.coalesce("end", F.col("top") + 20), F.col("top") + 20))
    inside = dc.inside_fraction(_box("x0", "y0", "x1", "y1"), [F.col("span0"), F.col("r_top"), F.col("span1"), F.col("cap") + 2])
    held = tops.join(graphics.filter(_area(*_box("x0", "y0", "x1", "y1")) > 1.0), "page").filter(inside >= 0.6)
    boxes = held.groupBy("page", "block_id", "label").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    boxes = boxes.filter(_area(*_box("x0", "y0", "x1", "y1")) >= FIGURE_AREA)
    texts = covered(blocks, boxes.withColumnRenamed("block_id", "box_id"), 0.6).filter("block_id <> box_id").join(blocks.select("page", "block_id", "text"), ["page", "block_id"])
    texts = texts.groupBy("page", F.col("box_id").alias("block_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda s: s["text"]), " ").alias("t"))
    bare = F.substr(F.trim(F.regexp_replace(F.coalesce("t", F.lit("")), r"\s+", " ")), F.lit(1), F.lit(FIGURE_TEXT))
    return boxes.join(texts, ["page", "block_id"], "left").withColumn("text", bare).drop("t")


def body(blocks: DataFrame, found_tables: DataFrame, found_figures: DataFrame) -> DataFrame:
    """(page, text): the blocks that are in no table (by half) or figure (by six tenths) and aren't their captions."""
    in_tables = covered(blocks, found_tables.select("page", F.col("grid_id").alias("box_id"), "x0", "y0", "x1", "y1"), 0.5).select("page", "block_id")
    in_figures = covered(blocks, found_figures.select("page", F.col("block_id").alias("box_id"), "x0", "y0", "x1", "y1"), 0.6).select("page", "block_id")
    captions = found_tables.filter("block_id is not null").select("page", "block_id").unionByName(found_figures.select("page", "block_id"))
    left = blocks.join(in_tables.unionByName(in_figures).unionByName(captions).distinct(), ["page", "block_id"], "left_anti")
    texts = left.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda s: F.rtrim(s["text"])), "\n").alias("text"))
    return blocks.select("page").distinct().join(texts, "page", "left").select("page", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
