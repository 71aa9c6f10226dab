"""Token multisets: an exact containment join, and labels moved from old chunks to new ones by it.

A text's bag holds each word as often as it stands there. What two bags have in common, over the size of the smaller one,
is their containment.

The join is a prefix filter. All words have one order, seldom ones first. If a larger bag shares t of a smaller bag's n
words (with their repeats), it has at least m of the smaller's first n - t + m in that order, for any m up to t; so only
these are looked up, and pairs that have fewer in common are left. The others are confirmed on whole bags. Nothing is
asked of runs of words, so short texts and other orders of the same words are found as well."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquarry.functions import text as tx
from docquarry.llm import runtime
from docquarry.sources import storage

#: Containment from which a chunk counts as the same.
LEAST = 0.8
#: Ids, or words, up to which a table goes to all tasks instead of being joined by a shuffle.
SENT = 500_000
#: Words of a prefix that a pair must share: more make longer prefixes and fewer pairs to confirm.
MET = 5
#: Runs of words of all passages up to which they go to all tasks.
RUNS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits, marks and underscores, in order, with repeats."""
    return tx.all_of(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\w+")


def with_repeats(rows: DataFrame, name: str, out: str) -> DataFrame:
    """rows with `out`: the words of array `name` that stand there before, once for each further time."""
    rows = rows.withColumn("__sorted", F.sort_array(name))  # a column of its own: in a lambda it would be sorted each time
    return rows.withColumn(out, F.filter("__sorted", lambda x, i: (i > 0) & (F.get("__sorted", i - 1) == x))).drop("__sorted")


def in_common(a: str, b: str, more_a: str, more_b: str) -> Column:
    """How many words two arrays share, repeats counted: distinct ones, and as often as both have them again."""
    again = F.aggregate(F.array_intersect(more_a, more_b), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(more_a, lambda x: x == t)), F.size(F.filter(more_b, lambda x: x == t))))
    return F.size(F.array_intersect(a, b)) + again


def _scores(common: Column, n: Column, m: Column) -> list[Column]:
    ratio = lambda whole: F.coalesce(F.try_divide(common, whole), F.lit(0.0))
    return [ratio(F.least(n, m)).alias("containment"), ratio(n + m - common).alias("jaccard")]


def _sent(kept: DataFrame, size: Column) -> DataFrame:
    """A table that is cheap to read, to be sent to all tasks if it is small enough."""
    return F.broadcast(kept) if (kept.agg(size.alias("n")).first()["n"] or 0) <= SENT else kept


def contained(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """All pairs (left_id, right_id, containment, jaccard) of left (left_id, text) and right (right_id, text) of which one
    bag is contained in the other by `least` (above 0) or more. Ids are unique on each side.

    Texts without a word, null among them, are in no pair. left is the side that is meant to be smaller: the words of
    right are written once and read where needed, and not shuffled while what is looked for is within SENT. Beyond, both
    are joined by word and by id, and a word or text with very many rows is a skewed key, which Spark splits as it runs."""
    cut = lambda df, key: df.select(key, words(F.col("text")).alias("w")).select(key, "w", F.size("w").alias("n")).filter("n > 0")
    lefts, rights = storage.written(cut(left, "left_id")), storage.written(cut(right, "right_id"))
    often = storage.written(rights.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count("*").alias("df")))
    least_common = lambda n: F.greatest(F.ceil(n * F.lit(least) - 1e-9), F.lit(1))  # noqa: E731  the small number takes back what rounding adds

    def counted(side: DataFrame, key: str) -> DataFrame:
        return side.select(key, "n", F.explode("w").alias("t")).groupBy(key, "t").agg(F.count("*").alias("c"), F.first("n").alias("n"))

    def prefixes(side: DataFrame, key: str) -> DataFrame:
        """(t, id, n of the id, times, asked): the first words of each bag, how often they stand in its prefix, and how many
        of those a larger bag must have."""
        earlier = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "t").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted(side, key).join(often, "t", "left").withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        need = least_common(F.col("n"))
        placed = placed.withColumn("asked", F.least(need, F.lit(MET))).withColumn("times", F.least("c", F.col("n") - need + F.col("asked") - F.col("before"))).filter("times > 0")
        return _sent(storage.written(placed.select("t", key, F.col("n").alias(f"n_{key}"), "times", "asked")), F.count("*"))

    def met(larger: DataFrame, key: str, smaller: DataFrame, other: str, sized: str) -> DataFrame:
        each = larger.select(key, F.col("n").alias(f"n_{key}"), F.explode(F.array_distinct("w")).alias("t")).join(prefixes(smaller, other), "t").filter(sized)
        pairs = each.groupBy("left_id", "right_id").agg(F.sum("times").alias("times"), F.first("asked").alias("asked"), F.first("n_left_id").alias("n"), F.first("n_right_id").alias("m"))
        return pairs.filter("times >= asked").select("left_id", "right_id", "n", "m")

    longest = lefts.agg(F.max("n").alias("n")).first()["n"] or 0
    pairs = met(rights, "right_id", lefts, "left_id", "n_left_id <= n_right_id").unionByName(met(lefts, "left_id", rights.filter(F.col("n") < longest), "right_id", "n_right_id < n_left_id"))
    pairs = storage.written(pairs)
    # a text's words are counted once for all it is compared with, and of those only what the other side has
    asked = storage.written(counted(lefts, "left_id").select("left_id", "t", "c"))
    there = rights.join(_sent(pairs.select("right_id").distinct(), F.count("*")), "right_id").select("right_id", F.explode("w").alias("t"))
    there = there.join(_sent(asked.select("t").distinct(), F.count("*")), "t").groupBy("right_id", "t").agg(F.count("*").alias("d"))
    both = pairs.join(_sent(asked, F.count("*")), "left_id").join(there, ["right_id", "t"])
    both = both.groupBy("left_id", "right_id").agg(F.sum(F.least("c", "d")).alias("common"), F.first("n").alias("n"), F.first("m").alias("m"))
    return both.select("left_id", "right_id", *_scores(F.col("common"), F.col("n"), F.col("m"))).filter(F.col("containment") >= least)


def runs_shared(docs: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """(query_id, chunk_id, shared, n) of documents (chunk_id, text) and passages (query_id, text) that share distinct runs
    of n tokens: how many, and how many the passage has. Ids are unique on each side.

    Up to RUNS, the passages' runs go to all tasks, and of documents only the runs among them become rows. Beyond, both are
    joined by run."""
    # tokens and runs are columns of their own: an expression inside a lambda or above an explode is evaluated each time
    cut = lambda df, key: df.select(key, tx.tokens(F.col("text")).alias("t")).select(key, tx.ngrams(F.col("t"), n).alias("g")).select(key, "g", F.size("g").alias("n")).select(key, "n", F.explode("g").alias("gram"))
    asked = cut(passages, "query_id")
    few = asked.limit(RUNS + 1).collect()
    if len(few) > RUNS:
        each = cut(docs, "chunk_id").drop("n")
    else:
        grams = sorted({r["gram"] for r in few})
        number = {g: i for i, g in enumerate(grams)}
        schema = T.StructType([passages.schema["query_id"], T.StructField("n", T.IntegerType()), T.StructField("gram", T.LongType())])
        asked = F.broadcast(docs.sparkSession.createDataFrame([(r["query_id"], r["n"], number[r["gram"]]) for r in few], schema))
        each = _runs_among(docs, grams, n)
    return each.join(asked, "gram").groupBy("query_id", "chunk_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))


def _runs_among(docs: DataFrame, grams: list[str], n: int) -> DataFrame:
    """(chunk_id, gram): distinct runs of n tokens of documents that are among grams, by their number there."""
    storage.ship(docs.sparkSession)
    cut = [g.split(" ") for g in grams]
    vocabulary = sorted({t for g in cut for t in g})
    place = {t: i for i, t in enumerate(vocabulary)}
    # a run of j tokens is known by that of j - 1 and the last one: of each length the pairs, in order, and their numbers
    steps, known = [], np.array([place[g[0]] for g in cut], np.int64)
    for j in range(1, n):
        pairs = known * len(vocabulary) + np.array([place[g[j]] for g in cut], np.int64)
        found, known = np.unique(pairs, return_inverse=True)
        steps.append(found)
    final = np.zeros(len(grams), np.int64)
    final[known] = np.arange(len(grams))
    schema = T.StructType([docs.schema["chunk_id"], T.StructField("gram", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        words = pa.array(vocabulary, pa.string())
        for batch in batches:
            for part in runtime.steps(batch, "line"):
                lists = pc.split_pattern(part.column("line"), " ")
                sizes = np.asarray(lists.value_lengths().fill_null(0))
                codes = pc.index_in(lists.flatten(), words).fill_null(-1).to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                at = np.flatnonzero(codes[: max(len(codes) - n + 1, 0)] >= 0)
                at = at[owner[at] == owner[at + n - 1]]
                state = codes[at]
                for j, found in enumerate(steps, 1):
                    key = state * len(words) + codes[at + j]
                    to = np.minimum(np.searchsorted(found, key), len(found) - 1)
                    good = (found[to] == key) & (codes[at + j] >= 0)
                    at, state = at[good], to[good]
                both = np.unique(owner[at] * len(final) + final[state])
                if len(both):
                    doc, gram = np.divmod(both, len(final))
                    yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(doc)).cast(arrow.field(0).type), pa.array(gram)], schema=arrow)

    if not grams:
        return docs.sparkSession.createDataFrame([], schema)
    return docs.filter("text is not null").select("chunk_id", tx.token_line(F.col("text")).alias("line")).mapInArrow(runtime.relieved(run), schema)


def remapped(items: DataFrame, old: DataFrame, new: DataFrame, least: float = LEAST) -> DataFrame:
    """Where labels on old chunks point among new ones: (item_id, chunk_id_old, chunk_id, chunk_ids, remap_overlap, status).

    items: (item_id, chunk_id, document_id); old: (chunk_id, page_number, text); new: (chunk_id, document_id, page_number,
    text). An old chunk is compared with the new chunks of its document that are on its page or, if there are none, with
    all of the document; no page is a page of its own. Best is the largest containment, then Jaccard similarity, then the
    smaller id. chunk_ids are those contained by `least` or more, best first, or the best alone; it is `confident` where
    the best is among them, else `ambiguous`. An unknown chunk or a document without new chunks is `failed`: chunk_id
    stays and chunk_ids is empty.

    A chunk meets those of its own page or document only. Labels and their pages go to all tasks while they are within
    SENT; beyond, new chunks are joined by document with labels and their texts, once, and one with very many chunks is a
    skewed key, which Spark splits as it runs. Of a label's pairs, a row for each task goes on."""
    labels = items.select("item_id", "chunk_id", "document_id")
    few = labels.count() <= SENT
    labels = F.broadcast(labels) if few else labels
    asked = storage.written(old.select("chunk_id", F.col("page_number").alias("page"), "text").join(labels, "chunk_id"))
    pages = new.select("document_id", "page_number").distinct().withColumn("here", F.lit(True))
    same = (asked["document_id"] == pages["document_id"]) & asked["page"].eqNullSafe(pages["page_number"])
    scope = asked.join(pages, same, "left").select("item_id", asked["document_id"], "page", F.coalesce("here", F.lit(False)).alias("own_page"), *(() if few else ("text",)))
    there = new.select("document_id", "page_number", F.col("chunk_id").alias("right_id"), F.col("text").alias("other"))
    met = there.join(F.broadcast(scope) if few else scope, "document_id").filter(~F.col("own_page") | F.col("page").eqNullSafe(F.col("page_number")))
    # many labels bring their texts along, so that what they meet isn't shuffled again
    met = met.select("item_id", "right_id", "other").join(asked.select("item_id", "text"), "item_id") if few else met
    met = met.select("item_id", "right_id", words(F.col("text")).alias("a"), words(F.col("other")).alias("b"))
    met = with_repeats(with_repeats(met, "a", "more_a"), "b", "more_b").withColumn("common", in_common("a", "b", "more_a", "more_b"))
    met = met.select("item_id", "right_id", *_scores(F.col("common"), F.size("a"), F.size("b")))
    order = F.struct((-F.col("containment")).alias("c"), (-F.col("jaccard")).alias("j"), "right_id")
    found = met.groupBy("item_id").agg(F.min(order).alias("best"), F.collect_list(F.when(F.col("containment") >= least, order)).alias("good"))
    good = F.transform(F.sort_array("good"), lambda x: x["right_id"])
    ids = F.when(F.size("good") > 0, good).when(F.col("best").isNotNull(), F.array("best.right_id")).otherwise(F.array().cast(f"array<{dict(new.dtypes)['chunk_id']}>"))
    status = F.when(F.col("best").isNull(), "failed").when(-F.col("best.c") >= least, "confident").otherwise("ambiguous")
    out = items.select("item_id", F.col("chunk_id").alias("chunk_id_old")).join(found, "item_id", "left")
    return out.select("item_id", "chunk_id_old", F.coalesce("best.right_id", "chunk_id_old").alias("chunk_id"), ids.alias("chunk_ids"), F.round(-F.col("best.c"), 4).alias("remap_overlap"), status.alias("status"))
