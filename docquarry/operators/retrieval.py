"""Retrieval over a batch of queries: BM25, dense vectors, rank fusion, decomposition, evidence.

Rank is a column: every result has rows (query_id, chunk_id, score, rank). Scores are rounded to six places before they
are ordered, and ties go to the smaller chunk, so that ranks don't depend on the order of summation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.sources import storage

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def postings(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id, tf, dl) of chunks (chunk_id, text)."""
    # the length is taken before the words are dealt out: else the text would be cut up anew for each of its words
    each = chunks.select("chunk_id", tx.tokens(F.col("text")).alias("words")).select("chunk_id", "words", F.size("words").alias("dl"))
    each = each.select("chunk_id", "dl", F.explode("words").alias("token"))
    return each.groupBy("token", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(tx.tokens(F.col("text")))).alias("avgdl"))


def floored(df: DataFrame, n: Column) -> DataFrame:
    """(token, df, idf) of (token, df) among n chunks: Okapi idf, where a negative one becomes EPSILON times the mean over
    the vocabulary."""
    raw = df.select("token", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg((EPSILON * F.avg("raw")).alias("floor"))  # one row
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.col("floor")).alias("idf"))


def term_statistics(post: DataFrame, corpus: DataFrame) -> DataFrame:
    """(token, df, idf) of postings; corpus: one row with n."""
    df = post.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus.select("n")))  # one row
    return floored(df, F.col("n"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, qf) of queries (query_id, text)."""
    return queries.select("query_id", F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of all chunks that share a token with the query.

    Only postings of query tokens are kept; document frequencies need no more than those, but the floor's mean needs
    the whole vocabulary."""
    post = postings(chunks)
    corpus = corpus_statistics(chunks)
    asked = query_tokens(queries)
    hits = post.join(asked, "token").join(term_statistics(post, corpus), "token").crossJoin(F.broadcast(corpus.select("avgdl")))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qf") * weight), 6).alias("score"))


def top(scored: DataFrame, k: int, *by: Column) -> DataFrame:
    """rank 1..k by score within each query."""
    order = Window.partitionBy("query_id").orderBy(*(by or (F.desc("score"), F.asc("chunk_id"))))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ranked(scored: DataFrame, ids: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
    """The k best of scored (query_id, chunk_id, score). `allowed` (chunk_id) restricts results. pad: where fewer have a
    positive score, chunks of ids without a score follow with 0, in order of id, before negative scores."""
    if allowed is not None:
        scored, ids = scored.join(allowed, "chunk_id", "left_semi"), ids.join(allowed, "chunk_id", "left_semi")
    if pad:
        counts = scored.groupBy("query_id").agg(F.count("*").alias("all"), F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("good"))
        none = F.lit(0).cast("long")
        short = queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("all", none).alias("all"), F.coalesce("good", none).alias("good")).filter(F.col("good") < k)
        # a query needs no more than its first k ids that have no score, so no more than k and those with one
        first = ids.orderBy("chunk_id").limit(k + (short.agg(F.max("all").alias("n")).first()["n"] or 0))
        zero = short.select("query_id").join(first).join(scored, ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
        scored = scored.unionByName(top(zero, k).drop("rank"))
    return top(scored, k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, pad: bool = False) -> DataFrame:
    """The k best chunks of each query, of chunks that have no index (see operators.index for one that is kept)."""
    return ranked(bm25_scores(chunks, queries), chunks.select("chunk_id"), queries, k, allowed, pad)


#: Vectors and queries that meet in a task, and queries of which the scores are held at once.
VECTOR_BLOCK, SENT, QUERY_BLOCK = 32768, 8192, 64


def dense(vectors: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k vectors with the largest inner product: vectors (chunk_id, embedding), queries (query_id, embedding), both
    with whole numbers as ids and vectors of one length; rows without a vector aren't found and find nothing.

    Either side is dealt into blocks of a bounded size, and each block of queries meets each block of vectors in a group of
    its own, so what a task holds doesn't grow with the tables. Of a group only a query's k best (by rounded score, then
    id) go on."""
    if allowed is not None:
        vectors = vectors.join(allowed, "chunk_id", "left_semi")
    vectors, queries = (df.filter(F.col("embedding").isNotNull()).select(F.col(c).cast("long").alias(c), "embedding") for df, c in ((vectors, "chunk_id"), (queries, "query_id")))
    spark = vectors.sparkSession
    many = max(1, -(-queries.count() // SENT))
    # some for each task, also if there are few vectors
    blocks = max(-(-vectors.count() // VECTOR_BLOCK), spark.sparkContext.defaultParallelism)
    dealt = lambda df, c, n: df.withColumn("part", F.pmod(F.xxhash64(c), F.lit(n)))
    facing = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    near = facing(dealt(vectors, "chunk_id", blocks).withColumnRenamed("part", "block"), many, "turn")
    asked = facing(dealt(queries, "query_id", many).withColumnRenamed("part", "turn"), blocks, "block")

    def matrix(table):
        column = table.column("embedding").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(column), -1)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            ids, asked = left.column("chunk_id").to_numpy(), right.column("query_id").to_numpy()
            values, wanted = matrix(left).T, matrix(right)
            most = min(k, len(ids))
            for at in range(0, len(asked), QUERY_BLOCK):
                scores = np.round(wanted[at : at + QUERY_BLOCK] @ values, 6)
                least = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most]
                query, place = np.nonzero(scores >= least[:, None])
                score = scores[query, place]
                order = np.lexsort((ids[place], -score, query))
                query, place, score = query[order], place[order], score[order]
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                query, place, score = (x[nth < most] for x in (query, place, score))
                found.append((asked[at + query], ids[place], score))
        columns = zip(*found, strict=True) if found else ([np.empty(0, t)] for t in ("<i8", "<i8", "<f8"))
        return pa.table([pa.array(np.concatenate(c)) for c in columns], names=["query_id", "chunk_id", "score"])

    pairs = near.groupBy("block", "turn").cogroup(asked.groupBy("block", "turn"))
    return top(pairs.applyInArrow(best, "query_id long, chunk_id long, score double"), k)


def fuse(lists: list[tuple[DataFrame, float]], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists, cut at k; ties: best in the earliest list, then by rank in it."""
    parts = [df.select("query_id", "chunk_id", "rank", F.lit(float(w)).alias("w"), F.lit(i).alias("list_no")) for i, (df, w) in enumerate(lists)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("w") / (rrf_k + F.col("rank"))), 9).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    return top(fused, k, F.desc("score"), F.asc("seen"), F.asc("chunk_id")).drop("seen")


def decomposed(queries: DataFrame) -> DataFrame:
    """(query_id, part, text): a question with ' and ' or 'compare' cut at the word and, if that makes several parts."""
    bits = F.filter(F.transform(F.split("text", r"(?i)\band\b"), lambda x: F.regexp_replace(x, r"^[ ,.;]+|[ ,.;]+$", "")), lambda x: x != "")
    asks = F.lower("text").contains(" and ") | F.lower("text").contains("compare")
    parts = F.when(asks & (F.size(bits) > 1), bits).otherwise(F.array("text"))
    return queries.select("query_id", F.posexplode(parts).alias("part", "text"))


def merged(results: DataFrame, k: int) -> DataFrame:
    """Results (query_id, chunk_id, score) of a query's parts: the best score of each chunk, cut at k."""
    return top(results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k)


#: Ranked rows up to which they go to all tasks, so that the texts they are joined with aren't shuffled.
RANKED_SENT = 500_000


def sent(ranked: DataFrame) -> DataFrame:
    """Ranked rows, written so that they are searched for once, to be joined with texts: sent to all tasks if they are few
    enough, else joined as Spark chooses."""
    kept = storage.written(ranked)
    return F.broadcast(kept) if kept.count() <= RANKED_SENT else kept


def numbered(ranked: DataFrame, catalogue: DataFrame, k: int) -> DataFrame:
    """The first k as evidence: citation_id from 1 and the title, or the id where the catalogue (document_id, title)
    has none. ranked has document_id."""
    order = Window.partitionBy("query_id").orderBy("rank")
    kept = ranked.withColumn("citation_id", F.row_number().over(order)).filter(F.col("citation_id") <= k)
    return kept.join(catalogue, "document_id", "left").withColumn("document_title", F.coalesce("title", F.col("document_id").cast("string"))).drop("title")


def capped(ranked: DataFrame, most: int) -> DataFrame:
    """Rows of the first `most` distinct documents by rank."""
    first = ranked.withColumn("first_rank", F.min("rank").over(Window.partitionBy("query_id", "document_id")))
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("first_rank"))
    return first.withColumn("doc_place", place).filter(F.col("doc_place") <= most).drop("first_rank")


def clustered(ranked: DataFrame, most: int = 6) -> DataFrame:
    """A cluster for each section; beyond `most`, the largest most - 1 keep theirs (ties: first seen) and the rest are
    'Other'. A blank section counts as 'General'."""
    named = ranked.withColumn("section", F.when(F.trim(F.coalesce("section", F.lit(""))) == "", "General").otherwise(F.col("section")))
    sizes = named.groupBy("query_id", "section").agg(F.count("*").alias("n"), F.min("rank").alias("seen"))
    by_query = Window.partitionBy("query_id")
    sizes = sizes.withColumn("many", F.count("*").over(by_query)).withColumn("place", F.row_number().over(by_query.orderBy(F.desc("n"), "seen")))
    cluster = F.when((F.col("many") > most) & (F.col("place") >= most), "Other").otherwise(F.col("section"))
    return named.join(sizes.select("query_id", "section", cluster.alias("cluster")), ["query_id", "section"])


#: Words of a passage that make an anchor.
ANCHOR = 4


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the documents (chunk_id, text) that hold a passage (query_id, text) as it is.

    A passage in a text has its inner words there as words, side by side. So an anchor, the first ANCHOR of them (or as
    many as there are) of largest hash, is looked up among the texts' runs of as many words, and only where it stands
    the texts are compared. Passages without an inner word stand for themselves: they are looked for in every text."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    runs = lambda w, n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
    inner = passages.select("query_id", F.col("text").alias("passage"), words(F.col("text")).alias("w")).withColumn("w", F.expr("if(size(w) > 2, slice(w, 2, size(w) - 2), array())"))
    inner = inner.withColumn("n", F.least(F.size("w"), F.lit(ANCHOR)))
    anchors = inner.filter("n > 0").select("query_id", "passage", "n", F.array_max(runs(F.col("w"), F.col("n"))).alias("anchor"))
    sizes = [r["n"] for r in anchors.select("n").distinct().collect()]  # at most ANCHOR
    cut = docs.select("chunk_id", words(F.col("text")).alias("w"))
    found = None
    for n in sorted(sizes):
        asked = anchors.filter(F.col("n") == n).select("query_id", "anchor")
        each = cut.filter(F.size("w") >= n).select("chunk_id", F.explode(F.array_distinct(runs(F.col("w"), F.lit(n)))).alias("anchor"))
        part = each.join(asked, "anchor").select("query_id", "chunk_id")
        found = part if found is None else found.unionByName(part)
    short = inner.filter("n = 0").select("query_id", "passage")
    whole = docs.join(short, F.expr("contains(text, passage)")).select("query_id", "chunk_id")
    if found is None:
        return whole
    held = found.distinct().join(passages.select("query_id", F.col("text").alias("passage")), "query_id").join(docs.select("chunk_id", "text"), "chunk_id")
    return held.filter(F.expr("contains(text, passage)")).select("query_id", "chunk_id").unionByName(whole)
