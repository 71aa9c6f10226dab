"""Queries of chunking, data sets, sampling, audits and the catalogue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import answers as an
from docquarry.operators import bags
from docquarry.operators import catalogue as ca
from docquarry.operators import claims as cl
from docquarry.operators import documents as dc
from docquarry.operators import invariants as iv
from docquarry.operators import sampling as sa
from docquarry.plans import scoring
from docquarry.plans import views as v
from docquarry.sources import storage

SQL: dict[str, str] = {}
RUN: dict = {}


def query(sql: str | None = None):
    def add(f):
        RUN[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {v.CORPUS}, s AS (SELECT chunk_id, {v.SENTENCES.format('text')} AS x FROM corpus) SELECT chunk_id, unnest(range(0, len(x))) AS pos, unnest(x) AS sentence FROM s")
def sentence_split(spark, sf):
    return v.corpus(spark, sf).select("chunk_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))


@query(rf"WITH {v.CORPUS}, w AS (SELECT chunk_id, regexp_extract_all(text, '[^\s\x0B]+') AS x FROM corpus), p AS (SELECT chunk_id, x, unnest(range(0, (len(x) + 49) // 50)) AS part FROM w) SELECT chunk_id, part, array_to_string(x[part * 50 + 1 : part * 50 + 50], ' ') AS text FROM p")
def hard_split(spark, sf):
    return v.corpus(spark, sf).select("chunk_id", F.posexplode(dc.hard_split(F.col("text"), 50)).alias("part", "text"))


@query()
def chunk_fixed(spark, sf):
    return dc.chunks(v.corpus(spark, sf).select(F.col("chunk_id").alias("document_id"), "text"))


_HEADINGS = ["Abstract", "1. Introduction", "Methods:", "RESULTS", "2) Discussion", "limitation", "IV. Conclusions", "Not a heading", "References"]
_HEADED = "[" + ", ".join(f"'{h}'" for h in _HEADINGS) + "]"


@query(rf"""WITH {v.CORPUS}, pages AS (SELECT chunk_id // 3 AS document_id, chunk_id % 3 AS page_number, {_HEADED}[chunk_id % 9 + 1] || chr(10) || text AS text FROM corpus),
lines AS (SELECT document_id, page_number, unnest(range(0, len(x))) AS line_no, unnest(x) AS line FROM (SELECT *, string_split_regex(text, '\r?\n') AS x FROM pages)),
named AS (SELECT *, CASE regexp_replace(regexp_replace(lower(trim(line)), '(?i)^\s*(?:[ivxlc]+[.)]|\d+[.)]?)\s*', ''), '^[ :.\-]+|[ :.\-]+$', '', 'g') WHEN 'abstract' THEN 'Abstract' WHEN 'introduction' THEN 'Introduction' WHEN 'methods' THEN 'Methods'
  WHEN 'results' THEN 'Results' WHEN 'discussion' THEN 'Discussion' WHEN 'limitation' THEN 'Limitations' WHEN 'conclusions' THEN 'Conclusion' WHEN 'references' THEN 'References' END AS opens FROM lines),
placed AS (SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER d, 'Unknown') AS s, max((coalesce(opens, '') = 'References')::INT) OVER d AS pinned, sum((opens IS NOT NULL)::INT) OVER p AS run FROM named
  WINDOW d AS (PARTITION BY document_id ORDER BY page_number, line_no ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY document_id, page_number ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT document_id, page_number, run::BIGINT AS run, CASE WHEN pinned = 1 THEN 'References' ELSE s END AS section, string_agg(trim(line), ' ' ORDER BY line_no) AS text FROM placed WHERE opens IS NULL AND trim(line) <> '' GROUP BY ALL""")
def section_runs(spark, sf):
    """Documents as pages of three, each under a heading."""
    heads = F.element_at(F.array(*map(F.lit, _HEADINGS)), (F.col("chunk_id") % 9 + 1).cast("int"))
    pages = v.corpus(spark, sf).select(F.floor(F.col("chunk_id") / 3).alias("document_id"), (F.col("chunk_id") % 3).alias("page_number"), F.concat(heads, F.lit("\n"), "text").alias("text"))
    return dc.section_runs(pages)


@query()
def reference_score(spark, sf):
    """Documents with made-up entries put behind: every third document becomes a reference list."""
    entry = F.concat(F.lit(" ["), F.col("chunk_id").cast("string"), F.lit("] A. Miller, vol. 3, 12(3): 45, 1999. B. Jones, pp. 4, 2004."))
    text = F.when(F.col("chunk_id") % 3 == 0, F.concat("text", F.repeat(entry, 4))).otherwise(F.col("text"))
    score = dc.reference_score(text)
    return v.corpus(spark, sf).select("chunk_id", F.round(score, 6).alias("score"), (score >= 1).alias("is_references"))


@query(f"""WITH p AS (SELECT vec_id // 50 AS document_id, vec_id % 50 AS pos, embedding::DOUBLE[] AS e, lead(embedding::DOUBLE[]) OVER (PARTITION BY vec_id // 50 ORDER BY vec_id % 50) AS n FROM embeddings),
d AS (SELECT document_id, pos, round(1 - list_dot_product(e, n) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(n, n)) + 1e-8), 6) AS distance FROM p),
t AS (SELECT document_id, round(quantile_cont(distance, 0.8), 6) AS threshold FROM d GROUP BY 1) SELECT document_id, pos, distance, threshold, distance > threshold AS ends FROM d JOIN t USING (document_id)""")
def topic_breaks(spark, sf):
    rows = v.vectors(spark, sf).select(F.floor(F.col("chunk_id") / 50).alias("document_id"), (F.col("chunk_id") % 50).alias("pos"), "embedding")
    return dc.topic_breaks(rows)


_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: array_to_string({0}[i : i + 4], ' ')))"


@query(f"""WITH {v.CORPUS}, {'questions AS (SELECT item_id, ' + v.TOKENS.format('text') + ' AS t FROM benchmark)'}, q AS (SELECT item_id, unnest(g) AS gram, len(g) AS n FROM (SELECT item_id, {_GRAMS.format('t')} AS g FROM questions)),
d AS (SELECT chunk_id, unnest({_GRAMS.format('t')}) AS gram FROM (SELECT chunk_id, {v.TOKENS.format('text')} AS t FROM corpus))
SELECT item_id, chunk_id AS doc_id, count(*) AS shared, round(count(*) / any_value(n), 6) AS containment FROM q JOIN d USING (gram) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.8""")
def ngram_copy(spark, sf):
    """Passages whose 5-grams a document has, at 0.8 or more."""
    got = bags.runs_shared(v.corpus(spark, sf).select("chunk_id", "text"), v.questions(spark, sf), 5)
    return got.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"), "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment")).filter(F.col("shared") / F.col("n") >= 0.8)


_BAG_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}\p{{M}}_]+')"


@query(f"""WITH lt AS (SELECT item_id AS left_id, {_BAG_TOKENS.format('text')} AS w FROM benchmark), rt AS (SELECT doc_id AS right_id, {_BAG_TOKENS.format('text')} AS w FROM documents),
lb AS (SELECT left_id, t, any_value(n) AS n, count(*) AS c FROM (SELECT left_id, len(w) AS n, unnest(w) AS t FROM lt) GROUP BY 1, 2), rb AS (SELECT right_id, t, any_value(m) AS m, count(*) AS d FROM (SELECT right_id, len(w) AS m, unnest(w) AS t FROM rt) GROUP BY 1, 2),
i AS (SELECT left_id, right_id, sum(least(c, d)) AS i, any_value(n) AS n, any_value(m) AS m FROM lb JOIN rb USING (t) GROUP BY 1, 2)
SELECT left_id, right_id, round(i / least(n, m), 6) AS containment, round(i / (n + m - i), 6) AS jaccard FROM i WHERE i / least(n, m) >= 0.8""")
def bag_overlap(spark, sf):
    """Passages and documents of which one's words are in the other, at 0.8 or more, in any order."""
    docs = v.corpus(spark, sf).select(F.col("chunk_id").alias("right_id"), "text")
    found = bags.contained(v.questions(spark, sf).select(F.col("query_id").alias("left_id"), "text"), docs)
    return found.select("left_id", "right_id", F.round("containment", 6).alias("containment"), F.round("jaccard", 6).alias("jaccard"))


#: Words in a chunk of the old and of the new edition of every document, and on a page.
_OLD, _NEW, _PAGE = 40, 30, 200


def _edition(docs, size: int):
    """Texts cut into chunks of so many words: (doc_id, i, text)."""
    cut = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w")).filter("size(w) > 0")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / size).cast("int")), lambda i: F.array_join(F.slice("w", i * size + 1, size), " "))
    return cut.select("doc_id", F.posexplode(parts).alias("i", "text"))


_CHUNKS = """SELECT doc_id, i, array_to_string(w[i * {0} + 1 : i * {0} + {0}], ' ') AS text FROM (SELECT doc_id, w, unnest(range((len(w) - 1) // {0} + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents) WHERE len(w) > 0)"""


@query(f"""WITH old0 AS ({_CHUNKS.format(_OLD)}), new0 AS ({_CHUNKS.format(_NEW)}),
old AS (SELECT doc_id * 100000 + i AS chunk_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE i * {_OLD} // {_PAGE} END AS page, {_BAG_TOKENS.format('text')} AS a FROM old0),
new AS (SELECT doc_id * 100000 + i AS chunk_id, CASE WHEN doc_id % 11 = 10 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN i * {_NEW} // {_PAGE} + 1000 ELSE i * {_NEW} // {_PAGE} END AS page, {_BAG_TOKENS.format('text')} AS b FROM new0),
items AS (SELECT doc_id AS item_id, doc_id, CASE WHEN doc_id % 13 = 12 THEN -1 - doc_id ELSE max(chunk_id) - count(*) // 2 END AS chunk_id FROM old GROUP BY doc_id),
asked AS (SELECT item_id, i.doc_id, page, a, EXISTS (SELECT 1 FROM new n WHERE n.doc_id = i.doc_id AND n.page IS NOT DISTINCT FROM old.page) AS own FROM items i JOIN old ON old.chunk_id = i.chunk_id),
met AS (SELECT item_id, new.chunk_id, a, b FROM asked JOIN new ON new.doc_id = asked.doc_id AND (NOT own OR new.page IS NOT DISTINCT FROM asked.page)),
ca AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(a) AS t FROM asked) GROUP BY 1, 2), cb AS (SELECT chunk_id, t, count(*) AS d FROM (SELECT chunk_id, unnest(b) AS t FROM new) GROUP BY 1, 2),
common AS (SELECT item_id, chunk_id, sum(least(c, d)) AS k FROM (SELECT item_id, chunk_id FROM met) JOIN ca USING (item_id) JOIN cb USING (chunk_id, t) GROUP BY 1, 2),
scored AS (SELECT item_id, chunk_id, coalesce(k / nullif(least(len(a), len(b)), 0), 0) AS c, coalesce(k / nullif(len(a) + len(b) - k, 0), 0) AS j FROM (SELECT met.*, coalesce(k, 0) AS k FROM met LEFT JOIN common USING (item_id, chunk_id))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, j DESC, chunk_id) AS place FROM scored),
found AS (SELECT item_id, max(CASE WHEN place = 1 THEN chunk_id END) AS best, max(c) AS c, string_agg(chunk_id, ',' ORDER BY place) FILTER (WHERE c >= 0.8 OR place = 1) AS ids FROM ranked GROUP BY 1)
SELECT item_id, items.chunk_id AS chunk_id_old, coalesce(best, items.chunk_id) AS chunk_id, coalesce(ids, '') AS chunk_ids, coalesce(round(c, 4), -1) AS remap_overlap, CASE WHEN c IS NULL THEN 'failed' WHEN c >= 0.8 THEN 'confident' ELSE 'ambiguous' END AS status FROM items LEFT JOIN found USING (item_id)""")
def containment_remap(spark, sf):
    """A label on the middle chunk of each document, moved to a new edition that is cut and numbered otherwise."""
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    doc, at = F.col("doc_id"), lambda size: F.floor(F.col("i") * size / _PAGE)
    old = storage.written(_edition(docs, _OLD).select("doc_id", (doc * 100000 + F.col("i")).alias("chunk_id"), F.when(doc % 7 != 0, at(_OLD)).alias("page_number"), "text"))
    page = F.when(doc % 7 == 0, None).when(doc % 3 == 0, at(_NEW) + 1000).otherwise(at(_NEW))
    name = F.when(doc % 11 == 10, -1 - doc).otherwise(doc)  # a document that the new edition has under another name
    new = storage.written(_edition(docs, _NEW).select((doc * 100000 + F.col("i")).alias("chunk_id"), name.alias("document_id"), page.alias("page_number"), "text"))
    middle = F.max("chunk_id") - F.floor(F.count("*") / 2)
    items = old.groupBy("doc_id").agg(middle.alias("middle")).select(doc.alias("item_id"), doc.alias("document_id"), F.when(doc % 13 == 12, -1 - doc).otherwise(F.col("middle")).alias("chunk_id"))
    got = bags.remapped(items, old, new)
    return got.withColumn("chunk_ids", F.array_join(F.col("chunk_ids").cast("array<string>"), ",")).withColumn("remap_overlap", F.coalesce("remap_overlap", F.lit(-1.0)))


@query()
def answer_filter(spark, sf):
    rows = scoring._answers(spark, sf)
    got = an.checked(rows.select("conv_id", "turn", an.normalized(F.col("answer")).alias("answer"), "evidence"))
    return got.select("conv_id", "turn", F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason"))


@query()
def rejection_reasons(spark, sf):
    return answer_filter(spark, sf).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def abstentions(spark, sf):
    rows = scoring._answers(spark, sf)
    return rows.select("conv_id", "turn", cl.is_abstention(F.col("answer")).alias("abstains"), cl.has_substance(F.col("answer")).alias("substance"), F.length(cl.without_scaffold(F.col("answer"))).alias("chars"))


_SHARES = {"en": 0.5, "fr": 0.25, "de": 0.15, "es": 0.1}


@query(f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {v.DRAW.format("'7|' || doc_id::VARCHAR")}, doc_id) AS place FROM documents)
SELECT doc_id, lang, place FROM d WHERE place <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 25 WHEN 'de' THEN 15 WHEN 'es' THEN 10 ELSE 0 END""")
def stratified_sample(spark, sf):
    return sa.stratified(v.corpus(spark, sf).select(F.col("chunk_id").alias("doc_id"), "lang"), "lang", "doc_id", _SHARES, 100)


@query("SELECT *, row_number() OVER (ORDER BY turn, source) - 1 AS place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)")
def round_robin(spark, sf):
    return sa.round_robin(v.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query(f"""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {v.DRAW.format("'42|' || doc_id::VARCHAR")}, doc_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents))
SELECT doc_id, CASE WHEN place <= round_even(n * 0.1, 0) THEN 'val' WHEN place <= 2 * round_even(n * 0.1, 0) THEN 'test' ELSE 'train' END AS split FROM p""")
def paper_split(spark, sf):
    return sa.split_papers(v.table(spark, sf, "documents"), "doc_id")


@query(f"""WITH p AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY {v.DRAW.format("'42|' || doc_id::VARCHAR")}, doc_id) - 1) // 4 AS group_no FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY source, group_no) AS group_size FROM p) SELECT doc_id, source, group_no, group_size FROM g WHERE group_size >= 3 AND group_no < 10""")
def group_pools(spark, sf):
    return sa.groups_of(v.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 4, 3, 10)


@query()
def pair_pools(spark, sf):
    return sa.pairs_of(v.table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 30)


@query("""WITH p AS (SELECT lang AS task, count(*) AS pool, CASE lang WHEN 'en' THEN 0.3::DOUBLE WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.15 ELSE 0.1 END AS ratio FROM documents GROUP BY 1)
SELECT task, pool, ratio, least(pool, round_even((SELECT min(pool / ratio) FROM p) * ratio, 0))::BIGINT AS count FROM p""")
def allocate(spark, sf):
    pools = v.corpus(spark, sf).groupBy(F.col("lang").alias("task")).agg(F.count("*").alias("pool"))
    ratio = F.when(F.col("task") == "en", 0.3).when(F.col("task") == "fr", 0.2).when(F.col("task") == "de", 0.15).otherwise(0.1)
    return sa.allocated(pools.withColumn("ratio", ratio))


@query("""WITH t AS (SELECT doc_id, source AS title, lang AS status, n_chars AS uploaded_at FROM documents WHERE doc_id % 3 <> 0),
c AS (SELECT doc_id, 'new ' || source AS title, 'indexed' AS status, 0::BIGINT AS uploaded_at FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, coalesce(c.title, t.title) AS title, coalesce(c.status, t.status) AS status, coalesce(t.uploaded_at, c.uploaded_at) AS uploaded_at FROM t FULL JOIN c USING (doc_id)""")
def catalog_upsert(spark, sf):
    docs = v.table(spark, sf, "documents")
    old = docs.filter("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("status"), F.col("n_chars").alias("uploaded_at"))
    new = docs.filter("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("new "), "source").alias("title"), F.lit("indexed").alias("status"), F.lit(0).cast("long").alias("uploaded_at"))
    return ca.upsert(old, new, "doc_id", keep=("uploaded_at",))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS documents, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS labels")
def cascade_delete(spark, sf):
    docs, labels = v.table(spark, sf, "documents"), v.table(spark, sf, "labels")
    left = ca.cascade({"documents": docs, "labels": labels}, labels.filter("toxic = 1").select("doc_id").distinct(), "doc_id")
    return left["documents"].agg(F.count("*").alias("documents")).crossJoin(F.broadcast(left["labels"].agg(F.count("*").alias("labels"))))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, sf):
    return ca.remaining(v.table(spark, sf, "documents").select("doc_id", "lang"), v.table(spark, sf, "labels"), "doc_id")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_record(spark, sf):
    rows = v.table(spark, sf, "events").select("user_id", "ts", "event_type", F.struct("ts", "event_id").alias("o"))
    return ca.latest(rows, "user_id", "o").drop("o")


def _grids(spark, sf):
    """A grid for each region: its nations with their keys."""
    nations = v.table(spark, sf, "nation")
    row = F.struct("n_nationkey", F.array("n_name", F.col("n_nationkey").cast("string"), (F.col("n_nationkey") * 7).cast("string")).alias("r"))
    grids = nations.groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("body"))
    return grids.select("n_regionkey", F.concat(F.array(F.array(*map(F.lit, ("name", "k|ey", "seven")))), "body").alias("grid"))


@query(r"""SELECT n_regionkey::BIGINT AS n_regionkey, '| name | k\|ey | seven |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | ' || n_nationkey * 7 || ' |', chr(10) ORDER BY n_nationkey) AS markdown, (count(*) + 1) AS n_rows FROM nation GROUP BY 1""")
def table_markdown(spark, sf):
    md = dc.grid_to_markdown(F.col("grid"))
    return _grids(spark, sf).select("n_regionkey", md.alias("markdown"), F.size(dc.markdown_to_grid(md)).alias("n_rows"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey, (n_nationkey * 7)::VARCHAR AS cell, true AS tabular FROM nation")
def table_cell(spark, sf):
    nations = v.table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name")
    got = nations.join(_grids(spark, sf), "n_regionkey")
    return got.select("n_nationkey", "n_regionkey", dc.table_cell(F.col("grid"), F.col("n_name"), F.lit("seven")).alias("cell"), dc.looks_tabular(F.col("grid"), F.lit(True)).alias("tabular"))


@query(r"""SELECT doc_id, substr(sha1(text), 1, 8) || '_' || regexp_replace(regexp_replace(lower(source || ' (' || lang || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS document_id,
coalesce(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: trim(x)), lambda x: x <> '')[1], 'Untitled') AS title FROM documents WHERE text IS NOT NULL""")
def document_keys(spark, sf):
    docs = v.table(spark, sf, "documents").filter("text is not null")
    return docs.select("doc_id", dc.document_key(F.col("text"), F.concat("source", F.lit(" ("), "lang", F.lit(")"))).alias("document_id"), dc.title_of(F.col("text")).alias("title"))


def _checks() -> dict:
    """What must not be in any graded claim or answer, by name."""
    c, size = F.col, F.size
    return {
        "score_in_range": (c("grounding_score") < 0) | (c("grounding_score") > 1),
        "overlap_in_range": (c("overlap") < 0) | (c("overlap") > 1),
        "block_overlap_in_range": (c("min_cite_overlap") < 0) | (c("min_cite_overlap") > 1),
        "score_null": c("grounding_score").isNull(),
        "overlap_null": c("overlap").isNull(),
        "label_known": ~c("grounding").isin("none", "weak", "strong"),
        "uncited_is_none": (size("cited") == 0) & (c("grounding") != "none"),
        "uncited_scores_nothing": (size("cited") == 0) & (c("grounding_score") != 0),
        "missing_is_none": (size("missing") > 0) & (c("grounding") != "none"),
        "missing_is_capped": (size("missing") > 0) & (c("grounding_score") > 0.3),
        "strong_has_overlap": (c("grounding") == "strong") & (c("overlap") < cl.STRONG),
        "weak_has_overlap": (c("grounding") == "weak") & (c("overlap") < cl.WEAK),
        "strong_is_in_context": (c("grounding") == "strong") & ~c("context_ok"),
        "strong_uses_each_block": (c("grounding") == "strong") & (c("min_cite_overlap") < cl.LEAST_BLOCK),
        "none_without_overlap": (c("grounding") == "none") & (c("overlap") >= cl.STRONG) & (size("missing") == 0) & (size("cited") > 0) & c("context_ok") & (c("min_cite_overlap") >= cl.LEAST_BLOCK),
        "ids_positive": F.exists("ids", lambda i: i < 1),
        "ids_distinct": size(F.array_distinct("ids")) != size("ids"),
        "no_more_blocks_than_ids": size("cited") > size("ids"),
        "blocks_have_text": F.exists("cited", lambda b: b.isNull()),
        "text_there": F.trim("text") == "",
        "context_known": c("context_ok").isNull(),
        "missing_known": c("missing").isNull(),
        "missing_are_numbers": F.exists("missing", lambda n: ~n.rlike(r"^\d+(\.\d+)?$")),
        "missing_are_said": F.exists("missing", lambda n: ~c("text").contains(n)),
        "missing_are_missing": F.exists("missing", lambda n: F.array_join("cited", " ").contains(n)),
        "position_there": c("pos").isNull() | (c("pos") < 0),
    }


_CHECKS = """score_in_range overlap_in_range block_overlap_in_range score_null overlap_null label_known uncited_is_none uncited_scores_nothing missing_is_none missing_is_capped strong_has_overlap weak_has_overlap strong_is_in_context strong_uses_each_block none_without_overlap ids_positive ids_distinct no_more_blocks_than_ids blocks_have_text text_there context_known missing_known missing_are_numbers missing_are_said missing_are_missing position_there""".split()


@query(f"WITH {v.CLAIMS}, n AS (SELECT count(*) AS rows FROM claims) SELECT rows, unnest({_CHECKS}) AS \"check\", 0::BIGINT AS broken FROM n")
def response_invariants(spark, sf):
    """Checks on the engine's own output, and how many rows break each: none should."""
    graded = cl.grounded(scoring._cited_rows(spark, sf))
    checks = _checks()
    assert list(checks) == _CHECKS
    broken = graded.agg(F.count("*").alias("rows"), *(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in checks.items()))
    return broken.select("rows", F.expr("stack({}, {}) as (check, broken)".format(len(checks), ", ".join(f"'{n}', {n}" for n in checks))))


def _responses(spark, sf):
    """An answer for each conversation, made so that it breaks no rule: a block for each of its first turns, a claim for
    each block and one that cites nothing."""
    said = v.turns(spark, sf).filter("turn < 4").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    rows = said.select("conv_id", F.transform("t", lambda x: F.concat(F.lit("Turn "), x["turn"].cast("string"), F.lit(": "), x["text"])).alias("t")).withColumn("high", F.col("conv_id") % 2 == 1)
    block = lambda x, i: F.struct((i + 1).alias("citation_id"), F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("document_id"), F.lit(1).alias("page_number"), x.alias("text"), F.lit("text").alias("chunk_type"), F.lit(None).cast("string").alias("image_url"))
    status = F.when(F.col("high"), "SUPPORTED").otherwise("NOT_VERIFIED")
    claim = lambda i, ids, grounding: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("claim_id"), F.lit("A claim.").alias("text"), status.alias("status"), F.lit(grounding).alias("grounding"), ids.alias("citation_ids"))
    rows = rows.select("conv_id", "high", F.transform("t", block).alias("evidence"), F.concat(F.transform("t", lambda x, i: claim(i, F.array(i + 1), "strong")), F.array(claim(F.lit(-1), F.array().cast("array<int>"), "none"))).alias("claims"))
    n, m = F.size("claims"), F.size("evidence")
    measured = F.when(F.col("high"), 1.0)
    metrics = F.struct(n.alias("total_claims"), m.alias("total_citations"), F.lit(1).alias("flagged_claims"), F.when(F.col("high"), n).otherwise(0).alias("verified_claims"), (m / n).alias("citation_coverage"), measured.alias("citation_precision"), measured.alias("faithfulness"), (measured - 1).alias("unsupported_claim_rate"))
    latency = F.struct(F.lit(1.0).alias("retrieval"), F.lit(5.0).alias("generation"), F.when(F.col("high"), 3.0).otherwise(0.0).alias("verification"), F.lit(9.0).alias("total"))
    mode = F.when(F.col("high"), "high_faithfulness").otherwise("balanced")
    documents = F.array(F.concat(F.lit("d"), F.col("conv_id").cast("string")))
    return rows.select(F.col("conv_id").alias("query_id"), F.lit("An answer [1].").alias("answer"), mode.alias("mode"), mode.alias("asked_mode"), documents.alias("asked_documents"), m.alias("num_sources"), "evidence", "claims", metrics.alias("metrics"), latency.alias("latency"))


def _first(name: str, **fields):
    """The array with some fields of its first item set otherwise."""
    return F.transform(name, lambda x, i: F.when(i == 0, _set(x, fields)).otherwise(x))


def _set(x, fields: dict):
    for k, value in fields.items():
        x = x.withField(k, value)
    return x


#: What can be wrong with an answer: the column, its faulty value, and the rules that it then breaks.
_FAULTS = [
    ("answer", lambda: F.lit("  "), ["answer_empty"]),
    ("answer", lambda: F.lit("So. The following statements from that answer are"), ["answer_echoes_prompt"]),
    ("evidence", lambda: F.slice("evidence", 1, 0), ["evidence_missing", "num_sources", "claim_cites_unknown"]),
    ("evidence", lambda: _first("evidence", citation_id=F.lit(7)), ["evidence_numbering", "claim_cites_unknown"]),
    ("num_sources", lambda: F.col("num_sources") + 1, ["num_sources"]),
    ("evidence", lambda: _first("evidence", page_number=F.lit(0)), ["evidence_incomplete"]),
    ("evidence", lambda: _first("evidence", chunk_type=F.lit("sound")), ["evidence_kind"]),
    ("evidence", lambda: _first("evidence", image_url=F.lit("x.png")), ["image_without_figure"]),
    ("evidence", lambda: _first("evidence", document_id=F.lit("other")), ["evidence_outside_filter"]),
    ("claims", lambda: _first("claims", claim_id=F.lit("c-1")), ["claim_id_twice"]),
    ("claims", lambda: _first("claims", status=F.when(F.col("mode") == "balanced", F.lit("NOT_VERIFIED")).otherwise(F.lit("ODD"))), ["claim_status"]),
    ("claims", lambda: _first("claims", citation_ids=F.array(F.lit(99))), ["claim_cites_unknown"]),
    ("claims", lambda: _first("claims", text=F.lit("")), ["claim_empty"]),
    ("claims", lambda: _first("claims", grounding=F.lit("solid")), ["claim_grounding"]),
    ("claims", lambda: F.transform("claims", lambda x: x.withField("grounding", F.lit("weak"))), ["uncited_but_grounded", "flagged_claims"]),
    ("metrics", lambda: F.col("metrics").withField("flagged_claims", F.lit(5)), ["flagged_claims"]),
    ("metrics", lambda: F.col("metrics").withField("verified_claims", F.lit(-1)), ["verified_claims"]),
    ("metrics", lambda: F.col("metrics").withField("citation_coverage", F.lit(1.5)), ["coverage_range", "coverage_recomputed"]),
    ("metrics", lambda: F.col("metrics").withField("faithfulness", F.lit(1.2)), ["unmeasured_but_reported|metric_range"]),
    ("metrics", lambda: F.col("metrics").withField("total_claims", F.lit(0)), ["total_claims"]),
    ("metrics", lambda: F.col("metrics").withField("total_citations", F.lit(None)), ["total_citations"]),
    ("metrics", lambda: F.col("metrics").withField("citation_coverage", F.lit(0.01)), ["coverage_recomputed"]),
    ("latency", lambda: F.col("latency").withField("retrieval", F.lit(-1.0)), ["latency_negative"]),
    ("latency", lambda: F.col("latency").withField("total", F.lit(2.0)), ["latency_total"]),
    ("mode", lambda: F.lit("odd"), ["mode_echo"]),
    ("latency", lambda: F.col("latency").withField("verification", F.when(F.col("mode") == "balanced", 2.0).otherwise(0.0)), ["verification_timed_without_being_asked|verification_untimed"]),
    ("claims", lambda: F.transform("claims", lambda x: x.withField("status", F.when(F.col("mode") == "balanced", "SUPPORTED").otherwise("NOT_VERIFIED"))), ["verified_claims", "metric_range|unmeasured_but_reported", "verified_without_being_asked|claims_left_unverified"]),
]
_EVERY = len(_FAULTS) + 3


def _told(high: bool) -> str:
    """What each fault is told as, in SQL: of two names the first is for answers that aren't verified."""
    names = [";".join(r.split("|")[-1 if high else 0] for r in rules) for _, _, rules in _FAULTS]
    if not high:
        names[10] = ""  # its status is changed to what it was
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


@query(f"""WITH r AS (SELECT DISTINCT conv_id FROM conversations WHERE turn < 4)
SELECT conv_id AS query_id, CASE WHEN conv_id % {_EVERY} >= {len(_FAULTS)} THEN '' WHEN conv_id % 2 = 1 THEN ({_told(True)})[conv_id % {_EVERY} + 1] ELSE ({_told(False)})[conv_id % {_EVERY} + 1] END AS problems FROM r""")
def response_problems(spark, sf):
    """Answers into which faults are put, and the rules that each is found to break."""
    rows, fault = _responses(spark, sf), F.col("query_id") % _EVERY
    for column in ("answer", "evidence", "num_sources", "claims", "metrics", "latency"):
        value = F.col(column)
        for i, (name, bad, _) in enumerate(_FAULTS):
            if name == column:
                value = F.when(fault == i, bad()).otherwise(value)
        rows = rows.withColumn(column, value)
    mode = next(i for i, f in enumerate(_FAULTS) if f[0] == "mode")
    rows = rows.withColumn("mode", F.when(fault == mode, "odd").otherwise(F.col("mode")))
    return iv.with_problems(rows).select("query_id", F.array_join("problems", ";").alias("problems"))
