"""From ranked evidence to a checked answer: prompts, plug-in models, verification and the gates on second tries.

A model is a plug-in: a function on Columns, so that it may be an expression, a pandas UDF or a table that was made
before. The defaults here are deterministic and need no model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import claims as cl
from docquarry.operators import retrieval as rt

# Embedding and reranking ----------------------------------------------------------------------------------------------

#: Dimensions of the default embedding.
DIMENSION = 64


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """The default encoder: each distinct token adds one, signed by its hash, to the place its hash names; the vector
    has length one (all zeros without a token)."""
    tokens = F.array_distinct(tx.tokens(text))
    spots = F.transform(tokens, lambda t: F.struct(F.pmod(F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("long"), F.lit(dimension)).alias("at"), F.when(F.substring(F.md5(t), 7, 1).isin(*"01234567"), 1.0).otherwise(-1.0).alias("by")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(spots, F.lit(0.0), lambda s, x: s + F.when(x["at"] == i, x["by"]).otherwise(0.0)))
    return unit(raw)


def unit(vector: Column) -> Column:
    """A vector of length one; zeros stay zeros."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def embedded(rows: DataFrame, encode: Callable[[Column], Column] = hashed_embedding) -> DataFrame:
    """rows (text) with `embedding`, of length one and in single precision."""
    return rows.withColumn("embedding", F.transform(encode(F.col("text")), lambda x: x.cast("float")))


def lexical_scorer(query: Column, text: Column) -> Column:
    """The default reranker: the share of the query's distinct tokens that the text has."""
    return tx.overlap(F.array_distinct(tx.tokens(query)), tx.tokens(text))


def reranked(candidates: DataFrame, k: int, score: Callable[[Column, Column], Column] | None = lexical_scorer) -> DataFrame:
    """candidates (query_id, query, chunk_id, text, rank) scored anew and cut at k; ties by the rank they had. Without a
    scorer they stay as they are. A scorer's failing batch is run again by Spark, as any task."""
    if score is None:
        return candidates
    rows = candidates.withColumn("before", F.col("rank")).withColumn("score", F.round(score(F.col("query"), F.col("text")), 6)).drop("rank")
    return rt.top(rows, k, F.desc("score"), F.asc("before"), F.asc("chunk_id")).drop("before")


@dataclass(frozen=True)
class Retrieval:
    """What the modes take: sizes of the lists, the constant of fusion, and how many go on."""

    fast: int = 5
    dense: int = 20
    lexical: int = 20
    rrf: int = 60
    final: int = 20
    rerank: int = 8


def retrieved(mode: str, dense: Callable[[int], DataFrame], lexical: Callable[[int], DataFrame], settings: Retrieval = Retrieval()) -> DataFrame:
    """Ranked rows of a mode: `fast` is the first of the dense list; any other fuses the dense and the lexical list.
    dense and lexical: k -> ranked rows."""
    if mode == "fast":
        return dense(settings.fast)
    return rt.fuse([(dense(settings.dense), 1.0), (lexical(settings.lexical), 1.0)], settings.final, settings.rrf)


def arms(lists: dict[str, DataFrame], depth: int = 10) -> DataFrame:
    """The ranked lists of several strategies, each to the same depth, with the column `arm`."""
    out = None
    for name, ranked in lists.items():
        part = ranked.filter(F.col("rank") <= depth).select(F.lit(name).alias("arm"), "query_id", "chunk_id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


# Evidence and prompts -------------------------------------------------------------------------------------------------


def evidence_text(evidence: DataFrame, *by: str) -> DataFrame:
    """One text of numbered blocks by group: a head line with the paper, page and section, then the text; blocks in
    order of citation_id, a blank line between them."""
    head = F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] Paper: "), F.col("document_title"), F.lit(" | Page: "), F.col("page_number").cast("string"), F.lit(" | Section: "), F.col("section"))
    block = F.struct("citation_id", F.concat(head, F.lit("\n"), F.col("text")).alias("b"))
    return evidence.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("evidence_text"))


def context_text(evidence: DataFrame, *by: str) -> DataFrame:
    """`[n] text` blocks of each group, a blank line between them."""
    block = F.struct("citation_id", F.concat(F.lit("["), F.col("citation_id").cast("string"), F.lit("] "), F.col("text")).alias("b"))
    return evidence.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]), "\n\n").alias("context"))


def evidence_of(context: Column) -> Column:
    """The numbered blocks of a context, as a map from number to text."""
    blocks = F.filter(F.split(context, r"\n\n(?=\[\d+\] )"), lambda b: b.rlike(r"^\[\d+\] "))
    return F.map_from_entries(F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"^\[(\d+)\] ", 1).cast("int"), F.regexp_replace(b, r"^\[\d+\] ", ""))))


#: What a task asks, before the evidence, and the word that the answer is to follow. {0} is the question or aspect.
TASKS = {
    "summarize": ("Summarise what the evidence finds: objective, methods and results, as far as it has them. Cite every fact.", "SUMMARY"),
    "compare": ("Compare the papers in the evidence with respect to: {0}. First what each reports, cited by itself, then where they agree and differ.", "COMPARISON"),
    "literature_review": ("Write a part of a literature review about: {0}. One to three short paragraphs, fully cited.", "SUBSECTION"),
    "research_gaps": ("Name the open questions that the evidence implies, and cite what implies each. If it is too thin for that, say so.", "RESEARCH GAPS"),
    "conflict_detection": ("Name findings in the evidence that conflict, what each source reports, and what could explain it. If there are none, say so.", "CONFLICTS"),
    "qa": ("QUESTION: {0}", "ANSWER"),
    "verify": ("CLAIM: {0}\n\nSay SUPPORTED, PARTIALLY_SUPPORTED, UNSUPPORTED or CONTRADICTED after `STATUS:`, and why after `RATIONALE:`.", "VERDICT"),
}
#: Which task and which wording of the question a kind of query has.
ROUTES = {
    "summarize": ("summarize", "{0}"),
    "compare_papers": ("compare", "overall approach and findings"),
    "compare_methodology": ("compare", "methodology"),
    "compare_results": ("compare", "results and findings"),
    "research_gaps": ("research_gaps", "{0}"),
    "conflict_detection": ("conflict_detection", "{0}"),
    "literature_review": ("literature_review", "{0}"),
    "limitations": ("qa", "What are the limitations of the studies or methods, in relation to: {0}"),
    "structured_table": ("qa", "{0}\n\n(Answer with a Markdown table.)"),
}


def _filled(template: str, question: Column) -> Column:
    before, hole, after = template.partition("{0}")
    return F.concat(F.lit(before), question, F.lit(after)) if hole else F.lit(before)


def task_of(query_type: Column) -> Column:
    """The task that a kind of query is routed to; unknown kinds are questions."""
    out = F.lit("qa")
    for kind, (task, _) in ROUTES.items():
        out = F.when(query_type == kind, task).otherwise(out)
    return out


def prompt(query_type: Column, question: Column, evidence_text: Column) -> Column:
    """The prompt of a query: its task's wording, the evidence, and the word that the answer follows."""
    out = None
    for kind in [None, *ROUTES]:
        task, wording = ROUTES.get(kind, ("qa", "{0}"))
        ask, lead = TASKS[task]
        text = F.concat(_filled(ask, _filled(wording, question)), F.lit("\n\nEVIDENCE:\n"), evidence_text, F.lit(f"\n\n{lead}:"))
        out = text if out is None else F.when(query_type == kind, text).otherwise(out)
    return out


def verification_prompt(claim: Column, evidence_text: Column) -> Column:
    return F.concat(_filled(TASKS["verify"][0], claim), F.lit("\n\nEVIDENCE:\n"), evidence_text)


def retry_prompt(user_prompt: Column, answer: Column, fault: Column) -> Column:
    """The prompt again, with the answer it got and what is wrong with it."""
    return F.concat(user_prompt, F.lit("\n\n---\nYour previous answer was:\n"), answer, F.lit("\n\n"), fault, F.lit(" Output only the revised answer."))


def citation_fault() -> Column:
    return F.lit("It cites nothing. End every sentence that states a fact with the [n] of the block that supports it, and add nothing.")


def unsupported_fault(statements: Column) -> Column:
    return F.concat(F.lit("These statements could not be verified against the evidence:\n"), F.array_join(F.transform(statements, lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("\nRemove or correct them and keep the rest."))


def value_fault(numbers: Column) -> Column:
    return F.concat(F.lit("The numbers "), F.array_join(F.array_sort(F.array_distinct(numbers)), ", "), F.lit(" are not in the blocks that are cited for them. Give each value as its block states it."))


def fitted(evidence: DataFrame, tokens: str, budget: int, choices: tuple[int, ...] = (5, 4, 3), extra: int = 25) -> DataFrame:
    """Evidence rows (query_id, citation_id, and their tokens) cut to the largest number in `choices` whose first blocks
    fit the budget with `extra` tokens besides; queries that have too few blocks, or that none fits, go."""
    order = Window.partitionBy("query_id").orderBy("citation_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = evidence.withColumn("__sum", F.sum(tokens).over(order) + extra)
    fits = sums.filter(F.col("citation_id").isin(*choices) & (F.col("__sum") <= budget)).groupBy("query_id").agg(F.max("citation_id").alias("__k"))
    return sums.join(fits, "query_id").filter(F.col("citation_id") <= F.col("__k")).drop("__k", "__sum")


# Answers --------------------------------------------------------------------------------------------------------------


def extractive(question: Column, evidence: Column) -> Column:
    """The default generator: of the evidence (a map from number to text) the first sentence that shares most words with
    the question, cited; without evidence an abstention."""
    words = tx.grounding_words(question)
    blocks = F.map_entries(evidence)
    each = F.flatten(F.transform(blocks, lambda b: F.transform(tx.sentences(b["value"]), lambda s, i: F.struct(F.size(F.array_intersect(words, tx.grounding_words(s))).alias("n"), (-b["key"]).alias("k"), (-i).alias("i"), s.alias("s")))))
    best = F.array_max(each)
    return F.when(F.size(each) > 0, F.concat(F.regexp_replace(best["s"], r"[.!?]+$", ""), F.lit(" ["), (-best["k"]).cast("string"), F.lit("]."))).otherwise("There is insufficient evidence to answer.")


def has_valid_citation(answer: Column, evidence_ids: Column) -> Column:
    return F.arrays_overlap(tx.citation_ids(answer), evidence_ids)


def cited_fraction(claims: Column) -> Column:
    """Of claims (array of structs with citation_ids) the share that cites; 0 without claims."""
    return F.coalesce(F.try_divide(F.size(F.filter(claims, lambda c: F.size(c["citation_ids"]) > 0)), F.size(claims)), F.lit(0.0))


def unsupported_rate(claims: Column, unsupported: Column) -> Column:
    """Unsupported ones among the claims; 1 without claims."""
    return F.coalesce(F.try_divide(F.size(unsupported), F.size(claims)), F.lit(1.0))


def missing_numbers(claim: Column, blocks: Column) -> Column:
    """Numbers of a claim that none of its cited blocks has; none if it cites no block or has no content word."""
    bare = tx.without_markers(claim)
    joined = F.array_join(blocks, " ")
    found = F.filter(tx.all_of(bare, tx.NUMBER), lambda n: ~joined.contains(n))
    return F.when((F.size(blocks) > 0) & (F.size(tx.grounding_words(bare)) > 0), found).otherwise(F.array().cast("array<string>"))


def unverified_numbers(claims: Column, evidence: Column) -> Column:
    """Of all claims (structs with text and citation_ids) the numbers that their cited evidence (a map) lacks, in order."""
    blocks = lambda c: F.filter(F.transform(c["citation_ids"], lambda i: F.try_element_at(evidence, i)), lambda b: b.isNotNull())
    return F.flatten(F.transform(claims, lambda c: missing_numbers(c["text"], blocks(c))))


NO_ANSWER = "The retrieved evidence does not state the answer to this question."


def with_substance(answer: Column, *retries: Column) -> Column:
    """The answer, or the first retry that says something; if none does, that there is no answer."""
    out = F.lit(NO_ANSWER)
    for one in reversed((answer, *retries)):
        out = F.when(F.coalesce(cl.has_substance(one), F.lit(False)), one).otherwise(out)
    return out


def with_citations(answer: Column, revised: Column, evidence_ids: Column) -> Column:
    """The revised answer where the answer has evidence but cites none, doesn't abstain, and the revision does cite."""
    asked = (F.size(evidence_ids) > 0) & ~has_valid_citation(answer, evidence_ids) & ~cl.is_abstention(answer)
    return F.when(asked & F.coalesce(has_valid_citation(revised, evidence_ids), F.lit(False)), revised).otherwise(answer)


def with_values(answer: Column, revised: Column, bad: Column, bad_after: Column) -> Column:
    """The revised answer where it has text and strictly fewer unverified numbers."""
    return F.when((F.size(bad) > 0) & (F.trim(F.coalesce(revised, F.lit(""))) != "") & (F.size(bad_after) < F.size(bad)), revised).otherwise(answer)


def overlap_verifier(claim: Column, blocks: Column) -> Column:
    """The default verifier's response: by the share of the claim's words that its blocks have."""
    share = tx.overlap(tx.grounding_words(tx.without_markers(claim)), tx.grounding_words(F.array_join(blocks, " ")))
    said = F.when(share >= cl.STRONG, "SUPPORTED").when(share >= cl.WEAK, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return F.concat(F.lit("STATUS: "), said, F.lit("\nRATIONALE: word overlap"))


def verified(claims: DataFrame, evidence: DataFrame, verify: Callable[[Column, Column], Column] = overlap_verifier, *by: str) -> DataFrame:
    """claims (by..., claim_no, text, citation_ids) with the status of each. evidence: (by..., citation_id, text).

    A claim that cites nothing, or no block there is, is UNSUPPORTED without being asked; so is one for which the
    verifier has no response."""
    each = claims.select(*by, "claim_no", F.posexplode("citation_ids").alias("at", "citation_id")).join(evidence.select(*by, "citation_id", F.col("text").alias("block")), [*by, "citation_id"])
    lists = each.groupBy(*by, "claim_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda x: x["block"]).alias("blocks"))
    rows = claims.join(lists, [*by, "claim_no"], "left")
    said = F.when(F.col("blocks").isNotNull(), verify(F.col("text"), F.col("blocks")))
    return rows.withColumn("status", F.when(said.isNull(), "UNSUPPORTED").otherwise(cl.verdict(said))).drop("blocks")


# Training text --------------------------------------------------------------------------------------------------------


def messages(system: Column, user: Column, instruction: Column, context: Column) -> Column:
    """The messages before an answer: system and user where both are there, else the instruction with its context."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    there = lambda c: F.coalesce(c != "", F.lit(False))
    plain = F.when(there(context), F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n\nContext:\n"), context)).otherwise(F.coalesce(instruction, F.lit("")))
    return F.when(there(system) & there(user), F.array(one("system", system), one("user", user))).otherwise(F.array(one("user", plain)))


def chat_text(messages: Column, response: Column) -> Column:
    """Messages and the answer in ChatML."""
    turn = lambda role, text: F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))
    return F.concat(F.array_join(F.transform(messages, lambda m: turn(m["role"], m["content"])), ""), turn(F.lit("assistant"), response))


def within_length(rows: DataFrame, text: str, most: int, count: Callable[[Column], Column] = tx.token_count) -> DataFrame:
    """Rows whose text has at most so many tokens; longer ones go whole, none is cut."""
    return rows.filter(count(F.col(text)) <= most)
