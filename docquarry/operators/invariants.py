"""What must hold of every answer that is given out: rules as data, and for each answer the list of those it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What fields may say.
STATUSES = ["SUPPORTED", "PARTIALLY_SUPPORTED", "CONTRADICTED", "UNSUPPORTED", "NOT_VERIFIED"]
KINDS = ["text", "table", "figure"]
GROUNDINGS = ["strong", "weak", "none"]
ECHO = "The following statements from that answer"

#: An answer as it is given out. `asked_mode` and `asked_documents` are what the request said, null if it didn't.
RESPONSE = """query_id long, answer string, mode string, asked_mode string, asked_documents array<string>, num_sources int,
evidence array<struct<citation_id: int, document_id: string, page_number: int, text: string, chunk_type: string, image_url: string>>,
claims array<struct<claim_id: string, text: string, status: string, grounding: string, citation_ids: array<int>>>,
metrics struct<total_claims: int, total_citations: int, flagged_claims: int, verified_claims: int, citation_coverage: double, citation_precision: double, faithfulness: double, unsupported_claim_rate: double>,
latency struct<retrieval: double, generation: double, verification: double, total: double>"""

c = F.col


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def _count(items: Column, which) -> Column:
    return F.size(F.filter(items, which))


def rules() -> dict[str, Column]:
    """Each rule's name and when an answer breaks it. A field that is missing breaks the rule that needs it."""
    evidence, claims, metrics, latency = F.coalesce("evidence", F.array()), F.coalesce("claims", F.array()), c("metrics"), c("latency")
    ids = F.transform(evidence, lambda e: e["citation_id"])
    cited = lambda x: F.coalesce(x["citation_ids"], F.array().cast("array<int>"))
    n, n_verified = F.size(claims), _count(claims, lambda x: x["status"] != "NOT_VERIFIED")
    none = _count(claims, lambda x: x["grounding"] == "none")
    share = lambda m: metrics[m].isNull() | (metrics[m] < 0) | (metrics[m] > 1) | F.isnan(metrics[m])
    coverage = F.try_divide(_count(claims, lambda x: F.size(cited(x)) > 0), n)
    asked, high = c("asked_mode"), c("asked_mode") == "high_faithfulness"
    out = {
        "answer_empty": _blank(c("answer")),
        "answer_echoes_prompt": c("answer").contains(ECHO),
        "evidence_missing": F.size(evidence) == 0,
        "evidence_numbering": (F.size(evidence) > 0) & (ids != F.sequence(F.lit(1), F.greatest(F.size(evidence), F.lit(1)))),
        "num_sources": ~c("num_sources").eqNullSafe(F.size(evidence)),
        "evidence_incomplete": F.exists(evidence, lambda e: _blank(e["text"]) | _blank(e["document_id"]) | (F.coalesce(e["page_number"], F.lit(0)) < 1)),
        "evidence_kind": F.exists(evidence, lambda e: ~F.coalesce(e["chunk_type"], F.lit("text")).isin(KINDS)),
        "image_without_figure": F.exists(evidence, lambda e: ~_blank(e["image_url"]) & ~e["chunk_type"].eqNullSafe("figure")),
        "evidence_outside_filter": c("asked_documents").isNotNull() & F.exists(evidence, lambda e: ~F.array_contains("asked_documents", e["document_id"])),
        "claim_id_twice": F.size(F.array_distinct(F.transform(claims, lambda x: x["claim_id"]))) < n,
        "claim_status": F.exists(claims, lambda x: ~F.coalesce(x["status"], F.lit("")).isin(STATUSES)),
        "claim_cites_unknown": F.exists(claims, lambda x: F.size(F.array_except(cited(x), ids)) > 0),
        "claim_empty": F.exists(claims, lambda x: _blank(x["text"])),
        "claim_grounding": F.exists(claims, lambda x: x["grounding"].isNotNull() & ~x["grounding"].isin(GROUNDINGS)),
        "uncited_but_grounded": F.exists(claims, lambda x: (F.size(cited(x)) == 0) & ~F.coalesce(x["grounding"], F.lit("none")).eqNullSafe("none")),
        "flagged_claims": (n > 0) & ~metrics["flagged_claims"].eqNullSafe(none),
        "verified_claims": ~metrics["verified_claims"].eqNullSafe(n_verified),
        "coverage_range": share("citation_coverage"),
        "unmeasured_but_reported": (n > 0) & (n_verified == 0) & (metrics["citation_precision"].isNotNull() | metrics["faithfulness"].isNotNull() | metrics["unsupported_claim_rate"].isNotNull()),
        "metric_range": ((n == 0) | (n_verified > 0)) & (share("citation_precision") | share("faithfulness") | share("unsupported_claim_rate")),
        "total_claims": ~metrics["total_claims"].eqNullSafe(n),
        "total_citations": ~metrics["total_citations"].eqNullSafe(F.aggregate(claims, F.lit(0), lambda a, x: a + F.size(cited(x)))),
        "coverage_recomputed": (n > 0) & (F.abs(coverage - F.coalesce(metrics["citation_coverage"], F.lit(-1.0))) > 1e-6),
        "latency_negative": F.exists(F.array("latency.retrieval", "latency.generation", "latency.verification", "latency.total"), lambda v: v < 0),
        "latency_total": F.coalesce(latency["total"], F.lit(0.0)) + 1 < F.coalesce(latency["generation"], F.lit(0.0)),
        "mode_echo": asked.isNotNull() & ~c("mode").eqNullSafe(asked),
        "verification_untimed": high & (n > 0) & (F.coalesce(latency["verification"], F.lit(0.0)) <= 0),
        "claims_left_unverified": high & (n_verified != n),
        "verified_without_being_asked": asked.isin("fast", "balanced") & (n_verified != 0),
        "verification_timed_without_being_asked": asked.isNotNull() & ~high & (F.coalesce(latency["verification"], F.lit(0.0)) != 0),
    }
    return {name: F.coalesce(broken, F.lit(False)) for name, broken in out.items()}


def with_problems(responses: DataFrame) -> DataFrame:
    """responses (see RESPONSE) with `problems`, the names of the rules that each breaks, in the rules' order."""
    broken = F.array(*(F.when(b, name) for name, b in rules().items()))
    return responses.withColumn("problems", F.filter(broken, lambda x: x.isNotNull()))


def summed(checked: DataFrame) -> DataFrame:
    """(problem, n) of rows with `problems`; every rule has a row, also one that none breaks."""
    every = F.array(*map(F.lit, rules()))
    rows = checked.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))
    names = checked.sparkSession.range(1).select(F.explode(every).alias("problem"))
    return names.join(rows, "problem", "left").select("problem", F.coalesce("n", F.lit(0)).alias("n"))
