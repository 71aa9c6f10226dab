"""Each rule on answers: a sound answer breaks none, and for every rule there is one that breaks it."""

import copy

from docquarry.operators import invariants as iv

GOOD = {
    "query_id": 0,
    "answer": "It is so [1][2].",
    "mode": "high_faithfulness",
    "asked_mode": "high_faithfulness",
    "asked_documents": ["a", "b"],
    "num_sources": 2,
    "evidence": [
        {"citation_id": 1, "document_id": "a", "page_number": 1, "text": "x", "chunk_type": "text", "image_url": None},
        {"citation_id": 2, "document_id": "b", "page_number": 3, "text": "y", "chunk_type": "figure", "image_url": "y.png"},
    ],
    "claims": [
        {"claim_id": "1", "text": "It is.", "status": "SUPPORTED", "grounding": "strong", "citation_ids": [1, 2]},
        {"claim_id": "2", "text": "So.", "status": "CONTRADICTED", "grounding": "none", "citation_ids": []},
    ],
    "metrics": {"total_claims": 2, "total_citations": 2, "flagged_claims": 1, "verified_claims": 2, "citation_coverage": 0.5, "citation_precision": 1.0, "faithfulness": 0.5, "unsupported_claim_rate": 0.0},
    "latency": {"retrieval": 1.0, "generation": 5.0, "verification": 2.0, "total": 9.0},
}
PLAIN = {**GOOD, "mode": "fast", "asked_mode": "fast", "claims": [{**c, "status": "NOT_VERIFIED"} for c in GOOD["claims"]], "metrics": {**GOOD["metrics"], "verified_claims": 0, "citation_precision": None, "faithfulness": None, "unsupported_claim_rate": None}, "latency": {**GOOD["latency"], "verification": 0.0}}
NONE = {**PLAIN, "claims": [], "asked_mode": None, "metrics": {"total_claims": 0, "total_citations": 0, "flagged_claims": 0, "verified_claims": 0, "citation_coverage": 0.0, "citation_precision": 0.0, "faithfulness": 0.0, "unsupported_claim_rate": 0.0}}

BROKEN = [
    ("answer_empty", GOOD, ("answer",), " "),
    ("answer_empty", GOOD, ("answer",), None),
    ("answer_echoes_prompt", GOOD, ("answer",), iv.ECHO + " ..."),
    ("evidence_missing", GOOD, ("evidence",), None),
    ("evidence_numbering", GOOD, ("evidence", 0, "citation_id"), 3),
    ("num_sources", GOOD, ("num_sources",), None),
    ("evidence_incomplete", GOOD, ("evidence", 1, "text"), " "),
    ("evidence_incomplete", GOOD, ("evidence", 1, "page_number"), None),
    ("evidence_kind", GOOD, ("evidence", 0, "chunk_type"), "sound"),
    ("image_without_figure", GOOD, ("evidence", 0, "image_url"), "x.png"),
    ("evidence_outside_filter", GOOD, ("asked_documents",), ["a"]),
    ("claim_id_twice", GOOD, ("claims", 1, "claim_id"), "1"),
    ("claim_status", GOOD, ("claims", 0, "status"), None),
    ("claim_cites_unknown", GOOD, ("claims", 0, "citation_ids"), [1, 9]),
    ("claim_empty", GOOD, ("claims", 0, "text"), ""),
    ("claim_grounding", GOOD, ("claims", 0, "grounding"), "solid"),
    ("uncited_but_grounded", GOOD, ("claims", 1, "grounding"), "weak"),
    ("flagged_claims", GOOD, ("metrics", "flagged_claims"), 0),
    ("verified_claims", GOOD, ("metrics", "verified_claims"), None),
    ("coverage_range", GOOD, ("metrics", "citation_coverage"), None),
    ("unmeasured_but_reported", PLAIN, ("metrics", "faithfulness"), 0.5),
    ("metric_range", GOOD, ("metrics", "faithfulness"), None),
    ("metric_range", GOOD, ("metrics", "citation_precision"), float("nan")),
    ("metric_range", NONE, ("metrics", "faithfulness"), None),
    ("total_claims", GOOD, ("metrics", "total_claims"), 3),
    ("total_citations", GOOD, ("metrics", "total_citations"), 3),
    ("coverage_recomputed", GOOD, ("metrics", "citation_coverage"), 0.6),
    ("latency_negative", GOOD, ("latency", "retrieval"), -0.1),
    ("latency_total", GOOD, ("latency", "total"), 3.0),
    ("mode_echo", GOOD, ("mode",), "fast"),
    ("verification_untimed", GOOD, ("latency", "verification"), None),
    ("claims_left_unverified", GOOD, ("claims", 0, "status"), "NOT_VERIFIED"),
    ("verified_without_being_asked", PLAIN, ("claims", 0, "status"), "SUPPORTED"),
    ("verification_timed_without_being_asked", PLAIN, ("latency", "verification"), 1.0),
]


def test_every_rule_can_be_broken(spark):
    rows = []
    for i, (_, base, path, value) in enumerate(BROKEN):
        row = copy.deepcopy({**base, "query_id": i})
        at = row
        for step in path[:-1]:
            at = at[step]
        at[path[-1]] = value
        rows.append(row)
    rows += [{**r, "query_id": 1000 + i} for i, r in enumerate((GOOD, PLAIN, NONE, {**GOOD, "asked_mode": None, "asked_documents": None}))]
    # an answer without a mode that was asked for may have been verified or not; its time isn't judged
    checked = iv.with_problems(spark.createDataFrame(rows, iv.RESPONSE))
    got = {r["query_id"]: r["problems"] for r in checked.collect()}
    for i, (rule, *_) in enumerate(BROKEN):
        assert rule in got[i], (i, rule, got[i])
    assert [got[1000 + i] for i in range(4)] == [[], [], [], []]
    assert {r for r, *_ in BROKEN} == set(iv.rules())
    sums = {r["problem"]: r["n"] for r in iv.summed(checked).collect()}
    assert set(sums) == set(iv.rules()) and all(sums.values())
    assert set(r["n"] for r in iv.summed(checked.filter("query_id >= 1000")).collect()) == {0}
