import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from farsight.functions import verdicts as W
from farsight.operators import verdicts as V
from farsight.schemas import VERDICT_PAYLOADS

KEY = ("r", "g", 1)


def answers(spark, *payloads):
    return spark.createDataFrame([("r", f"g{i}", 1, p) for i, p in enumerate(payloads)], VERDICT_PAYLOADS)


def docs(spark, *sizes):
    rows = [("r", f"g{i}", 1, n) for i, size in enumerate(sizes) for n in range(size)]
    return spark.createDataFrame(rows, "run_id string, group_id string, pass int, doc_index int")


def test_answers_are_parsed_filled_and_guarded(spark):
    full = json.dumps({"thoughtProcess": " t ", "decision": "STOP", "items": [
        {"index": 2, "verdict": "RELEVANT", "rationale": " why ", "publicationDate": "15 June 2025", "effectiveDate": "bad", "dateConfidence": "HIGH"},
        {"index": 2, "verdict": "NOT_RELEVANT"}, {"index": 9, "verdict": "RELEVANT"}, {"index": -1, "verdict": "RELEVANT"}, {"index": 0, "verdict": "Not Relevant", "rationale": " "}]})
    parsed = V.parse_verdicts(answers(spark, full, "not json", '{"decision":"FINALIZE"}', '{"items":[],"decision":"finalise"}', None))
    rows = {r.group_id: r for r in parsed.collect()}
    assert (rows["g0"].thought_process, rows["g0"].llm_decision) == ("t", "Finalize")
    assert all(rows[g].failed and rows[g].llm_decision == "Retry" and rows[g].thought_process == W.FAILED_THOUGHT for g in ("g1", "g2", "g4"))
    assert (rows["g3"].failed, rows["g3"].thought_process, rows["g3"].llm_decision) == (False, W.DEFAULT_THOUGHT, "Finalize")

    verdicts = V.first_verdicts(V.verdict_rows(parsed))
    filled = V.fill_verdicts(docs(spark, 3, 2, 0, 1, 1), verdicts, parsed.where("failed").select(*V.PASS))
    got = {(r.group_id, r.doc_index): (r.verdict, r.rationale, r.publication_date, r.date_confidence) for r in filled.collect()}
    assert got == {
        ("g0", 0): ("NotRelevant", None, None, "Unknown"), ("g0", 1): ("Borderline", W.OMITTED_RATIONALE, None, "Unknown"),
        ("g0", 2): ("Relevant", "why", dt.date(2025, 6, 15), "High"), ("g1", 0): ("Borderline", W.FAILED_RATIONALE, None, "Unknown"),
        ("g1", 1): ("Borderline", W.FAILED_RATIONALE, None, "Unknown"), ("g3", 0): ("Borderline", W.OMITTED_RATIONALE, None, "Unknown"),
        ("g4", 0): ("Borderline", W.FAILED_RATIONALE, None, "Unknown")}


def test_passes_without_documents(spark):
    passes = spark.createDataFrame([("r", "g0", 1, False, None), ("r", "g1", 1, True, "timeout"), ("r", "g2", 1, True, "x"), ("r", "g3", 1, False, None)],
                                   "run_id string, group_id string, pass int, search_failed boolean, search_failure_reason string")
    counts = spark.createDataFrame([("r", "g2", 1, 2), ("r", "g3", 1, 1)], "run_id string, group_id string, pass int, n_docs long")
    answered = spark.createDataFrame([("r", "g2", 1, "t", "Finalize"), ("r", "g0", 1, "t", "Retry")], "run_id string, group_id string, pass int, thought_process string, llm_decision string")
    got = {r.group_id: (r.llm_decision, r.n_docs) for r in V.fill_decisions(passes, answered, counts).collect()}
    assert got == {"g0": ("Finalize", 0), "g1": ("Retry", 0), "g2": ("Finalize", 2), "g3": ("Retry", 1)}


@pytest.mark.parametrize(
    "number, said, share, final, override, reason",
    [(1, "Finalize", 1.0, "Retry", True, "recall override: 100% of items RELEVANT (>= 80%); searching again for more."),
     (1, "Finalize", 0.8, "Retry", True, "recall override: 80% of items RELEVANT (>= 80%); searching again for more."),
     (1, "Finalize", 0.79, "Finalize", False, None), (1, "Retry", 1.0, "Retry", False, None), (3, "Finalize", 1.0, "Finalize", False, None),
     (3, "Retry", 0.0, "Finalize", True, "maxLoops cap (3) reached."), (2, "Finalize", None, "Finalize", False, None)],
)
def test_loop_decision(spark, number, said, share, final, override, reason):
    df = spark.createDataFrame([(number, 3, said, share)], "pass int, max_loops int, llm_decision string, relevant_share double")
    row = V.decide(df).head()
    assert (row.final_decision, row.decision_override, row.override_reason) == (final, override, reason)


def test_share_counts_every_verdict(spark):
    df = spark.createDataFrame([("Relevant",)] * 4 + [("Borderline",)], "verdict string").withColumns(dict(run_id=F.lit("r"), group_id=F.lit("g"), **{"pass": F.lit(1)}))
    assert V.relevant_share(df).head().relevant_share == 0.8


def test_continue_rule(spark):
    df = spark.createDataFrame([("a", None, 3, None), ("b", 1, 3, "Retry"), ("c", 3, 3, "Retry"), ("d", 1, 3, "Finalize")], "g string, pass int, max_loops int, final_decision string")
    assert [r.g for r in V.still_active(df).collect()] == ["a", "b"]


def test_routing_and_items(spark):
    rows = [("https://Gov.uk/x", "Relevant", dt.date(2025, 5, 1)), ("https://gov.uk/y", "NotRelevant", dt.date(2030, 1, 1)), ("https://gov.uk/z", "Borderline", dt.date(2030, 1, 1))]
    df = spark.createDataFrame([("r", "g", 2, i, u, v, d) for i, (u, v, d) in enumerate(rows)],
                               "run_id string, group_id string, pass int, doc_index int, url string, verdict string, publication_date date")
    none = F.lit(None).cast("date")
    df = df.withColumns(dict(rationale=F.lit("w"), domain=F.lit("gov.uk"), unverified=F.lit(False), effective_date=none, applies_from=none, applies_to=none, date_confidence=F.lit("High")))
    requests = spark.createDataFrame([("r", None, None, dt.datetime(2026, 7, 1))], "run_id string, start_date date, end_date date, started_at timestamp")
    routed = V.route_items(df, requests)
    items = {r.doc_index: r for r in V.result_items(routed).collect()}
    assert [(items[i].route, items[i].out_of_window) for i in range(3)] == [("vetted", False), ("discarded", False), ("discarded", True)]
    assert items[0].source_urls == ["https://Gov.uk/x"] and items[0].found_on_pass == 2 and len(items[0].id) == 16
    counts = V.route_counts(routed, ["run_id"]).head()
    assert (counts.carried, counts.borderline, counts.dropped, counts.out_of_window) == (1, 0, 2, 1)


def test_steer_notes(spark):
    notes = ["Missing facets: rates, dates - aspects never retrieved. Weak evidence: facets P, Q are represented but the evidence is out-of-date because x.",
             "Missing facets: none. Weak evidence: none.", "Missing facets: none identifiable. Weak evidence: none.", "Missing facets: a; Weak evidence: b is thin.", "free text", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i int, thought_process string")
    got = [(r.i, r.facet, r.reason) for r in V.steer_rows(df, ["i"]).orderBy("i", "facet_pos").collect()]
    assert got == [(0, "rates", "MissingFacet"), (0, "dates", "MissingFacet"), (0, "P", "Stale"), (0, "Q", "Stale"), (3, "a", "MissingFacet"), (3, "b", "WeakEvidence")]


@pytest.mark.parametrize("payload", [
    '{"items":[{"index":"abc","verdict":"NOT_RELEVANT"}]}', '{"items":[{"index":1,"verdict":7}]}', '{"items":"none"}', '{"items":[3]}',
    '{"decision":true,"items":[]}', '{"items":[{"index":2.5}]}', '{"items":[{"rationale":["x"]}]}', '{"items":[{"index":1},{"index":"1x"}]}',
    '{"Items":[{"INDEX":1,"Verdict":7}]}', '{"items":[{"index":"99999999999"}]}', '{"items":[null]}', '[]', '{"items":[]', '{"items":[{"index":" 1"}]}',
])
def test_a_field_of_another_type_fails_the_answer(spark, payload):
    row = V.parse_verdicts(answers(spark, payload)).head()
    assert row.failed and row.items is None and row.llm_decision == "Retry"


def test_absent_and_null_fields_do_not_fail(spark):
    for payload in ('{"items":[{}]}', '{"items":[{"index":null,"verdict":null,"extra":7}],"thoughtProcess":null}', '{"items":[]}'):
        assert not V.parse_verdicts(answers(spark, payload)).head().failed


@pytest.mark.parametrize("payload", [
    '{"decision":"FINALIZE","items":[{"index":0,"verdict":"RELEVANT"}],"meta":{"index":"a","items":"x"}}',
    '{"Decision":"FINALIZE","Items":[{"Index":0,"Verdict":"RELEVANT"}]}',
    '{"decision":"FINALIZE","items":[{"index":"0","verdict":"RELEVANT","notes":[{"verdict":[1]}]}]}',
    '{"DECISION":"RETRY","decision":"FINALIZE","items":[{"INDEX":5,"index":0,"verdict":"RELEVANT"}]}',
])
def test_unknown_members_other_case_and_numbers_in_strings_are_read(spark, payload):
    parsed = V.parse_verdicts(answers(spark, payload))
    assert [(r.failed, r.llm_decision) for r in parsed.collect()] == [(False, "Finalize")]
    assert [(r.doc_index, r.verdict) for r in V.verdict_rows(parsed).collect()] == [(0, "Relevant")]
