"""The whole scan against a sequential reading of the same rules."""

import datetime as dt
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farsight.plans.makers import BadOutput, predictor_scorer
from farsight.functions.verdicts import FAILED_RATIONALE
from farsight.plans.scan import finalize, load_scan, page_corpus, run_scan, scan_results, write_scan_results
from farsight.schemas import REQUESTS
from farsight.sources.vocabulary import vocabulary_rows

PAGES = [
    (f"https://{'www.gov.uk' if i % 3 == 0 else 'blog.example'}/p{i}", f"T{i}", f"Page {i}: " + " ".join(
        w for w, n in (("rates", 2), ("payroll", 3), ("pension", 5), ("uk", 7)) if i % n == 0) + (" National Insurance" if i % 4 == 0 else "") + " update" * (i % 3))
    for i in range(60)
]
REQUEST = [("r1", "UK", None, None, dt.datetime(2026, 7, 1), ["rates, payroll", "pension", "payroll, rates, pension", "nowhere"]),
           ("r2", "FR", None, None, dt.datetime(2026, 7, 1), ["payroll"]), ("bad", "", None, None, dt.datetime(2026, 7, 1), ["x"])]


def sequential():
    """{(run, group order): (loop count, [urls in order of pass and rank])}"""
    words = {u: re.findall(r"[^\W_]+", t.lower()) for u, _, t in PAGES}
    out = {}
    for run, jurisdiction, _, _, _, groups in REQUEST:
        if not jurisdiction:
            continue
        state = [dict(kw=[k.strip() for k in g.split(",")], seen=set(), items=[], passes=0, active=True) for g in groups]
        seen_run = set()
        for number in (1, 2, 3):
            for s in (s for s in state if s["active"]):
                query = set(f"{s['kw'][(number - 1) % len(s['kw'])]} {jurisdiction} update".lower().split())
                scored = []
                for url, ws in words.items():
                    hits = [w for w in ws if w in query]
                    if hits:
                        scored.append((-len(set(hits)), -len(hits), url))
                kept = []
                for _, _, url in sorted(scored)[:10]:
                    if url not in s["seen"]:
                        s["seen"].add(url)
                        if url not in seen_run:
                            seen_run.add(url)
                            kept.append(url)
                texts = {u: t.lower() for u, _, t in PAGES}
                verdicts = ["NotRelevant" if not any(k in texts[u] for k in s["kw"]) else "Relevant" if "gov.uk" in u else "Borderline" for u in kept]
                s["items"] += [u for u, v in zip(kept, verdicts) if v != "NotRelevant"]
                s["passes"] = number
                said = "Finalize" if not kept or any(v != "NotRelevant" for v in verdicts) else "Retry"
                rich = kept and verdicts.count("Relevant") / len(kept) >= 0.8
                s["active"] = number < 3 and (said == "Retry" or bool(rich))
        for order, s in enumerate(state):
            out[run, order] = (s["passes"], s["items"])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame(PAGES, "url string, title string, cleaned_text string")
    return spark.createDataFrame(REQUEST, REQUESTS), corpus


def collected(scan):
    orders = {(g.run_id, g.group_id): g.group_ord for g in scan.groups.collect()}
    out = {(g.run_id, g.group_ord): (0, []) for g in scan.groups.collect()}
    items = scan.items.where("route = 'vetted'").orderBy("found_on_pass", "doc_index").collect()
    for r in scan.passes.groupBy("run_id", "group_id").agg(F.max("pass").alias("n")).collect():
        mine = [i.source_urls[0] for i in items if (i.run_id, i.group_id) == (r.run_id, r.group_id)]
        out[r.run_id, orders[r.run_id, r.group_id]] = (r.n, mine)
    return out


def test_scan_equals_sequential_reading(spark, tables, tmp_path):
    requests, corpus = tables
    root = str(tmp_path / "scan")
    scan = run_scan(requests, corpus, root)
    assert collected(scan) == sequential()

    vocabulary = vocabulary_rows(spark.createDataFrame([("National Insurance",), ("Pension",)], "name string"), "tags").unionByName(
        vocabulary_rows(spark.createDataFrame([("Payroll",), ("Rates",)], "name string"), "ImpactAreas"))
    results, records = finalize(scan, vocabulary)
    text = {u: t for u, _, t in PAGES}
    rows = records.collect()
    assert len(rows) == sum(len(items) for _, items in sequential().values())
    for r in rows:
        body = text[r.source_urls[0]].lower()
        assert ("National Insurance" in r.tags) == ("national insurance" in body) and ("Pension" in r.tags) == ("pension" in body)
        found = sorted((body.index(w), w.title()) for w in ("payroll", "rates") if w in body)
        assert r.impact_area == (found[0][1] if found else None)
        assert r.supporting_reference == r.source_urls[0] and r.full_text_ref.endswith(f"{r.id}.txt")
    nested = scan_results(results, records, requests)
    write_scan_results(nested, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.run_id, r.group_ord): r.status for r in back.collect()} == {k: "Completed" for k in sequential()}


def test_interrupted_scan_goes_on(spark, tables, tmp_path):
    requests, corpus = tables
    root = str(tmp_path / "scan")
    run_scan(requests, corpus, root, max_passes=1)
    assert load_scan(spark, root).passes.agg(F.max("pass")).head()[0] == 1

    assert collected(run_scan(requests, corpus, root)) == sequential()

    def not_again(_):
        raise AssertionError("a finished scan searches nothing")

    assert collected(run_scan(requests, corpus, root, search=not_again)) == sequential()


def test_failures_are_isolated(spark, tables, tmp_path):
    requests, corpus = tables

    def predict(docs: pd.DataFrame) -> pd.DataFrame:
        if (docs["group_name"] == "pension").any():
            raise ValueError("refused")
        return pd.DataFrame({"verdict": ["Relevant"] * len(docs), "date_confidence": ["Unknown"] * len(docs)})

    scan = run_scan(requests, corpus, str(tmp_path / "a"), scorer=predictor_scorer(predict))
    results, _ = finalize(scan, vocabulary_rows(spark.createDataFrame([], "name string"), "tags"))
    got = {(r.run_id, r.group_name): (r.status, r.carried > 0) for r in results.collect()}
    assert got["r1", "pension"] == ("Failed", False)
    assert got["r1", "rates, payroll"] == ("Completed", True) and got["r2", "payroll"] == ("Completed", True)

    broken = run_scan(
        requests, corpus, str(tmp_path / "b"), search=lambda q: spark.createDataFrame([], "run_id string, group_id string, group_ord int, pass int, rank int, url string, title string, source_query string"),
        search_failures=lambda q: q.where("run_id = 'r1'").select("run_id", "group_id", "pass", F.lit("timeout").alias("reason")))
    results, _ = finalize(broken, vocabulary_rows(spark.createDataFrame([], "name string"), "tags"))
    # a failed search retries up to the cap and fails the group; an empty one ends it at once
    assert {(r.run_id, r.status, r.loop_count) for r in results.collect()} == {("r1", "Failed", 3), ("r2", "Completed", 1)}


def test_unusable_answers_fall_back_and_record_failures_are_classified(spark, tables, tmp_path):
    requests, corpus = tables

    def predict(docs: pd.DataFrame) -> pd.DataFrame:
        if docs["url"].str.endswith("0").any():
            raise BadOutput("not json")
        return pd.DataFrame({"verdict": ["Borderline"] * len(docs)})

    scan = run_scan(requests.where("run_id = 'r1'"), corpus, str(tmp_path / "c"), scorer=predictor_scorer(predict), max_passes=1)
    items = {i.source_urls[0]: i for i in scan.items.collect()}
    fallen = [i for u, i in items.items() if u.endswith("0")]
    assert fallen and {(i.verdict, i.eval_rationale) for i in fallen} == {("Borderline", FAILED_RATIONALE)}
    groups = {i.group_id for i in fallen}
    assert {r.llm_decision for r in scan.passes.collect() if r.group_id in groups} == {"Retry"}

    def records(base):
        status = F.when(F.col("group_name") == "pension", 404).when(F.col("group_name") == "rates, payroll", 503)
        return base.select("run_id", "group_id", "id", F.lit("judged").alias("company_view"), status.alias("error_status"),
                           *[F.lit(None).cast("string").alias(n) for n in ("title_of_update", "summary_of_update", "level_of_authority", "status_of_change", "regulator")])

    vocabulary = vocabulary_rows(spark.createDataFrame([], "name string"), "tags")
    def label(items):
        return items.select("run_id", "group_id", "id", F.lit(" RATES ").alias("impact_area_value"), F.array(F.lit("x"), F.lit("pension")).alias("tag_values"))

    made = vocabulary_rows(spark.createDataFrame([("Pension",)], "name string"), "tags").unionByName(
        vocabulary_rows(spark.createDataFrame([("Rates",)], "name string"), "ImpactAreas"))
    _, labelled = finalize(scan, made, area_maker=label, tag_maker=label, what_it_does=F.lit("w"))
    assert {(r.impact_area, tuple(r.tags), r.what_it_does) for r in labelled.collect()} == {("Rates", ("Pension",), "w")}

    results, judged = finalize(scan, vocabulary, record_maker=records)
    assert {r.group_name: r.status for r in results.collect() if r.group_name != "nowhere"} == {
        "rates, payroll": "Completed", "pension": "Failed", "payroll, rates, pension": "Completed"}
    views = {}
    for r in judged.collect():
        views.setdefault(r.group_name, set()).add(r.company_view)
    # a transient status leaves the base record, a hard one fails the group
    assert views.get("rates, payroll") == {None} and "pension" not in views


def test_repeated_urls_and_rejected_requests(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.gov.uk/1", "<title>B</title><p> rates b"), ("https://a.gov.uk/1", "<title>A</title><p> rates a"),
                                   ("https://a.gov.uk/1", "<title>A</title><p> rates a"), ("https://a.gov.uk/2", "<p>rates c")], "url string, html string")
    corpus = page_corpus(pages)
    assert sorted((r.url, r.cleaned_text) for r in corpus.collect()) == [("https://a.gov.uk/1", "A rates a"), ("https://a.gov.uk/2", "rates c")]
    requests = spark.createDataFrame([("r", "UK", None, None, dt.datetime(2026, 7, 1), ["rates"]), ("bad", "", None, None, dt.datetime(2026, 7, 1), ["x"])], REQUESTS)
    scan = run_scan(requests, corpus, str(tmp_path / "scan"))
    assert scan.items.count() == 2 and {r.run_id for r in scan.groups.collect()} == {"r"}
    assert [(r.run_id, len(r.issues) > 0) for r in scan.rejected.collect()] == [("bad", True)]


def test_pages_with_their_own_url_are_not_shuffled(spark):
    pages = spark.createDataFrame([(f"https://a.gov.uk/{k // 2 if k < 4 else k}", f"<p>{k}") for k in range(20)], "url string, html string")
    corpus = page_corpus(pages)
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and plan.count("BroadcastHashJoin") == 2
    assert sorted(r.cleaned_text for r in corpus.collect()) == sorted(str(k) for k in range(20) if k not in (1, 3))


def test_search_makes_no_row_per_page_and_group_before_the_cut(spark):
    from farsight.sources.corpus import search

    corpus = spark.createDataFrame([(f"u{i}", "update rates") for i in range(50)], "url string, t string")
    queries = spark.createDataFrame([(f"g{k}", "rates update") for k in range(400)], "group_id string, query string")
    found = search(corpus, "url", "t", queries, ["group_id"], 3)
    assert found.count() == 1200 and found.where("rank = 1").select("doc_id").distinct().head()[0] == "u0"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    cut = next(i for i, line in enumerate(lines) if "Window" in line)
    assert "group_id" not in "".join(line for line in lines[cut:] if "doc_id" in line)


def test_a_failing_document_costs_few_calls(spark, tmp_path):
    """The answers to a batch of 128 with one refused document, and how often the predictor was asked for them."""
    def refusing(docs):
        with open(f"{tmp_path}/calls", "a") as f:
            f.write("x")
        if (docs["doc_index"] == 77).any():
            raise ValueError("refused")
        return pd.DataFrame({"verdict": ["Relevant"] * len(docs)})

    docs = spark.range(0, 128, 1, 1).select(
        F.lit("r").alias("run_id"), F.lit("g").alias("group_id"), F.lit(1).alias("pass"), F.col("id").cast("int").alias("doc_index"))
    got = {r.doc_index: (r.verdict, r.fallback, r.error) for r in predictor_scorer(refusing)(docs).collect()}
    assert got == {k: (None, False, "refused") if k == 77 else ("Relevant", False, None) for k in range(128)}
    assert (tmp_path / "calls").stat().st_size <= 15
