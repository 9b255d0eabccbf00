import datetime as dt

import pytest
from pyspark.sql import functions as F

from farsight.operators import gates as G
from farsight.operators import history as H
from farsight.operators import learnings as L
from farsight.operators import metrics as M
from farsight.schemas import DOCUMENT_STORE, HITS, ITEM_STRUCT
from farsight.sources import snapshots as N
from farsight.sources import store as S

PASSES = ("run_id string, group_id string, pass int, query string, query_rationale string, thought_process string, llm_decision string, final_decision string, "
          "decision_override boolean, override_reason string, search_failed boolean, search_failure_reason string")
D = dt.date(2025, 6, 15)


def passes(spark):
    return spark.createDataFrame([
        ("r", "g", 1, "q1", None, "t1", "Finalize", "Retry", True, "recall", False, None), ("r", "g", 2, "q2", "why", "t2", "Finalize", "Finalize", False, None, False, None),
        ("r", "h", 1, "q1", None, "t", "Retry", "Retry", False, None, False, None), ("r", "h", 2, "q2", None, None, None, None, None, None, True, "timeout"),
        ("r", "k", 1, "q1", None, "t", "Retry", "Retry", False, None, True, "timeout")], PASSES)


def items(spark):
    fields = ITEM_STRUCT[len("struct<"):-1].replace(":", " ")
    rows = [("A", 1, "Relevant", "vetted"), ("B", 1, "Borderline", "vetted"), ("C", 1, "NotRelevant", "discarded"), ("D", 2, "Relevant", "vetted"), ("E", 2, "NotRelevant", "discarded")]
    data = [(i, p, [f"https://x/{i}"], "x", None, v, None, False, D, None, None, D, "High", "r", "g", n, route) for n, (i, p, v, route) in enumerate(rows)]
    return spark.createDataFrame(data, fields + ", run_id string, group_id string, doc_index int, route string")


def test_history_round_trip(spark):
    hits = spark.createDataFrame([("r", "g", 0, 1, n, f"https://x/{n}", None, "x", "q1") for n in (2, 1, 3)], HITS)
    keys = spark.createDataFrame([("r", "g", f"x/{n}") for n in range(5)] + [("r", "z", "only")], "run_id string, group_id string, url_key string")
    history = H.nested_history(passes(spark), hits, items(spark), keys)
    back = N.parse_history(N.history_json(history))
    assert sorted(back.collect(), key=str) == sorted(history.collect(), key=str)
    g = back.where("group_id = 'g'").head().history
    assert [h.rank for h in g.passes[0].hits] == [1, 2, 3] and g.passes[1].hits == []
    assert [i.id for i in g.passes[0].review.vetted] == ["A", "B"] and [i.id for i in g.passes[1].review.discarded] == ["E"]
    assert back.where("group_id = 'h'").head().history.passes[1].review is None
    assert sorted(map(tuple, H.restore_passes(back).collect()), key=str) == sorted(
        (tuple(r) for r in passes(spark).select(H.restore_passes(back).columns).collect()), key=str)
    assert sorted(map(tuple, H.restore_keys(back).collect())) == sorted(map(tuple, keys.collect()))
    assert {(r.id, r.route) for r in H.restore_items(back).collect()} == {(r.id, r.route) for r in items(spark).collect()}
    # restoring and nesting again changes nothing
    assert N.history_json(back).count() == history.count()


def test_views_status_and_resume(spark):
    assert [r.final_decision for r in H.review_notes(passes(spark)).where("group_id = 'g'").orderBy("pass").collect()] == ["Retry", "Finalize"]
    assert [r.id for r in H.reviewed_items(items(spark), "vetted").orderBy("found_on_pass", "doc_index").collect()] == ["A", "B", "D"]
    groups = spark.createDataFrame([("r", "g", 3, False), ("r", "h", 3, False), ("r", "k", 1, False), ("r", "new", 3, False), ("r", "bad", 3, True)], "run_id string, group_id string, max_loops int, faulted boolean")
    status = {r.group_id: (r.status, r.loop_count, r.carried) for r in M.group_status(groups, passes(spark), items(spark)).collect()}
    assert status == {"g": ("Completed", 2, 3), "h": ("Failed", 2, 0), "k": ("Failed", 1, 0), "new": ("Completed", 0, 0), "bad": ("Failed", 0, 0)}
    assert {r.group_id: r.next_pass for r in H.next_passes(groups, passes(spark)).collect()} == {"h": 3, "new": 1, "bad": 1}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "s")
    cols = "session_id string, checkpoint_id string, parent_checkpoint_id string, value_json string, seq long"
    N.write_snapshots(spark.createDataFrame([("s", "1", None, "a", 1), ("s", "2", "1", "b", 2), ("t", "1", None, "c", 1)], cols), path)
    N.write_snapshots(spark.createDataFrame([("s", "2", "1", "b2", 3)], cols), path)
    assert {r.checkpoint_id: r.value_json for r in N.snapshot_index(spark, path, "s").collect()} == {"1": "a", "2": "b2"}
    assert [r.checkpoint_id for r in N.snapshot_index(spark, path, "s", parent="1").collect()] == ["2"]
    assert N.snapshot(spark, path, "t", "1") == "c"
    with pytest.raises(KeyError):
        N.snapshot(spark, path, "t", "2")
    plan = N.snapshot_index(spark, path, "s")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_full_text_is_written_by_pass(spark, tmp_path):
    path = str(tmp_path / "f")
    cols = "run_id string, group_id string, id string, found_on_pass int, route string, cleaned_text string"
    first = N.with_full_text_ref(spark.createDataFrame([("r", "g", "a", 1, "vetted", "A"), ("r", "g", "b", 1, "vetted", " "), ("r", "g", "c", 1, "discarded", "C")], cols))
    second = N.with_full_text_ref(spark.createDataFrame([("r", "g", "d", 2, "vetted", "D")], cols))
    for batch in (first, second, second):
        N.write_full_text(batch, path)
    back = N.attach_full_text(first.unionByName(second).drop("cleaned_text"), N.read_full_text(spark, path))
    assert {r.id: (r.full_text_ref, r.full_text) for r in back.collect()} == {
        "a": ("fulltext/r/g/a.txt", "A"), "b": (None, None), "c": (None, None), "d": ("fulltext/r/g/d.txt", "D")}


def docs(spark, *rows):
    return spark.createDataFrame(rows, DOCUMENT_STORE)


def test_store_batches(spark, tmp_path):
    old = docs(spark, ("1", "p", "a", 1), ("2", "p", "b", 1), ("1", "q", "c", 1))
    batch = docs(spark, ("2", "p", "B", 2), ("3", "p", "C", 2))
    ids = lambda df: sorted((r.partition, r.id, r.payload) for r in df.collect())
    assert ids(S.upsert(old, batch)) == [("p", "1", "a"), ("p", "2", "B"), ("p", "3", "C"), ("q", "1", "c")]
    added, taken = S.create(old, batch)
    assert (ids(added), ids(taken)) == ([("p", "3", "C")], [("p", "2", "B")])
    after, missing = S.replace(old, batch)
    assert (ids(after), ids(missing)) == ([("p", "1", "a"), ("p", "2", "B"), ("q", "1", "c")], [("p", "3", "C")])
    assert ids(S.delete(old, batch)) == [("p", "1", "a"), ("q", "1", "c")]
    assert [r.payload for r in S.point_reads(batch, old).orderBy("id").collect()] == ["b", None]
    assert ids(S.query(old, F.col("id") == "1")) == [("p", "1", "a"), ("q", "1", "c")] and ids(S.query(old, partition="q")) == [("q", "1", "c")]

    path = str(tmp_path / "store")
    S.write_upsert(spark, path, old, DOCUMENT_STORE)
    before = {f.name for f in (tmp_path / "store" / "partition=q").glob("*.parquet")}
    S.write_upsert(spark, path, batch, DOCUMENT_STORE)
    S.write_upsert(spark, path, batch, DOCUMENT_STORE)
    assert ids(spark.read.schema(DOCUMENT_STORE).parquet(path)) == [("p", "1", "a"), ("p", "2", "B"), ("p", "3", "C"), ("q", "1", "c")]
    # a partition the batch does not touch is not rewritten
    assert {f.name for f in (tmp_path / "store" / "partition=q").glob("*.parquet")} == before


def test_versions_do_not_grow_on_rerun(spark):
    runs = spark.createDataFrame([("b", dt.datetime(2026, 2, 1)), ("a", dt.datetime(2026, 3, 1)), ("c", dt.datetime(2026, 3, 1))], "run_id string, started_at timestamp")
    rows = [("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), ("a", "y")]
    df = spark.createDataFrame([(*r, "g", 1, 1) for r in rows], "run_id string, id string, group_id string, found_on_pass int, version int")
    got = {(r.run_id, r.id): r.version for r in S.versioned_results(df, runs).collect()}
    assert got == {("b", "x"): 1, ("a", "x"): 2, ("c", "x"): 3, ("a", "y"): 1}
    assert {(r.run_id, r.id): r.version for r in S.versioned_results(df.unionByName(df), runs).collect()} == got


def test_gates(spark):
    df = spark.createDataFrame(
        [("1", "https://www.legislation.gov.uk/uksi/1", "Relevant"), ("2", "https://supremecourt.uk/cases", "Relevant"), ("3", "https://gov.uk/hm-revenue-customs/x", "Relevant"),
         ("4", "https://gov.uk/hm-revenue-customsx", "Relevant"), ("5", "https://gov.uk/stored/?utm_x=1", "Relevant"), (" ", "https://a.uk", "Relevant"), ("7", "https://b.uk", None)],
        "id string, url string, verdict string").withColumns(dict(run_id=F.lit("r"), group_id=F.lit("g"), date_confidence=F.lit("High"), k=F.monotonically_increasing_id()))
    stored = spark.createDataFrame([("gov.uk/stored",)], "url_key string")
    accepted, rejected = G.gate(df, stored, G.authority_rules(spark), "url", ["k"])
    assert {r.id: r.level_of_authority for r in accepted.collect()} == {"1": "Legislation", "2": "CourtRuling", "3": "RegulatorGuidance", "4": "Unknown"}
    assert {r.id: r.issues for r in rejected.collect()} == {"5": ["already stored"], " ": ["id is required"], "7": ["verdict is required"]}
    best = G.by_authority(accepted, ["run_id"], "id").head()
    assert (best.id, best.authority_rank) == ("1", 3)


def test_learnings(spark):
    rows = [(str(i), "UK" if i % 2 else "uk ", "g", "Approved" if i != 8 else "Pending", "2026", dt.datetime(2026, 1, 1 + i)) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, jurisdiction string, group_id string, review_status string, date_range string, completed_at timestamp")
    assert [r.id for r in L.approved_top(df).orderBy("recency_rank").collect()] == ["7", "6", "5", "4", "3"]
    assert [r.id for r in L.latest_per_scan(df).collect()] == ["8"]
