import datetime as dt

from farsight.schemas import REQUESTS
from farsight.sources import requests as Q

T0 = dt.datetime(2026, 7, 1)


def request(spark, rows):
    return spark.createDataFrame([(r, j, s, e, T0, g) for r, j, s, e, g in rows], REQUESTS)


def test_groups_split_name_and_order(spark):
    df = request(spark, [("r", "UK", None, None, ["Employee NIC,  Income Tax , ITEPA 2003 , employee nic", " , ", "b", "Income Tax,ITEPA 2003,Employee NIC"])])
    groups = Q.topic_groups(df).orderBy("group_ord").collect()
    assert [g.group_name for g in groups] == ["Employee NIC, Income Tax, ITEPA 2003", "b", "Income Tax, ITEPA 2003, Employee NIC"]
    assert groups[0].group_id.startswith("employee-nic-") and groups[0].max_loops == 3
    # the hash is over the set, the slug over the first keyword
    assert groups[0].group_id.rsplit("-", 1)[1] == groups[2].group_id.rsplit("-", 1)[1]


def test_equal_groups_get_suffixes_in_request_order(spark):
    n = 40
    df = request(spark, [("r", "UK", None, None, ["a, b"] * n), ("q", "UK", None, None, ["a,b"])])
    rows = {(g.run_id, g.group_ord): g.group_id for g in Q.topic_groups(df).collect()}
    base = rows["r", 0]
    assert rows["q", 0] == base
    assert [rows["r", i] for i in range(n)] == [base] + [f"{base}-{i}" for i in range(2, n + 1)]


def test_group_id_without_slug(spark):
    group = Q.topic_groups(request(spark, [("r", "UK", None, None, ["éé"])])).head()
    assert group.group_id.startswith("group-")


def test_request_checks(spark):
    d = dt.date
    df = request(spark, [
        ("ok", "UK", d(2025, 1, 1), d(2025, 1, 1), ["a"]), ("dates", "UK", d(2025, 2, 1), d(2025, 1, 1), ["a"]), ("short", "U", None, None, ["a"]),
        ("blank", "  ", None, None, ["a"]), ("none", "UK", None, None, []), ("null", "UK", None, None, None), ("entry", "UK", None, None, ["a", " "]),
        ("long", "x" * 101, None, None, ["a"]),
    ])
    valid, bad = Q.split_requests(df)
    assert [r.run_id for r in valid.collect()] == ["ok"]
    assert {r.run_id: sorted({i["property"] for i in r.issues}) for r in bad.collect()} == {
        "dates": ["EndDate"], "short": ["Jurisdiction"], "blank": ["Jurisdiction"], "none": ["TopicGroups"], "null": ["TopicGroups"],
        "entry": ["TopicGroups"], "long": ["Jurisdiction"]}
    report = {r.run_id: r.errors for r in Q.issue_report(Q.check_requests(df)).collect()}
    assert report["none"] == {"TopicGroups": ["At least one topic group must be selected."]}


def test_blank_property_reports_as_validation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("", "m1"), ("X", "m2")], "p string, m string")
    checked = df.select(F.lit("r").alias("run_id"), F.array(F.struct(F.col("p").alias("property"), F.col("m").alias("message"))).alias("issues"))
    assert {r["property"]: r.n for r in Q.issue_counts(checked).collect()} == {"validation": 1, "X": 1}


def test_written_dates_are_typed_or_rejected(spark):
    rows = [("a", "2025-06-15T23:30:00+05:00", None), ("b", None, "2025-06-15"), ("c", "15/06/2025", None), ("d", "2025-06-15", " ")]
    good, bad = Q.read_request_dates(spark.createDataFrame(rows, "run_id string, start_date string, end_date string"))
    assert {r.run_id: (r.start_date, r.end_date) for r in good.collect()} == {"a": (dt.date(2025, 6, 15), None), "b": (None, dt.date(2025, 6, 15))}
    assert sorted(r.run_id for r in bad.collect()) == ["c", "d"]
