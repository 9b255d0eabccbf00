import datetime as dt

import pytest
from pyspark.sql import functions as F

from farsight.functions.dates import (
    dates_line, leading_date, lenient_date, outside_window, strict_iso_date, window_end, window_text,
)
from farsight.functions.html import leading_iso
from farsight.functions.text import (
    distinct_ignore_case, document_clip, fallback_query, ratio, split_list, text_budget, trim_to_null,
)
from farsight.functions.verdicts import is_degradable, parse_confidence, parse_decision, parse_verdict

DAY = dt.date(2025, 6, 15)


@pytest.mark.parametrize(
    "text, date",
    [("2025-06-15", DAY), (" 15 June 2025 ", DAY), ("15 Jun 2025", DAY), ("June 15, 2025", DAY), ("06/15/2025", DAY),
     ("2025/6/15", DAY), ("Sunday, 15 June 2025", DAY), ("2025", None), ("", None), ("soon", None), ("2025-02-31", None), (None, None)],
)
def test_lenient_date(one, text, date):
    assert one(lenient_date(F.col("x")), x=text) == date


@pytest.mark.parametrize(
    "text, ok",
    [("2025-06-15", True), ("2025-06-15T00:00:00Z", True), ("2025-06-15T23:30:00+05:00", True), ("2025-06-15T01:30:00+05:00", True),
     ("2025-06-15T08:15:42", True), ("2025-6-15", False), ("15/06/2025", False), ("", False), ("2025-13-01", False)],
)
def test_strict_date_keeps_the_written_day(one, text, ok):
    assert one(strict_iso_date(F.col("x")), x=text) == (DAY if ok else None)


@pytest.mark.parametrize(
    "text, iso",
    [("15 July 2026 - See all updates", "2026-07-15"), ("2014-05-22T10:00:00+01:00", "2014-05-22"), ("22 May 2014", "2014-05-22"),
     ("on 15 July 2026", None), ("15 July 1850", None), ("width=device-width, initial-scale=1", None), ("d9080621-ed20-5412", None), ("4 items", None),
     ("July 15, 2026 (latest)", "2026-07-15"), ("2026-07-15xyz", None)],
)
def test_leading_date_in_both_forms(one, text, iso):
    got = one(leading_date(F.col("x")), x=text)
    assert (got and got.isoformat()) == iso
    assert leading_iso(text) == iso


def test_words(one):
    assert one(
        parse_verdict(F.col("a")), parse_verdict(F.col("b")), parse_verdict(F.col("c")), parse_decision(F.col("d")),
        parse_decision(F.col("e")), parse_confidence(F.col("f")), parse_confidence(F.lit(None).cast("string")),
        a=" relevant", b="not relevant", c="??", d="Finalise ", e="go", f="medium",
    ) == ("Relevant", "NotRelevant", "Borderline", "Finalize", "Retry", "Medium", "Unknown")


def test_degradable(spark):
    rows = [(0, None), (408, None), (429, None), (503, None), (400, None), (404, None), (400, True), (None, None)]
    df = spark.createDataFrame(rows, "status int, bad boolean")
    got = [r[0] for r in df.select(is_degradable(F.col("status"), F.col("bad"))).collect()]
    assert got == [True, True, True, True, False, False, True, None]


def window(one, conf, pub=None, eff=None, app=None, lower="2025-01-01", upper="2025-12-31"):
    d = lambda n: F.col(n).cast("date")
    return one(outside_window(d("p"), d("e"), d("a"), F.col("c"), d("l"), d("u")), p=pub, e=eff, a=app, c=conf, l=lower, u=upper)


@pytest.mark.parametrize(
    "args, out",
    [(dict(conf="High", pub="2026-01-01"), True), (dict(conf="Low", pub="2026-01-01"), False), (dict(conf="Unknown", pub="2020-01-01"), False),
     (dict(conf="Medium", pub="2024-12-31"), True), (dict(conf="High", pub="2025-01-01"), False), (dict(conf="High", pub="2025-12-31"), False),
     (dict(conf="High", eff="2030-01-01"), False), (dict(conf="High", eff="2017-04-06"), True), (dict(conf="High", app="2017-04-06"), True),
     (dict(conf="High", pub="2025-05-01", eff="2017-04-06"), False), (dict(conf="High"), False), (dict(conf="High", pub="1999-01-01", lower=None), False),
     (dict(conf=None, pub="1999-01-01"), False)],
)
def test_date_window(one, args, out):
    assert window(one, **args) is out


def test_window_text_and_end(one):
    end = window_end(F.col("e").cast("date"), F.col("s").cast("timestamp"))
    assert one(window_text(F.col("b").cast("date"), end), e=None, s="2026-07-01 23:59:00", b="2026-01-01") == "2026-01-01 to 2026-07-01"
    assert one(window_text(F.col("b").cast("date"), end), e="2026-06-30", s="2026-07-01", b=None) == "on or before 2026-06-30"


def test_dates_line(one):
    d = lambda n: F.col(n).cast("date")
    line = dates_line(d("p"), d("e"), d("f"), d("t"))
    assert one(line, p="2025-06-15", e=None, f="2026-04-06", t="2027-04-05") == "published 2025-06-15, applies from 2026-04-06, applies to 2027-04-05"
    assert one(line, p=None, e=None, f=None, t=None) is None


def test_lists_keep_first_spelling_and_order(one):
    assert one(split_list(F.col("x")), x="Employee NIC,  Income Tax , ITEPA 2003 ,, employee nic") == ["Employee NIC", "Income Tax", "ITEPA 2003"]
    assert one(split_list(F.col("x")), x=None) == []
    assert one(distinct_ignore_case(F.split("x", ";")), x="b;A;B;a;c") == ["b", "A", "c"]


def test_trim_covers_all_white_space(one):
    assert one(trim_to_null(F.col("x")), x="   x　\n") == "x"
    assert one(trim_to_null(F.col("x")), x=" \t\r\n ") is None


def test_clip_and_budget(spark, one):
    assert one(document_clip(F.col("x"), 5), document_clip(F.col("y"), 5), document_clip(F.col("z"), 5), x="  abcdefg ", y="abc ", z=" \n") == (
        "abcde\n[...truncated...]", "abc", "(no text available)")
    df = spark.createDataFrame([(0,), (1,), (7,), (24,), (1000,)], "n int")
    assert [r[0] for r in df.select(text_budget(F.col("n"))).collect()] == [48000, 48000, 6857, 2000, 2000]


def test_ratio_and_fallback_query(spark, one):
    df = spark.createDataFrame([(0, 0), (4, 5)], "a int, b int")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"), 1.0)).collect()] == [1.0, 0.8]
    assert one(fallback_query(F.split("k", ","), F.col("n"), F.col("j")), k="NIC,PAYE", n="g", j="UK") == "NIC UK update"
    assert one(fallback_query(F.array().cast("array<string>"), F.col("n"), F.col("j")), n="g", j="UK") == "g UK update"


def test_leading_date_is_read_however_long_the_text(one):
    for text in ("2024-03-05T10:11:12." + "0" * 120 + "Z later", " " * 300 + "5 March 2024 " + "x" * 500, "5" + " " * 200 + "March 2024 on", "x" * 100 + " 2024-03-05"):
        assert one(leading_date(F.col("x")).cast("string"), x=text) == leading_iso(text)
