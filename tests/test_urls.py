import pytest
from pyspark.sql import functions as F

from farsight.functions.urls import allowlist_host, is_absolute_http, stable_id, url_key

SAME = [
    ("https://www.gov.uk/page", "https://gov.uk/page"),
    ("https://gov.uk/page/", "https://gov.uk/page"),
    ("https://GOV.uk/Page", "https://gov.uk/page"),
    ("https://gov.uk/page#section", "https://gov.uk/page"),
    ("https://gov.uk/page?utm_source=x", "https://gov.uk/page"),
    ("https://gov.uk/page?a=1&b=2", "https://gov.uk/page?b=2&a=1"),
    ("http://user:pw@gov.uk:8080//page//", "https://gov.uk//page"),
    ("https://gov.uk/a/./b/../page", "https://gov.uk/a/page"),
    ("https://gov.uk/a page", "https://gov.uk/a%20page"),
    ("https://gov.uk/café", "https://gov.uk/caf%C3%A9"),
    ("  https://gov.uk  ", "https://gov.uk/?_ga=1&GCLID=2"),
]
DIFFERENT = [
    ("https://gov.uk/page?id=1", "https://gov.uk/page?id=2"),
    ("https://gov.uk/page?ga=1", "https://gov.uk/page"),
    ("https://gov.uk/page", "https://www2.gov.uk/page"),
]
INVALID = ["mailto:someone@gov.uk", "ftp://gov.uk/file", "/relative/path", "not a url", "", "  ",
           "https://", "https://www./x?y", "http://host:port/", None]


def keys(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    return [r[0] for r in df.select(url_key(F.col("url"))).collect()]


def test_equivalent_forms_share_a_key(spark):
    got = keys(spark, [u for pair in SAME for u in pair])
    assert [(a, b) for a, b in zip(got[::2], got[1::2]) if a != b or a is None] == []


def test_distinct_pages_keep_distinct_keys(spark):
    got = keys(spark, [u for pair in DIFFERENT for u in pair])
    assert all(a != b for a, b in zip(got[::2], got[1::2]))


def test_invalid_urls_have_no_key(spark):
    assert [k for k in keys(spark, INVALID) if k not in (None, "")] == []


def test_query_is_sorted_before_lower_casing(spark):
    assert keys(spark, ["https://h/p?b=1&B=2&a=3"]) == ["h/p?b=2&a=3&b=1"]


def test_stable_id_is_not_the_canonical_key(one):
    a, b, c = one(
        stable_id(F.col("a")), stable_id(F.col("b")), stable_id(F.col("c")),
        a=" HTTPS://Gov.uk/x ", b="https://gov.uk/x", c="https://www.gov.uk/x",
    )
    assert a == b != c and len(a) == 16


@pytest.mark.parametrize(
    "entry, host",
    [("https://www.gov.uk/x", "gov.uk"), (" WWW.gov.uk/ ", "gov.uk"), ("gov.uk/hm-revenue-customs", "gov.uk/hm-revenue-customs"), (" ", None), (None, None)],
)
def test_allowlist_entries(one, entry, host):
    assert one(allowlist_host(F.col("e")), e=entry) == host


def test_absolute_http_does_not_trim(one):
    assert one(is_absolute_http(F.col("a")), is_absolute_http(F.col("b")), a="https://x/y", b=" https://x/y") == (True, False)
