import time

import pytest
from pyspark.sql import functions as F

from farsight.functions.html import decode_body, read_page
from farsight.schemas import FETCHED_PAGES
from farsight.sources.pages import admit, clean_html

# A harbour notice: a meta date, a time element, terms with and without dates, and dates that no label announces.
NOTICE = """<html><head><title>Quay 7</title><meta property="notice:valid" content="3 March 2031, 08:30">
<meta name="berths" content="12"></head><body><aside>Tide table of 1999-09-09</aside>
<section><h2>Dredging</h2><article>Ships over 40 m wait outside. <time datetime="2031-02-27T06:00Z">last Thursday</time>
<p>Pilots &amp; tugs are free.</p></article></section>
<dl><dt>Depth</dt><dd>9 metres</dd><dt>Ends:</dt><dd>04/30/2031 at noon</dd><dd>or 2031/05/02</dd></dl>
<form>Subscribe since 2001-01-01</form></body></html>"""


def texts(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.cleaned_text for r in clean_html(df).orderBy("i").collect()]


def test_dates_come_from_the_whole_page_and_text_from_its_root(spark):
    assert texts(spark, NOTICE) == [
        "Dates found on page:\n- notice:valid: 2031-03-03\n- date: 2031-02-27\n- Ends: 2031-04-30\n\n"
        "Ships over 40 m wait outside. last Thursday Pilots & tugs are free."
    ]


@pytest.mark.parametrize("unit", ["<x", "<a ", "<dd>", "<dd>x", '<a href="', '<a "x>"', "<!--", "<!x", "<script>", "<dt>a", "<div><dl>", "</p>", "<a x='\"'", "&amp"])
def test_malformed_markup_takes_linear_time(unit):
    began = time.process_time()
    read_page(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 12


def test_roots_boilerplate_and_entities(spark):
    cases = {
        "<html><head><style>.x{}</style></head><body><nav>Home</nav><script>t('</p>')</script><main><h1>VAT</h1><p>rate\n  up</p></main><footer>(c)</footer></body></html>": "VATrate up",
        "<body>a<article>b</article><main>c</main><main>d</main></body>": "c",
        "<body>a<article>b</article></body>": "b",
        "<body>x <!-- <main>no</main> --> y</body>": "x y",
        "plain &amp; &pound;5 &#8364; &#x41; &unknown; &amp": "plain & £5 € A &unknown; &amp",
        "<body><nav><main>hidden</main></nav>shown": "shown",
        "<body><header>a<header>b</header>c</header>d</body>": "d",
        "<body><p>one<p>two<svg><title>t</title></svg></body>": "onetwo",
        "<body><a title='x>y' href=\"a>b\">t</a> <template>no</template><input value=1>z</body>": "t z",
        "<body><header>Tides</header><nav><a>Ports</a></nav><footer>2026</footer></body>": "",
        "<main>never closed": "never closed",
        "<time datetime='2025-01-02'></time>": "Dates found on page:\n- date: 2025-01-02",
    }
    assert texts(spark, *cases) == list(cases.values())
    assert texts(spark, None, "  ") == ["", ""]


def test_definition_takes_the_nearest_earlier_sibling_term():
    _, dates = read_page(
        "<dl><dd>2025-01-01</dd><dt>A</dt><dt>B :</dt><dd>2025-01-02</dd><dd>2025-01-03</dd></dl><dl><dd>2025-01-04</dd></dl><dl><dt>a</dt><dd>2025-01-02</dd><dt>b</dt><dd>2 January 2025</dd></dl>"
    )
    assert [(d["label"], d["date"]) for d in dates] == [
        ("", "2025-01-01"), ("B", "2025-01-02"), ("B", "2025-01-03"), ("", "2025-01-04"), ("a", "2025-01-02")]


def page(url, status=200, kind="text/html; charset=utf-8", length=None, body=b"<body><main>text</main></body>"):
    return (url, status, kind, length, bytearray(body))


def test_admission_never_drops_a_hit(spark):
    pages = spark.createDataFrame([
        page("https://a/ok"), page("https://a/404", status=404), page("https://a/json", kind="application/json"), page("https://a/nokind", kind=None),
        page("https://a/declared", length=99999), page("https://a/big", body=b"<main>" + b"x" * 2000), page("https://a/blank", body=b"<nav>only</nav>"),
        page("https://a/twice"), page("https://a/twice", status=500), page("https://a/pdf", kind="application/pdf", body=b" pdf <b> text "),
        page("ftp://a/file"), page("https://a/unasked", body=b"<main>never read</main>"),
    ], FETCHED_PAGES)
    urls = ["https://a/ok", "https://a/404", "https://a/json", "https://a/nokind", "https://a/declared", "https://a/big", "https://a/blank", "https://a/twice",
            "https://a/pdf", "ftp://a/file", "not a url", "https://a/missing", "https://a/ok"]
    hits = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    got = [(r.fetch_reason, r.cleaned_text) for r in admit(hits, pages, 1000).orderBy("i").collect()]
    assert got == [(None, "text"), ("status", None), ("content_type", None), ("content_type", None), ("declared_size", None), ("actual_size", None),
                   ("blank_text", None), (None, "text"), (None, "pdf <b> text"), ("not_http", None), ("not_http", None), ("not_fetched", None), (None, "text")]


def test_charsets(spark):
    cases = [
        ("£é".encode("utf-8"), "text/html", "£é"), ("£é".encode("latin-1"), "text/html; charset=ISO-8859-1", "£é"),
        ("£é".encode("utf-16-le"), 'text/html; charset="utf-16"', "£é"), ("£é".encode("utf-32-be"), "text/html; charset=utf-32be", "£é"),
        (b"a\xa3b", "text/html; charset=us-ascii", "a?b"), (b"a\xffb", "text/html; charset=nonsense", "a�b"), ("é".encode(), None, "é"),
        (b"\x00\xd8a", "text/html; charset=utf-16", "�"),
    ]
    df = spark.createDataFrame([(i, bytearray(b), k) for i, (b, k, _) in enumerate(cases)], "i int, b binary, k string")
    got = [r.t for r in df.select("i", decode_body(F.col("b"), F.col("k")).alias("t")).orderBy("i").collect()]
    assert got == [t for _, _, t in cases]


def test_whole_tags_are_read_by_one_match_and_others_as_before():
    from farsight.functions import html as H

    assert H.WHOLE_TAG.match("<a href='x>y' b>z").group(2, 3) == ("a", " href='x>y' b")
    tags = lambda page: [(t, a) for _, _, _, t, a in H.Markup(page)]
    assert tags("<p><!-- <b> --><a b=\">\"><i c='>") == [("p", ""), (None, ""), ("a", ' b=">"'), ("i", " c='")]
    assert H.leading_iso("Sun 3 Jun 2001") == "2001-06-03" and H.leading_iso(" 2020/1/2 x") == "2020-01-02" and H.leading_iso("(1 May 2020)") is None
