"""Main-text extraction: rebuilt pages, hostile markup, odd rows."""

import pickle
import random
import time
from collections import Counter

import pytest

from farsight.llm import extract
from farsight.llm.dom import parse

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return extract.fit(pages[:120])


def test_lines_and_references():
    page = parse("<p>One &amp; two<b> three\n four</b><br>five<p>six&nbsp;<i>seven</i><div>eight</div>nine<script>no</script><!-- no --> ten < eleven")
    assert [t for _, t in page.lines] == ["One & two three four five", "six seven", "eight", "nine ten < eleven"]


def test_held_out_pages_give_their_article(pages, model):
    for html, text in zip(pages[120:], extract.extract_pages(pages[120:], model)):
        page = parse(html)
        labels = extract.marked_labels(page)
        assert text == "\n".join(t for k, t in page.lines if labels[k] == 1)


def test_rebuilt_pages_of_unseen_text(pages, model):
    rng = random.Random(99)
    parts = [extract._parts(parse(h)) for h in pages[120:]]
    strange = [t for _, p, o in parts for t in (*o, *p[:3])]
    good = kept = wanted = 0
    for title, paragraphs, _ in parts:
        html, lines = extract.rebuild(title, paragraphs[: rng.randint(1, 12)], strange, rng)
        got, want = Counter(extract.extract_pages([html], model)[0].split("\n")), Counter(" ".join(x.split()) for x in lines)
        good += sum(len(k) * n for k, n in (got & want).items())
        kept += sum(len(k) * n for k, n in got.items())
        wanted += sum(len(k) * n for k, n in want.items())
    assert good / kept > 0.97 and good / wanted > 0.97


def test_decoding_has_no_main_node_below_another_kind(model):
    rng = random.Random(1)
    page = parse("<div><p>a</p><div><p>b</p><section><p>c</p></section></div></div><div><p>d</p></div>" * 5)
    for _ in range(50):
        import numpy as np

        keep = extract.decode(page, np.array([rng.random() for _ in page.nodes]))
        state = {k: keep[k] for k in range(len(keep))}
        for k, node in enumerate(page.nodes):
            above, seen_main, seen_other = node.parent, False, False
            while above >= 0:
                seen_main |= state[above]
                seen_other |= seen_main and not state[above]
                above = page.nodes[above].parent
            # Going up from a main node: main nodes, then mixed ones; never main again.
            if state[k] and node.parent >= 0 and not state[node.parent]:
                assert not seen_main


@pytest.mark.parametrize("unit", ["<x", "<a ", "<dd>", "<div><b><p>", '<a href="', "<!--", "<script>", "&amp", "<p><b>", "</p>", "<a x='\"'", "<li><ul>", "<"])
def test_hostile_markup_takes_linear_time(model, unit):
    began = time.process_time()
    extract.extract_pages([unit * (300_000 // len(unit))], model)
    assert time.process_time() - began < 15


def test_odd_rows(llm, model):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "no markup at all", "t"), (2, "v", "\x00<", "t"), (2, "v", "\x00<", "t")]
    frame = llm.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract.extract(frame, pickle.dumps(model))
    assert out.columns == ["page_id", "url", "text"] and out.count() == 5
    assert {r.text for r in out.where("page_id = 1").collect()} == {""}
    assert extract.extract(frame.limit(0), extract.train(frame.limit(0))).count() == 0


def test_query_returns_every_page(llm):
    from farsight.llm.registry import QUERIES

    got = QUERIES["op9_extract"](llm, SF).collect()
    assert len(got) == 250 and all(r.n_chars == len(r.text) > 0 for r in got)
