"""Pages whose hidden elements are left open."""

import time

import pytest

from farsight.llm.dom import attribute_tokens, parse


def lines(html):
    return [t for _, t in parse(html).lines]


@pytest.mark.parametrize("start", ["<body>", "<body class=x><article>", "<article>", "<p>", "<a href=x>", "<span>", "<img src=x>", "", "<br>"])
def test_head_without_an_end_tag_hides_no_text(start):
    page = f"<html><head><meta charset=utf-8><title>t</title><style>a{{}}</style><link rel=x>\n<script>s</script>{start}One<p>two"
    assert lines(page) == ["One", "two"]


def test_head_with_an_end_tag_stays_hidden():
    assert lines("<html><head>\n<title>t</title><noscript><p>n</p></noscript>\n<meta name=a></head><body><p>one</p></body></html>") == ["one"]


@pytest.mark.parametrize("name", ["select", "datalist", "object", "canvas"])
def test_hidden_elements_without_an_end_tag_hide_no_text(name):
    assert lines(f"<div><{name}><p>one</p><p>two</p></div><p>three") == ["one", "two", "three"]
    assert lines(f"<{name}><p>one</p><{name} id=a><p>no</p></{name}><p>two</p>") == ["one", "two"]
    assert lines(f"<p>one</p><{name}><p>no</p></{name}><p>two</p>") == ["one", "two"]


@pytest.mark.parametrize("unit", ["<head>", "<head><p>", "<select>", "<select><option>", "<object></canvas>", "<canvas></canvas>"])
def test_open_hidden_elements_take_linear_time(unit):
    began = time.process_time()
    parse(unit * (300_000 // len(unit)))
    assert time.process_time() - began < 15


def test_all_words_of_an_attribute_are_tokens():
    names = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)]
    assert attribute_tokens(f' class="{" ".join(names)} sidebar"') == (*names, "sidebar")
