"""Neighbours, forms and roots against all pairs, and the filters by themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from farsight.llm import spelling
from farsight.llm.registry import ORACLES, QUERIES
from workload.compare import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def random_words(rng, n, letters="abcéÿ×Þ"):
    return {"".join(rng.choices(letters, k=rng.randint(7, 9))) for _ in range(n)}


def pairs(spark, words, **bounds):
    table = spark.createDataFrame(sorted(words.items()), "word string, n long")
    return {(r.word, r.other): (r.n, r.other_n) for r in spelling.near_pairs(table, **bounds).collect()}


@pytest.mark.parametrize("bounds", [{}, {"segment": 50, "limit": 120}, {"segment": 7, "limit": 7}])
def test_pairs_equal_all_pairs_in_any_number_of_rounds(llm, bounds):
    rng = random.Random(3)
    words = {w: rng.randint(2, 99) for w in random_words(rng, 500, "aabé" if "limit" in bounds else "abcéÿ×Þ")}
    if bounds.get("limit") == 7:
        words = dict(list(words.items())[:60])
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_apart(a, b)}
    found = pairs(llm, words, **bounds)
    assert len(found) == len(want) and {frozenset(p) for p in found} == want
    assert all((words[a], words[b]) == n for (a, b), n in found.items())


def test_rounds_hold_every_filter_once():
    segments, rounds = spelling.rounds_of({7: 1000, 8: 30, 64: 5}, segment=100, limit=250)
    assert segments == {7: 10, 8: 1, 64: 1}
    assert sorted(p for r in rounds for p in r) == sorted([(7, s) for s in range(10)] + [(8, 0), (64, 0)])
    assert all(sum({7: 100, 8: 30, 64: 5}[c] for c, _ in r) <= 250 for r in rounds)


def test_filters_hold_their_words_and_few_others():
    rng = random.Random(4)
    inside, outside = (["".join(rng.choices("abcdefgh", k=10)) for _ in range(20_000)] for _ in range(2))
    filters = spelling.Filters({10: 1}, {(10, 0): spelling.make_filter(spelling.hashes(inside))})
    assert len(filters.holds(10, spelling.hashes(inside))) == len(inside)
    wrong = len(filters.holds(10, spelling.hashes(sorted(set(outside) - set(inside)))))
    assert wrong < 0.005 * len(outside)
    assert len(filters.holds(11, np.zeros(3, np.uint64))) == 0


def test_long_words_share_filters(llm):
    long = "ab" * 5000
    words = {"x" * 63: 2, "x" * 64: 3, "x" * 65: 4, "y" * 66: 5, "y" * 65 + "z": 6, long: 7, long[1:]: 8, long + "c": 9}
    assert {frozenset(p) for p in pairs(llm, words)} == {frozenset(p) for p in [("x" * 63, "x" * 64), ("x" * 64, "x" * 65), ("y" * 66, "y" * 65 + "z"), (long, long[1:]), (long, long + "c")]}


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words.get(form[w])


def test_forms_and_roots_equal_all_pairs(llm):
    rng = random.Random(5)
    chain = ["lettersA"[:7] + c for c in "abcd"]  # one apart each; frequencies decide
    texts = [" ".join(rng.choices(sorted(random_words(rng, 40, "abéZÞ")), k=30)) for _ in range(60)]
    texts += [" ".join([w] * n) for w, n in zip(["longword", "longworda", "longwordab", "longwordabc"], [3000, 250, 20, 2])]
    texts += [" ".join([w] * n) for w, n in zip(chain, [500, 500, 40, 2])]
    texts += [None, "", "short runs only", "ÀÉÎÕÜßé×÷ " * 3, "İstanbulſ Kelvin"]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(77, "Repeated rows, repeated rows")] * 3
    docs = llm.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    found = sorted(map(repr, (tuple(r) for r in spelling.group_variants(docs).collect())))
    want = list(plain(rows))
    assert found == sorted(map(repr, want))
    assert next(r for r in want if r[0] == "longwordabc")[1:3] == ("longwordab", "longword")
    assert next(r for r in want if r[0] == chain[2])[1] == chain[0]


def test_odd_rows(odd, none):
    out = {r.word: r.n for r in spelling.group_variants(odd).collect()}
    assert set(out) <= {"x" * 30_000, "x" * 29_999} and spelling.group_variants(none).count() == 0


def test_query_equals_its_sql(llm):
    assert rows_of_spark(QUERIES["op12_spelling_variants"](llm, SF)) == rows_of_sql(connect(SF), ORACLES["op12_spelling_variants"])
