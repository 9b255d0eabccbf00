"""Hashed phrase matching against a plain search of the words."""

import random

from farsight.operators.phrases import find_phrases


def test_equals_a_search_of_the_joined_words(spark):
    rng = random.Random(6)
    words = ["a", "b", "ab", "ü", "Ö1", "the"]
    texts = [(k, " , ".join(rng.choices(words, k=rng.choice([0, 1, 2, 7, 60])))) for k in range(200)] + [(900, None), (901, " .;"), (902, "a " * 5000 + "end")]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(150)} | {"a a a", "a a a a a a a", "A  B!", "", "...", "end", "a end"}
    terms = spark.createDataFrame([(p, k) for k, p in enumerate(sorted(phrases))], "name string, term_id int")
    found = {(r.id, r.term_id): r.at for r in find_phrases(spark.createDataFrame(texts, "id int, t string"), ["id"], "t", terms).collect()}
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = {}
    for i, text in texts:
        for k, phrase in enumerate(sorted(phrases)):
            at = f" {plain(text)} ".find(f" {plain(phrase)} ")
            if plain(phrase) and at >= 0:
                want[i, k] = at + 1
    assert found == want and len(want) > 500


def test_no_terms_and_no_text_in_the_join(spark):
    texts = spark.createDataFrame([(1, "some text here")], "id int, t string")
    assert find_phrases(texts, ["id"], "t", spark.createDataFrame([], "name string")).count() == 0
    terms = spark.createDataFrame([("text here",)], "name string")
    plan = find_phrases(texts, ["id"], "t", terms)._jdf.queryExecution().optimizedPlan()
    joined = plan.toString().split("Join")[1]
    assert "_words" not in joined.split("Generate")[0]


def test_windows_are_not_hashed_row_by_row(spark):
    """Places and windows over texts of several batches and lots, without an array function per word."""
    texts = [(k, " ".join(["filler"] * (k * 131 % 700)) + " alpha beta gamma delta epsilon. ÄÖ beta") for k in range(300)] + [(300, "x " * 70000 + "beta")]
    terms = spark.createDataFrame([("Beta",), ("alpha beta gamma",), ("epsilon äö beta",), ("beta x",)], "name string")
    found = find_phrases(spark.createDataFrame(texts, "id int, t string").coalesce(1), ["id"], "t", terms)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan
    want = set()
    for k, t in texts:
        words = f" {' '.join(t.lower().replace('.', '').split())} "
        want |= {(k, n, words.index(f" {n.lower()} ") + 1) for n in ("Beta", "alpha beta gamma", "epsilon äö beta", "beta x") if f" {n.lower()} " in words}
    assert {(r.id, r.name, r.at) for r in found.collect()} == want
