"""The inverted index against a plain reading of every document, and what a search leaves closed."""

import random

import pytest
from pyspark.sql import functions as F

from farsight.session import stage_dir, staged
from farsight.sources import corpus as C

WORDS = [f"w{k}" for k in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(40)], k=rng.choice([0, 3, 10, 200]))), f"h{k % 3}") for k in range(1500)]
    rows += [(5000, None, "h0"), (5001, "", None), (5002, "W1, w2! w1", None)]
    return rows, staged(spark.createDataFrame(rows, "doc_id long, text string, host string"), stage_dir(spark, "docs"))


def plain(rows, query, k, boost):
    asked = set(query.lower().split())
    found = []
    for doc_id, text, _ in rows:
        words = [w.strip(",!") for w in (text or "").lower().split()]
        hits = [w for w in words if w in asked]
        if hits:
            found.append((-boost.get(doc_id, 0), -len(set(hits)), -len(hits), doc_id))
    return [(d, -b, -t, -m) for b, t, m, d in sorted(found)[:k]]


@pytest.mark.parametrize("boosted, block_docs, near", [(False, 16, None), (True, 16, "host"), (False, 100_000, "host"), (True, 1, None)])
def test_search_equals_a_reading_of_every_document(spark, docs, boosted, block_docs, near):
    rows, table = docs
    queries = ["w1 w2", "W39", "w0 w0 w39 w20", "absent", "w30 w31 w32 w33 w34"]
    boost = {k: k % 3 - 1 for k in range(0, 1500, 7)} if boosted else {}
    boosts = spark.createDataFrame(list(boost.items()), "doc_id long, boost int") if boosted else None
    index = C.build_index(table, "doc_id", "text", stage_dir(spark, "index"), near=F.col(near) if near else None, block_docs=block_docs)
    asked = spark.createDataFrame([(q, q) for q in queries], "name string, query string")
    found = C.search_index(index, asked, ["name"], 5, boosts).collect()
    for q in queries:
        got = sorted((r.rank, r.doc_id, r.boost, r.matched_terms, r.matches) for r in found if r.name == q)
        assert [g[1:] for g in got] == plain(rows, q, 5, boost), q


def test_fewer_documents_are_scored_than_match(spark, docs):
    index = C.build_index(docs[1], "doc_id", "text", stage_dir(spark, "index"), block_docs=16)
    asked = spark.createDataFrame([("w0 w1",)], "_query string")
    terms = C.query_terms(asked, ["_query"], "_query")
    postings = C._of_terms(index, terms)
    bounds = C.block_bounds(index, postings, terms, None)
    opened = C.open_blocks(postings, terms, bounds, 5, None)
    scored, matched = (C.block_scores(postings, terms, b, None).count() for b in (opened, bounds))
    assert 5 <= scored < matched / 2


def test_only_the_slots_of_the_terms_are_read(spark, docs):
    index = C.build_index(docs[1], "doc_id", "text", stage_dir(spark, "index"))
    terms = C.query_terms(spark.createDataFrame([("w3",)], "_query string"), ["_query"], "_query")
    plan = C._of_terms(index, terms).select("term", "block", "most")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "slot" in plan.split("PartitionFilters")[1] and "docs" not in plan.split("ReadSchema")[1]


def test_words_are_counted_where_a_block_is(spark, docs):
    """One shuffle, of texts, and no row per word and document; a row per word and block comes out."""
    texts = docs[1].select("doc_id", (F.col("doc_id") % 3).alias("block"), F.col("text").alias("_text"))
    posted = C._all_postings(texts)
    plan = posted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    counted = texts.select("doc_id", "block", F.explode(C.tokens(F.col("_text"))).alias("term")).groupBy("block", "term", "doc_id").count()
    found = posted.select("block", "term", "most", "n_docs", F.explode("docs").alias("d")).select("block", "term", "d.doc_id", "d.n", "most", "n_docs").collect()
    assert sorted(r[:4] for r in found) == sorted(map(tuple, counted.collect()))
    for r in found:
        mine = [x.n for x in found if (x.block, x.term) == (r.block, r.term)] if r.doc_id % 100 == 0 else [r.most] * r.n_docs
        assert (max(mine), len(mine)) == (r.most, r.n_docs)


def test_repeated_and_null_ids_are_one_document_of_their_block(spark):
    texts = spark.createDataFrame([(None, 7, "a b a"), (None, 7, "a"), ("x", 7, "b"), ("x", 7, None), ("x", 7, "b B"), ("y", 8, " ")], "doc_id string, block long, _text string")
    found = {(r.block, r.term, r.most, r.n_docs): sorted((str(d.doc_id), d.n) for d in r.docs) for r in C._all_postings(texts).collect()}
    assert found == {(7, "a", 3, 1): [("None", 3)], (7, "b", 3, 2): [("None", 1), ("x", 3)]}


def test_long_documents_share_fewer_blocks(spark):
    long = spark.range(40).select("id", F.repeat(F.lit("word "), 100_000).alias("text"))
    index = C.build_index(long, "id", "text", stage_dir(spark, "index"))
    assert index.placed.select("block").distinct().count() > 1
    assert index.postings.agg(F.sum("n_docs")).head()[0] == 40 and index.postings.select("term", "most").distinct().collect() == [("word", 100_000)]
