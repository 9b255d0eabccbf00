"""Corpus search: ranked candidate documents for each (group, query), through an inverted index on disk.

The index holds postings per term in blocks of documents of about one length, each with its greatest count. For a
query, the sums of the greatest counts bound what any document of a block can reach. The blocks that promise most are
scored first; the k-th best document found there is a floor, and blocks whose bound lies below it are never opened.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from farsight.operators.ordinals import top_per
from farsight.session import stage_dir, staged

TOKEN_GAP = r"[^\p{L}\p{N}]+"
# Fixed value: hits kept per query.
MAX_RESULTS = 10
# Documents per block, about, and characters; size classes per factor e of the text length (which has less than 2^31
# characters); and hashes of what documents are near.
BLOCK_DOCS, BLOCK_CHARS, CLASSES, AREAS = 256, 1 << 23, 4, 32

# Send these functions to executors by value, so that they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tokens(text: Column) -> Column:
    """Lower-case words of the whole text."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda t: t != "")


def query_terms(queries: DataFrame, keys: list[str], query: str = "query") -> DataFrame:
    return queries.select(*keys, F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))


# --- the index ----------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """``postings``: (slot, term, block, most, n_docs, docs) with the (doc_id, n) of a block's documents that hold the
    term and the greatest n; ``placed``: (doc_id, block). Slots are hashes of terms and folders on disk."""

    postings: DataFrame
    placed: DataFrame
    slots: int


def _slot(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def _blocks(corpus: DataFrame, doc_id: str, text: str, near: Column, block_docs: int) -> Column:
    """Block of a document: a hash of what it is ``near``, its size class and, where that is many or much, a hash of its id.

    Bounds are tight where documents of a block are alike: those of one language or site use the same words, and how
    often goes with the length. There are less than ``AREAS`` times a hundred such cells, whose counts are collected.
    """
    chars = F.coalesce(F.length(F.col(text)), F.lit(0))
    size = F.floor(F.log(chars + 1) * CLASSES).cast("int")
    cell = F.pmod(F.xxhash64(near), F.lit(AREAS)).cast("int") * 100 + size
    held = {r.cell: max(-(-r.n // block_docs), -(-r.chars // BLOCK_CHARS)) for r in corpus.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(chars).alias("chars")).collect()}
    # Written as one string, which the optimizer folds to an array constant.
    parts = F.split(F.lit(",".join(str(held.get(c, 1)) for c in range(100 * AREAS))), ",").cast("array<int>")
    return (cell.cast("long") * (1 << 40)) + F.pmod(F.xxhash64(doc_id), F.get(parts, cell).cast("long"))


def _block_postings(docs: pa.Table) -> pa.Table:
    """The postings of one block from its (doc_id, block, _terms): a row per word, its documents counted and listed."""
    ids = docs.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
    lists = docs.column("_terms").combine_chunks()
    words, many = lists.flatten().dictionary_encode(), len(ids.dictionary)
    doc = np.repeat(ids.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    pairs, n = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + doc, return_counts=True)
    term, doc = np.divmod(pairs, many)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(first, len(term))
    found = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(doc)), pa.array(n.astype(np.int64))], names=["doc_id", "n"])
    return pa.table({
        "term": words.dictionary, "block": pa.array(np.full(len(first), docs.column("block")[0].as_py(), np.int64)),
        "most": pa.array(np.maximum.reduceat(n, first).astype(np.int64)), "n_docs": pa.array(np.diff(ends).astype(np.int64)),
        "docs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found),
    })


def _all_postings(docs: DataFrame) -> DataFrame:
    """(term, block, most, n_docs, docs) of all words of (doc_id, block, _text).

    Texts are shuffled once, by block, and a block's words are counted together, so no row per word and document is moved
    or sorted by Spark.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    near = docs.repartition("block").sortWithinPartitions("block")
    worded = near.select("doc_id", "block", tokens(F.col("_text")).alias("_terms")).where(F.size("_terms") > 0)
    return worded.groupBy("block").applyInArrow(
        _block_postings, f"term string, block long, most long, n_docs long, docs array<struct<doc_id:{kind},n:long>>")


def _postings_of(docs: DataFrame, only: DataFrame) -> DataFrame:
    """The same of few words: the texts stay where they are; an occurrence is a counted row before it moves."""
    words = docs.select("doc_id", "block", F.explode(tokens(F.col("_text"))).alias("term")).join(only.select("term").distinct(), "term", "left_semi")
    counted = words.groupBy("block", "term", "doc_id").agg(F.count("*").alias("n"))
    return counted.groupBy("term", "block").agg(
        F.max("n").alias("most"), F.count("*").alias("n_docs"), F.collect_list(F.struct("doc_id", "n")).alias("docs"))


def build_index(
    corpus: DataFrame, doc_id: str, text: str, path: str, only: DataFrame | None = None, near: Column | None = None,
    block_docs: int = BLOCK_DOCS,
) -> Index:
    """Writes the index of a corpus with one row per document id below ``path``.

    ``near`` is something that documents with like words share, as a language or a host; it decides which documents
    share blocks, and so how many blocks a search opens, never what it finds. ``only`` (term) leaves out words that no query asks for,
    for an index that serves once. A word in every document is spread over the blocks.
    """
    spark = corpus.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = corpus.select(F.col(doc_id).alias("doc_id"), _blocks(corpus, doc_id, text, F.lit(0) if near is None else near, block_docs).alias("block"), F.col(text).alias("_text"))
    posted = _all_postings(docs) if only is None else _postings_of(docs, only)
    posted = posted.withColumn("slot", _slot(F.col("term"), slots)).repartitionById(slots, "slot")
    posted.sortWithinPartitions("slot", "term", "block").write.mode("overwrite").partitionBy("slot").parquet(f"{path}/postings")
    docs.select("doc_id", "block").write.mode("overwrite").parquet(f"{path}/placed")
    return read_index(spark, path, corpus.schema[doc_id].dataType.simpleString(), slots)


def read_index(spark: SparkSession, path: str, id_type: str, slots: int) -> Index:
    """The index written below ``path`` with as many slots."""
    schema = f"term string, block long, most long, n_docs long, docs array<struct<doc_id:{id_type},n:long>>, slot int"
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), spark.read.schema(f"doc_id {id_type}, block long").parquet(f"{path}/placed"), slots)


# --- search -------------------------------------------------------------------------


def _score(boost: str = "boost") -> Column:
    """What documents are ranked by before their id, as one comparable value."""
    return F.struct(F.col(boost), F.col("matched_terms"), F.col("matches"))


def _of_terms(index: Index, terms: DataFrame) -> DataFrame:
    """Postings of the terms; only their slots are read (there are at most as many as the index has)."""
    slots = [r[0] for r in terms.select(_slot(F.col("term"), index.slots)).distinct().collect()]
    return index.postings.where(F.col("slot").isin(slots))


def block_bounds(index: Index, postings: DataFrame, terms: DataFrame, boost: DataFrame | None) -> DataFrame:
    """(_query, block) with what no document of the block exceeds: boost, matched_terms and matches; n_docs that match at least."""
    heads = postings.select("term", "block", "most", "n_docs")
    bounds = heads.join(terms, "term").groupBy("_query", "block").agg(
        F.count("*").alias("matched_terms"), F.sum("most").alias("matches"), F.max("n_docs").alias("n_docs"))
    if boost is None:
        return bounds.withColumn("boost", F.lit(0))
    best = index.placed.join(boost, "doc_id").groupBy("block").agg(F.max("boost").alias("boost"))
    return bounds.join(best, "block", "left").withColumn("boost", F.greatest(F.coalesce("boost", F.lit(0)), F.lit(0)))


def block_scores(postings: DataFrame, terms: DataFrame, blocks: DataFrame, boost: DataFrame | None) -> DataFrame:
    """(_query, doc_id, boost, matched_terms, matches) of all matching documents of the ``blocks`` (_query, block)."""
    opened = postings.select("term", "block", "docs").join(terms, "term").join(blocks.select("_query", "block"), ["_query", "block"])
    scores = (
        opened.select("_query", F.explode("docs").alias("d"))
        .groupBy("_query", "d.doc_id").agg(F.count("*").alias("matched_terms"), F.sum("d.n").alias("matches"))
    )
    if boost is None:
        return scores.withColumn("boost", F.lit(0))
    return scores.join(boost, "doc_id", "left").fillna(0, ["boost"])


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_per(scores, ["_query"], k, F.desc("boost"), F.desc("matched_terms"), F.desc("matches"), F.asc("doc_id"))


def open_blocks(postings: DataFrame, terms: DataFrame, bounds: DataFrame, k: int, boost: DataFrame | None) -> DataFrame:
    """The blocks (_query, block) that can hold one of the ``k`` best documents.

    The most promising blocks are scored until they hold k matches; what their k-th best document reaches, every
    block has to promise. Equal promises stay, as the id decides between equals.
    """
    order = [F.desc("boost"), F.desc("matched_terms"), F.desc("matches"), F.asc("block")]
    before = Window.partitionBy("_query").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = top_per(bounds, ["_query"], k, *order, rank="_nth").withColumn("_had", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
    seeds = first.where(F.col("_had") < k)
    floors = _best(block_scores(postings, terms, seeds, boost), k).where(F.col("rank") == k).select("_query", _score().alias("_floor"))
    return bounds.join(floors, "_query", "left").where(F.col("_floor").isNull() | (_score() >= F.col("_floor"))).select("_query", "block")


def search_index(index: Index, queries: DataFrame, keys: list[str], k: int = MAX_RESULTS, boost: DataFrame | None = None) -> DataFrame:
    """The ``k`` best documents per query: boost, distinct terms, matches, then id.

    ``boost`` (doc_id, boost) is optional; documents not in it count as 0. Each distinct query
    text is scored once; the rows that ask it join only its best documents.
    """
    spark = queries.sparkSession
    asked = queries.select(*keys, F.col("query").alias("_query"))
    terms = staged(query_terms(asked.select("_query").distinct(), ["_query"], "_query"), stage_dir(spark, "terms"))
    postings = _of_terms(index, terms)
    bounds = staged(block_bounds(index, postings, terms, boost), stage_dir(spark, "bounds"))
    blocks = open_blocks(postings, terms, bounds, k, boost)
    return asked.join(_best(block_scores(postings, terms, blocks, boost), k), "_query").drop("_query")


def search(
    corpus: DataFrame, doc_id: str, text: str, queries: DataFrame, keys: list[str], k: int = MAX_RESULTS, boost: DataFrame | None = None,
    near: Column | None = None,
) -> DataFrame:
    """One search of a corpus: an index of the words that the queries ask for, then ``search_index``."""
    path = stage_dir(corpus.sparkSession, "index")
    return search_index(build_index(corpus, doc_id, text, path, query_terms(queries, []), near), queries, keys, k, boost)
