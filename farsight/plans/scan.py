"""The whole scan: bounded passes over all active groups at once, then finalizing.

Every group of every run is a row; a pass is one plan over all of them. Each pass's
tables are written below ``root`` and read back, which keeps lineage flat, survives lost
executors and lets an interrupted scan go on from its last complete pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farsight.operators import history as H
from farsight.operators import hits as X
from farsight.operators import labels as L
from farsight.operators import records as R
from farsight.operators import verdicts as V
from farsight.functions.text import is_blank
from farsight.functions.urls import url_host
from farsight.operators.metrics import group_status
from farsight.session import stage_dir, staged
from farsight.plans.makers import (
    Scorer, corpus_search, coverage_decisions, heuristic_scorer, keyword_queries, phrase_labels,
    split_failures,
)
from farsight.sources.pages import clean_html
from farsight.sources.requests import MAX_LOOPS, split_requests, topic_groups
from farsight.sources.snapshots import (
    attach_full_text, full_text_ref, read_full_text, write_full_text,
)
from farsight.sources.vocabulary import IMPACT_AREA_TYPE, TAG_TYPE, vocabulary_terms

GROUP, PASS, DOC = H.GROUP, H.PASS, V.DOC

PASSES = (
    "run_id string, group_id string, query string, query_rationale string, search_failed boolean, "
    "search_failure_reason string, n_docs long, max_loops int, thought_process string, "
    "llm_decision string, relevant_share double, final_decision string, "
    "decision_override boolean, override_reason string, error string, pass int"
)
HITS = (
    "run_id string, group_id string, group_ord int, rank int, url string, title string, "
    "domain string, source_query string, url_key string, doc_index int, pass int"
)
KEYS = "run_id string, group_id string, url_key string, pass int"
ITEMS = (
    "run_id string, group_id string, id string, version int, doc_index int, "
    "source_urls array<string>, domain string, verdict string, eval_rationale string, "
    "unverified boolean, publication_date date, effective_date date, applies_from date, "
    "applies_to date, date_confidence string, level_of_authority string, route string, "
    "out_of_window boolean, full_text_ref string, found_on_pass int"
)


@dataclass
class Scan:
    """Tables of a scan; every one is flat and keyed by run and group."""

    groups: DataFrame
    passes: DataFrame
    hits: DataFrame
    keys: DataFrame
    items: DataFrame
    root: str
    rejected: DataFrame | None = None  # requests with their issues; they have no groups


def page_corpus(pages: DataFrame) -> DataFrame:
    """``url, title, cleaned_text`` of an HTML page table (parsed once), one row per URL.

    Of several pages with one URL the least by its text is taken. Only those are shuffled: their URLs are written
    first, so that few are known to be few.
    """
    many = pages.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
    many = staged(many, stage_dir(pages.sparkSession, "repeated"))
    single = pages.select("url", "html").join(many, "url", "left_anti")
    chosen = pages.select("url", "html").join(many, "url", "left_semi").groupBy("url").agg(F.min("html").alias("html"))
    pages = single.unionByName(chosen)
    title = F.nullif(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return clean_html(pages.select("url", title.alias("title"), "html")).select(
        "url", "title", "cleaned_text"
    )


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def _write(df: DataFrame, root: str, name: str, number: int, partition: str = "pass") -> None:
    df.drop(partition).write.mode("overwrite").parquet(f"{root}/{name}/{partition}={number}")


def _done(spark: SparkSession, root: str, number: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/passes/pass={number}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def run_scan(
    requests: DataFrame,
    corpus: DataFrame,
    root: str,
    scorer: Scorer | None = None,
    decisions: Callable[[DataFrame], DataFrame] = coverage_decisions,
    query_maker: Callable[[DataFrame], DataFrame] = keyword_queries,
    search: Callable[[DataFrame], DataFrame] | None = None,
    search_failures: Callable[[DataFrame], DataFrame] | None = None,
    allowlist: DataFrame | None = None,
    max_passes: int | None = None,
    max_loops: int = MAX_LOOPS,
) -> Scan:
    """Runs the passes of all valid requests and returns the written tables.

    ``corpus`` holds ``url, title, cleaned_text``; a hit whose URL it lacks is unverified.
    ``search_failures`` maps queries to (run_id, group_id, pass, reason) rows.
    A group takes at most ``max_loops`` passes; ``max_passes`` ends the whole scan earlier, to be
    gone on with later. Calling again with the same ``root`` skips the passes that are complete.
    """
    spark = requests.sparkSession
    scorer = scorer or heuristic_scorer()
    search = search or corpus_search(corpus, path=f"{root}/index")
    valid, rejected = split_requests(requests)
    meta = valid.drop("topic_groups")
    if not _done(spark, root, 0):
        topic_groups(valid, max_loops).join(meta, "run_id").write.mode("overwrite").parquet(f"{root}/groups")
        rejected.write.mode("overwrite").parquet(f"{root}/rejected")
        _write_empty(spark, root)
    groups = spark.read.parquet(f"{root}/groups")
    corpus = corpus.select("url", "title", "cleaned_text")

    cap = groups.agg(F.max("max_loops")).head()[0] or 0
    for number in range(1, min(cap, max_passes or cap) + 1):
        if _done(spark, root, number):
            continue
        earlier = _table(spark, root, "passes", PASSES).where(F.col("pass").between(1, number - 1))
        alive = earlier.where(F.col("error").isNotNull()).select(*GROUP).distinct()
        active = (
            H.next_passes(groups.join(alive, GROUP, "left_anti"), earlier)
            .where(F.col("next_pass") == number)
            .withColumnRenamed("next_pass", "pass")
        )
        # Written so that the search sees a table of known, small size: its terms are then
        # broadcast and the corpus is not shuffled.
        queries = _stage(spark, query_maker(active), root, "queries", number)
        if queries.isEmpty():
            break
        _one_pass(
            spark, root, number, queries, corpus, scorer, decisions, search, search_failures,
            allowlist,
        )
    return load_scan(spark, root)


def _write_empty(spark: SparkSession, root: str) -> None:
    """Pass 0 of every table: no rows, so that the tables can be read from the start."""
    for name, schema, partition in (
        ("hits", HITS, "pass"), ("keys", KEYS, "pass"), ("items", ITEMS, "found_on_pass"),
        ("passes", PASSES, "pass"),
    ):
        _write(spark.createDataFrame([], schema), root, name, 0, partition)


def load_scan(spark: SparkSession, root: str) -> Scan:
    return Scan(
        groups=spark.read.parquet(f"{root}/groups"),
        passes=_table(spark, root, "passes", PASSES),
        hits=_table(spark, root, "hits", HITS),
        keys=_table(spark, root, "keys", KEYS),
        items=_table(spark, root, "items", ITEMS),
        root=root,
        rejected=spark.read.parquet(f"{root}/rejected"),
    )


def _stage(spark: SparkSession, df: DataFrame, root: str, name: str, number: int) -> DataFrame:
    """Writes one pass of an intermediate table and reads exactly that pass back."""
    path = f"{root}/{name}/pass={number}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _one_pass(
    spark, root, number, queries, corpus, scorer, decisions, search, search_failures, allowlist
) -> None:
    # The search is the only step that reads the corpus as a whole; its few ranked hits
    # are written so that nothing below runs it again.
    raw = _stage(spark, search(queries), root, "raw_hits", number)
    if allowlist is not None:
        raw = X.allowed(raw, allowlist)
    seen = _table(spark, root, "keys", KEYS).where(F.col("pass") < number)
    keys = X.new_group_keys(raw, seen).select(*X.GROUP_KEY, "pass")
    _write(keys, root, "keys", number)

    # Dedupe and rank on narrow rows, then fetch only the kept hits' texts.
    kept = _stage(
        spark,
        V.with_doc_index(X.prefilter(raw, seen, seen), large=False).withColumn("domain", url_host(F.col("url"))),
        root, "kept", number,
    )
    texts = _stage(
        spark, corpus.join(kept.select("url").distinct(), "url", "left_semi"), root, "texts", number
    )
    hits = kept.drop("title").join(texts.select("url", "title"), "url", "left")
    _write(hits.select(*_names(HITS)), root, "hits", number)

    context = queries.select(*GROUP, "group_name", "keywords", "jurisdiction")
    has_text = ~is_blank(F.col("cleaned_text"))
    docs = hits.drop("title").join(texts, "url", "left").withColumn("unverified", ~has_text)
    scored = _stage(spark, scorer(docs.join(context, GROUP)), root, "scored", number)
    errors = (
        scored.where(F.col("error").isNotNull()).groupBy(*GROUP).agg(F.min("error").alias("error"))
    )
    # A pass with an unusable answer keeps what was answered and tries again.
    unusable = scored.where("fallback").select(*PASS).distinct()
    verdicts = scored.where(F.col("error").isNull() & ~F.col("fallback"))

    filled = V.fill_verdicts(docs.drop("cleaned_text"), verdicts, unusable)
    window = queries.select("run_id", "start_date", "end_date", "started_at").distinct()
    items = V.result_items(V.route_items(filled, window)).withColumn(
        "full_text_ref",
        F.when(~F.col("unverified") & (F.col("route") == "vetted"), full_text_ref()),
    )
    _write(items.select(*_names(ITEMS)), root, "items", number, "found_on_pass")

    passes = queries.select(*PASS, "query", "query_rationale", "max_loops")
    if search_failures is not None:
        reasons = search_failures(queries).select(
            *PASS, F.col("reason").alias("search_failure_reason")
        )
        passes = passes.join(reasons, PASS, "left")
    else:
        passes = passes.withColumn("search_failure_reason", F.lit(None).cast("string"))
    passes = passes.withColumn("search_failed", F.col("search_failure_reason").isNotNull())
    counts = kept.groupBy(*PASS).agg(F.count("*").alias("n_docs"))
    shares = V.relevant_share(filled).select(*PASS, "relevant_share")
    decided = V.decide(
        V.fill_decisions(passes, decisions(verdicts).join(unusable, PASS, "left_anti"), counts)
        .join(shares, PASS, "left")
        .fillna(0.0, ["relevant_share"])
    ).join(errors, GROUP, "left")
    # Written last: its presence marks the pass as complete.
    _write(decided.select(*_names(PASSES)), root, "passes", number)


# --- finalizing ------------------------------------------------------------------


def finalize(
    scan: Scan,
    vocabulary: DataFrame,
    priors: DataFrame | None = None,
    record_maker: Callable[[DataFrame], DataFrame] | None = None,
    area_maker: Callable[[DataFrame], DataFrame] | None = None,
    tag_maker: Callable[[DataFrame], DataFrame] | None = None,
    what_it_does: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(group results, item records) of a scan.

    Carried items get their full text back by reference, are labelled from the
    vocabulary, and become records; groups get their status and loop count. Makers map
    items with ``full_text`` to ``impact_area_value``, ``tag_values`` or judged fields by
    (run_id, group_id, id); whatever they answer is checked against the vocabulary.
    """
    spark = scan.items.sparkSession
    keys = [*GROUP, "id"]
    # A group that faulted on any pass is a Failed result without items.
    faulted = scan.passes.where(F.col("error").isNotNull()).select(
        *GROUP, F.lit(True).alias("faulted")
    ).distinct()
    items = scan.items.join(faulted, GROUP, "left_anti")
    carried = items.where(F.col("route") == "vetted")
    texts = (
        spark.read.schema("url string, cleaned_text string, pass int")
        .parquet(f"{scan.root}/texts")
        .select(
            F.col("url").alias("_url"), F.col("pass").alias("found_on_pass"), "cleaned_text"
        )
    )
    snapshots = f"{scan.root}/fulltext"
    write_full_text(
        carried.withColumn("_url", F.element_at("source_urls", 1)).join(
            texts, ["_url", "found_on_pass"]
        ),
        snapshots,
    )
    grounded = attach_full_text(carried, read_full_text(spark, snapshots))
    area_terms = vocabulary_terms(vocabulary, IMPACT_AREA_TYPE)
    tag_terms = vocabulary_terms(vocabulary, TAG_TYPE)
    occurring = None
    if area_maker is None or tag_maker is None:
        occurring = _occurring_labels(grounded, keys, area_terms, tag_terms)
    areas = tags = occurring
    if area_maker is not None:
        areas = L.single_label(area_maker(grounded), area_terms, "impact_area_value")
    if tag_maker is not None:
        tags = L.multi_label(tag_maker(grounded), tag_terms, keys, "tag_values")
    meta = scan.groups.select(*GROUP, "group_name", "jurisdiction")
    labelled = L.merge_labels(R.enrich(carried, what_it_does), areas, tags, keys).join(meta, GROUP)
    if priors is not None:
        labelled = labelled.join(
            L.attach_exemplars(meta, priors).select(*GROUP, "n_exemplars"), GROUP, "left"
        )
    base = R.base_records(labelled.drop("level_of_authority"))
    judged, broken = split_failures(record_maker(base)) if record_maker else (None, None)
    records = R.overlay(base, judged, keys)
    if broken is not None:
        records = records.join(broken, GROUP, "left_anti")
        items = items.join(broken, GROUP, "left_anti")
        faulted = faulted.unionByName(
            broken.select(*GROUP, F.lit(True).alias("faulted"))
        ).distinct()
    groups = scan.groups.select("run_id", "group_ord", "group_id", "group_name")
    results = group_status(groups.join(faulted, GROUP, "left"), scan.passes, items)
    return results.drop("faulted"), records


def _occurring_labels(
    items: DataFrame, keys: list[str], area_terms: DataFrame, tag_terms: DataFrame
) -> DataFrame:
    """First impact area and all tags that occur in each item's text, in one text pass."""
    terms = area_terms.select("name", F.lit("area").alias("kind")).unionByName(
        tag_terms.select("name", F.lit("tag").alias("kind"))
    )
    found = phrase_labels(items, keys, "full_text", terms)
    at = F.struct("at", "name")
    return found.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "area", at))["name"].alias("impact_area"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "tag", at))), lambda x: x["name"]
        ).alias("tags"),
    )


def scan_results(results: DataFrame, records: DataFrame, requests: DataFrame) -> DataFrame:
    """One nested row per (run, group) in request order, with the run's start and window.

    A run is the set of its rows, sorted by ``group_ord``; no row holds a whole run.
    """
    lists = records.groupBy(*GROUP).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "found_on_pass", "doc_index",
                        F.struct("id", "source_urls", "verdict", *R.RECORD_COLUMNS).alias("item"),
                    )
                )
            ),
            lambda x: x["item"],
        ).alias("items")
    )
    runs = requests.select("run_id", "started_at")
    return (
        results.join(lists, GROUP, "left").join(runs, "run_id")
        .select("run_id", "started_at", "group_ord", "group_id", "group_name", "status", "loop_count", "items")
    )


def write_scan_results(nested: DataFrame, path: str) -> None:
    """JSON sink sorted by run and request order."""
    nested.sort("run_id", "group_ord").write.mode("overwrite").json(path)
