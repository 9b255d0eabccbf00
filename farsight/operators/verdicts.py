"""Verdicts: parsing answers, filling gaps, routing, pass decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farsight.functions.dates import lenient_date, outside_window, window_end
from farsight.functions.text import is_blank, percent, ratio, trim_to_null, trim_ws
from farsight.functions.urls import stable_id
from farsight.functions import answers as A, verdicts as V
from farsight.operators.ordinals import first_per, ordinal

PASS = ["run_id", "group_id", "pass"]
DOC = [*PASS, "doc_index"]

# Fixed value: share of relevant verdicts that forces another pass (inclusive).
RECALL_SHARE = 0.80

VERDICT_COLUMNS = [
    "verdict", "rationale", "publication_date", "effective_date", "applies_from", "applies_to",
    "date_confidence",
]


def with_doc_index(docs: DataFrame, order: str = "rank", keys: list[str] = PASS, large: bool = True) -> DataFrame:
    """0-based position of each document inside its pass.

    ``large=False`` numbers in one shuffle and reads ``docs`` once; it is for passes whose documents
    a search has limited, as a pass then goes through one task.
    """
    if not large:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        return docs.withColumn("doc_index", (place - 1).cast("int"))
    return ordinal(docs, keys, order, "doc_index", start=0)


# --- answers to rows -------------------------------------------------------------


# Fields of an answer and of its items.
ANSWER_FIELDS = {"thoughtProcess": A.text, "decision": A.text}
ITEM_FIELDS = {
    "index": A.whole,
    **dict.fromkeys(["verdict", "rationale", "publicationDate", "effectiveDate", "appliesFrom", "appliesTo", "dateConfidence"], A.text),
}


def parse_verdicts(payloads: DataFrame) -> DataFrame:
    """JSON answers parsed: ``thought_process, llm_decision, items, failed``.

    Malformed JSON, a missing item list, an item that is no object or a field of another type makes the
    answer ``failed``. Field names match in any case, a number may stand in a string, and members that are
    not fields of the answer or its items do not matter. To be written where more than one step reads it, as
    filters on ``items`` and ``failed`` are otherwise answered by parsing again.
    """
    kept = [c for c in payloads.columns if c != "payload"]
    read = payloads.select(*kept, A.answer(F.col("payload"), ANSWER_FIELDS, {"items": ITEM_FIELDS}).alias("_a"))
    failed = F.col("_a").isNull()
    return read.select(
        *kept,
        F.when(failed, V.FAILED_THOUGHT)
        .when(is_blank(F.col("_a.thoughtProcess")), V.DEFAULT_THOUGHT)
        .otherwise(trim_ws(F.col("_a.thoughtProcess")))
        .alias("thought_process"),
        F.when(failed, V.RETRY).otherwise(V.parse_decision(F.col("_a.decision"))).alias("llm_decision"),
        F.col("_a.items").alias("items"),
        failed.alias("failed"),
    )


def verdict_rows(parsed: DataFrame, keys: list[str] = PASS) -> DataFrame:
    """Answer items to typed verdict rows in answer order (``item_pos``)."""
    return parsed.select(*keys, F.posexplode("items").alias("item_pos", "i")).select(
        *keys,
        "item_pos",
        F.coalesce("i.index", F.lit(0)).alias("doc_index"),
        V.parse_verdict(F.col("i.verdict")).alias("verdict"),
        trim_to_null(F.col("i.rationale")).alias("rationale"),
        lenient_date(F.col("i.publicationDate")).alias("publication_date"),
        lenient_date(F.col("i.effectiveDate")).alias("effective_date"),
        lenient_date(F.col("i.appliesFrom")).alias("applies_from"),
        lenient_date(F.col("i.appliesTo")).alias("applies_to"),
        V.parse_confidence(F.col("i.dateConfidence")).alias("date_confidence"),
    )


def first_verdicts(rows: DataFrame, keys: list[str] = DOC) -> DataFrame:
    """First verdict per document index; later ones are ignored."""
    return first_per(rows, keys, "item_pos")


def fill_verdicts(
    docs: DataFrame, verdicts: DataFrame, failed_passes: DataFrame | None = None,
    keys: list[str] = DOC,
) -> DataFrame:
    """Every document with a verdict.

    Verdicts for indexes that are not documents fall away. A document the answer left
    out, or whose pass has no usable answer (``failed_passes``), is Borderline.
    """
    known = verdicts.select(*keys, *VERDICT_COLUMNS).withColumn("_answered", F.lit(True))
    joined = docs.join(known, keys, "left")
    rationale = F.lit(V.OMITTED_RATIONALE)
    if failed_passes is not None:
        pass_keys = [k for k in keys if k != "doc_index"]
        joined = joined.join(
            failed_passes.select(*pass_keys, F.lit(True).alias("_failed")), pass_keys, "left"
        )
        rationale = F.when(F.col("_failed"), V.FAILED_RATIONALE).otherwise(rationale)
    return (
        joined.withColumn("verdict", F.coalesce("verdict", F.lit(V.BORDERLINE)))
        .withColumn("rationale", F.when(F.col("_answered"), F.col("rationale")).otherwise(rationale))
        .withColumn("date_confidence", F.coalesce("date_confidence", F.lit(V.UNKNOWN)))
        .drop("_answered", "_failed")
    )


def fill_decisions(passes: DataFrame, decisions: DataFrame, doc_counts: DataFrame) -> DataFrame:
    """One decision per pass, also for passes without documents or without an answer.

    No documents: Retry when the search failed, else Finalize. Documents but no
    usable answer: Retry.
    """
    answers = decisions.select(
        *PASS, F.col("thought_process").alias("_t"), F.col("llm_decision").alias("_d")
    )
    joined = passes.join(doc_counts.select(*PASS, "n_docs"), PASS, "left").join(answers, PASS, "left")
    empty = F.coalesce("n_docs", F.lit(0)) == 0
    broken = F.coalesce("search_failed", F.lit(False))
    reason = F.coalesce("search_failure_reason", F.lit(""))
    return (
        joined.withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
        .withColumn(
            "llm_decision",
            F.when(empty & broken, V.RETRY).when(empty, V.FINALIZE)
            .otherwise(F.coalesce("_d", F.lit(V.RETRY))),
        )
        .withColumn(
            "thought_process",
            F.when(empty & broken, F.format_string(V.SEARCH_FAILED_THOUGHT, reason))
            .when(empty, V.EMPTY_THOUGHT)
            .otherwise(F.coalesce("_t", F.lit(V.FAILED_THOUGHT))),
        )
        .drop("_t", "_d")
    )


# --- routing ---------------------------------------------------------------------


def route_column(
    verdict: Column, publication: Column, effective: Column, applies_from: Column,
    confidence: Column, lower: Column, upper: Column,
) -> tuple[Column, Column]:
    """(route, out_of_window): NotRelevant and out-of-window items are discarded."""
    outside = (verdict != V.NOT_RELEVANT) & outside_window(
        publication, effective, applies_from, confidence, lower, upper
    )
    route = F.when((verdict == V.NOT_RELEVANT) | outside, F.lit("discarded")).otherwise("vetted")
    return route, outside


def route_items(items: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Adds ``route`` and ``out_of_window``.

    The window comes from the columns ``start_date, end_date, started_at``, joined from
    ``requests`` by run when given.
    """
    if requests is not None:
        items = items.join(requests.select("run_id", "start_date", "end_date", "started_at"), "run_id")
    route, outside = route_column(
        F.col("verdict"), F.col("publication_date"), F.col("effective_date"), F.col("applies_from"),
        F.col("date_confidence"), F.col("start_date"),
        window_end(F.col("end_date"), F.col("started_at")),
    )
    return (
        items.withColumn("route", route).withColumn("out_of_window", outside)
        .drop("start_date", "end_date", "started_at")
    )


def result_items(routed: DataFrame) -> DataFrame:
    """Result-item projection of routed documents."""
    return routed.select(
        "run_id", "group_id",
        stable_id(F.col("url")).alias("id"),
        F.lit(1).alias("version"),
        F.col("pass").alias("found_on_pass"),
        "doc_index",
        F.array("url").alias("source_urls"),
        "domain", "verdict",
        F.col("rationale").alias("eval_rationale"),
        "unverified",
        "publication_date", "effective_date", "applies_from", "applies_to", "date_confidence",
        F.lit("Unknown").alias("level_of_authority"),
        "route", "out_of_window",
        *[c for c in ("cleaned_text",) if c in routed.columns],
    )


def route_counts(routed: DataFrame, keys: list[str]) -> DataFrame:
    """Carried, borderline, dropped and out-of-window items."""
    vetted = F.col("route") == "vetted"
    return routed.groupBy(*keys).agg(
        F.count_if(vetted).alias("carried"),
        F.count_if(vetted & (F.col("verdict") == V.BORDERLINE)).alias("borderline"),
        F.count_if(~vetted).alias("dropped"),
        F.count_if("out_of_window").alias("out_of_window"),
    )


# --- pass decisions --------------------------------------------------------------


def relevant_share(verdicts: DataFrame, keys: list[str] = PASS) -> DataFrame:
    """Relevant verdicts over all verdicts, before window and index filters."""
    return verdicts.groupBy(*keys).agg(
        F.count("*").alias("n_verdicts"),
        F.count_if(F.col("verdict") == V.RELEVANT).alias("n_relevant"),
    ).withColumn("relevant_share", ratio(F.col("n_relevant"), F.col("n_verdicts"), 0.0))


def decide(passes: DataFrame) -> DataFrame:
    """Final decision of a pass.

    Needs ``pass, max_loops, llm_decision, relevant_share``. The cap always finalizes;
    below it a Finalize with a rich share becomes Retry; else the answer's word holds.
    """
    cap = F.col("pass") >= F.col("max_loops")
    wants_end = F.col("llm_decision") == V.FINALIZE
    rich = ~cap & wants_end & (F.coalesce("relevant_share", F.lit(0.0)) >= RECALL_SHARE)
    final = F.when(cap, V.FINALIZE).when(rich, V.RETRY).otherwise(F.col("llm_decision"))
    reason = F.when(
        cap & ~wants_end,
        F.concat(F.lit("maxLoops cap ("), F.col("max_loops").cast("string"), F.lit(") reached.")),
    ).when(
        rich,
        F.concat(
            F.lit("recall override: "), percent(F.col("relevant_share")),
            F.lit(" of items RELEVANT (>= "), percent(F.lit(RECALL_SHARE)),
            F.lit("); searching again for more."),
        ),
    )
    return (
        passes.withColumn("final_decision", final)
        .withColumn("decision_override", F.col("final_decision") != F.col("llm_decision"))
        .withColumn("override_reason", reason)
    )


def still_active(last_passes: DataFrame) -> DataFrame:
    """Groups that go on: below their cap and the last decision is Retry (or none yet)."""
    return last_passes.where(
        (F.coalesce("pass", F.lit(0)) < F.col("max_loops"))
        & (F.coalesce("final_decision", F.lit(V.RETRY)) == V.RETRY)
    )


# --- steer notes -----------------------------------------------------------------

# Words in a weak-evidence note that name its reason.
WEAK_REASONS = [
    ("LowAuthority", r"low[- ]authority|secondary"),
    ("Stale", r"out[- ]of[- ]date|stale"),
    ("Ambiguous", "ambiguous"),
]


def steer_rows(notes: DataFrame, keys: list[str], column: str = "thought_process") -> DataFrame:
    """``Missing facets: a, b ... Weak evidence: p, q ...`` notes to (facet, reason) rows.

    ``none`` gives no row. Missing facets have the reason MissingFacet; weak ones the
    reason their sentence names, else WeakEvidence.
    """
    note = F.col(column)
    missing = F.regexp_extract(note, r"(?is)missing facets:\s*(.*?)(?:\s+-\s|\.|;|weak evidence:|$)", 1)
    weak_text = F.regexp_extract(note, r"(?is)weak evidence:\s*(.*)$", 1)
    weak = F.regexp_extract(
        weak_text, r"(?is)^(?:facets\s+)?(.*?)(?:\s+(?:are|is)\s|\s+-\s|\.|;|$)", 1
    )
    reason = F.lit("WeakEvidence")
    for name, words in reversed(WEAK_REASONS):
        reason = F.when(weak_text.rlike(f"(?i){words}"), F.lit(name)).otherwise(reason)

    def facets(listed: Column, why: Column) -> Column:
        named = F.filter(
            F.transform(F.split(listed, ","), trim_ws),
            lambda x: (x != "") & ~x.rlike("(?i)^none( identifiable)?$"),
        )
        return F.transform(named, lambda x: F.struct(x.alias("facet"), why.alias("reason")))

    both = F.concat(facets(missing, F.lit("MissingFacet")), facets(weak, reason))
    return notes.select(*keys, F.posexplode(both).alias("facet_pos", "f")).select(
        *keys, "facet_pos", "f.facet", "f.reason"
    )
