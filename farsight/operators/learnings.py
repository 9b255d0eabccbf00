"""Completed answers kept between runs, reviews of them, and their retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.text import fold
from farsight.operators.ordinals import first_per, top_per
from farsight.sources.store import upsert

# Learnings retrieved per scope, and the reason codes of a review.
TOP_K = 5
REASON_CODES = [
    "missed-effective-date", "non-authoritative-source", "wrong-jurisdiction", "duplicate",
    "out-of-scope-topic", "summary-misled-eval",
]
APPROVED = "Approved"


def completed_answers(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Group results to one answer per (run, group), pending review."""
    meta = runs.select("run_id", "jurisdiction", "start_date", "end_date", "completed_at")
    return results.join(meta, "run_id").select(
        F.concat_ws(":", "run_id", "group_id").alias("id"),
        F.lit("CompletedAnswer").alias("doc_type"),
        "jurisdiction", "run_id", "group_id", "group_name", "loop_count",
        F.concat(
            F.coalesce(F.col("start_date").cast("string"), F.lit("")), F.lit(".."),
            F.coalesce(F.col("end_date").cast("string"), F.lit("")),
        ).alias("date_range"),
        F.lit("Pending").alias("review_status"),
        F.lit(None).cast("int").alias("rating"),
        F.array().cast("array<string>").alias("reason_codes"),
        F.lit(None).cast("string").alias("feedback_text"),
        F.col("completed_at"),
    )


def save_answers(current: DataFrame, answers: DataFrame) -> DataFrame:
    """Store after writing answers; writing the same (run, group) again replaces it."""
    return upsert(current, answers, ["id"])


def approved_top(
    learnings: DataFrame, by_group: bool = True, k: int = TOP_K, require_approved: bool = True
) -> DataFrame:
    """Newest approved learnings per (jurisdiction, group) or per jurisdiction."""
    scope = ["jurisdiction_key", "group_id"] if by_group else ["jurisdiction_key"]
    rows = learnings.where(F.col("review_status") == APPROVED) if require_approved else learnings
    return top_per(
        rows.withColumn("jurisdiction_key", fold(F.col("jurisdiction"))),
        scope, k, F.desc("completed_at"), "id", rank="recency_rank",
    )


def apply_reviews(results: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Results with the reviewer's verdict, note and known reason codes.

    ``expected`` is the corrected verdict, or the given one where nobody corrected it;
    unknown reason codes are kept apart in ``unknown_codes``.
    """
    codes = F.coalesce("reason_codes", F.array().cast("array<string>"))
    known = F.array(*[F.lit(c) for c in REASON_CODES])
    reviewed = reviews.select(
        *keys, F.col("corrected_verdict").alias("_corrected"), "note",
        F.array_intersect(codes, known).alias("reason_codes"),
        F.array_except(codes, known).alias("unknown_codes"),
    )
    return (
        results.join(reviewed, keys, "left")
        .withColumn("expected", F.coalesce("_corrected", "verdict"))
        .withColumn("predicted", F.col("verdict"))
        .drop("_corrected")
    )


def reason_counts(reviewed: DataFrame) -> DataFrame:
    return (
        reviewed.select(F.explode("reason_codes").alias("reason_code"))
        .groupBy("reason_code").agg(F.count("*").alias("n"))
    )


def latest_per_scan(learnings: DataFrame) -> DataFrame:
    """Latest answer per (jurisdiction, group, date range): rescans do not pile up."""
    return first_per(
        learnings.withColumn("jurisdiction_key", fold(F.col("jurisdiction"))),
        ["jurisdiction_key", "group_id", "date_range"], F.desc("completed_at"), "id",
    )
