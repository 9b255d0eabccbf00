"""Run, status, verdict-mix and recall metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.text import ratio
from farsight.functions.verdicts import BORDERLINE, NOT_RELEVANT, RELEVANT
from farsight.operators.history import GROUP

COMPLETED, FAILED = "Completed", "Failed"


def group_status(groups: DataFrame, passes: DataFrame, items: DataFrame) -> DataFrame:
    """Status and loop count per group.

    Failed only when nothing was carried and the last pass's search failed, or when the
    group itself faulted (a true ``faulted`` column in ``groups``).
    """
    last = passes.groupBy(*GROUP).agg(
        F.max_by(F.coalesce("search_failed", F.lit(False)), "pass").alias("_broken"),
        F.count("*").cast("int").alias("loop_count"),
    )
    carried = items.where(F.col("route") == "vetted").groupBy(*GROUP).agg(F.count("*").alias("carried"))
    faulted = F.coalesce("faulted", F.lit(False)) if "faulted" in groups.columns else F.lit(False)
    return (
        groups.join(last, GROUP, "left").join(carried, GROUP, "left")
        .withColumn("carried", F.coalesce("carried", F.lit(0)))
        .withColumn("loop_count", F.coalesce("loop_count", F.lit(0)))
        .withColumn(
            "status",
            F.when(
                faulted | ((F.col("carried") == 0) & F.coalesce("_broken", F.lit(False))), FAILED
            ).otherwise(COMPLETED),
        )
        .drop("_broken")
    )


def run_outcomes(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Groups, failed groups and duration per run (``runs``: run_id, started_at, completed_at)."""
    counts = results.groupBy("run_id").agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("status") == FAILED).alias("n_failed")
    )
    millis = F.floor((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000)
    return runs.join(counts, "run_id", "left").fillna(0, ["n_groups", "n_failed"]).select(
        "run_id", "n_groups", "n_failed", millis.cast("long").alias("duration_ms")
    )


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n_groups"))


def verdict_mix(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts per key by kind (the kinds are fixed, so no pass to find them)."""
    return verdicts.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == RELEVANT).alias("relevant"),
        F.count_if(F.col("verdict") == BORDERLINE).alias("borderline"),
        F.count_if(F.col("verdict") == NOT_RELEVANT).alias("not_relevant"),
    )


def recall_report(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Recall of ``predicted`` against ``expected`` verdicts; 1.0 when nothing was expected."""
    expected_carried = F.col("expected") != NOT_RELEVANT
    carried = F.col("predicted") != NOT_RELEVANT
    expected_relevant = F.col("expected") == RELEVANT
    counts = labelled.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"),
        F.count_if(expected_carried).alias("carried_expected"),
        F.count_if(expected_carried & carried).alias("carried_recalled"),
        F.count_if(expected_relevant).alias("relevant_expected"),
        F.count_if(expected_relevant & (F.col("predicted") == RELEVANT)).alias("relevant_recalled"),
    )
    return counts.withColumn(
        "carried_recall", ratio(F.col("carried_recalled"), F.col("carried_expected"), 1.0)
    ).withColumn(
        "relevant_recall", ratio(F.col("relevant_recalled"), F.col("relevant_expected"), 1.0)
    )
