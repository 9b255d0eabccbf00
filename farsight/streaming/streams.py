"""Streaming operators; each takes a streaming DataFrame, or a static one for its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.urls import url_key
from farsight.functions.verdicts import BORDERLINE
from farsight.operators.verdicts import route_column

# Failure-ratio window, ratio and least calls per kind of call.
FAILURE_WINDOW = "30 seconds"
FAILURE_RATIO = 0.5
MIN_CALLS = {"chat": 10, "search": 5}


def dedupe_hits(hits: DataFrame, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """First arrival of each (run, canonical key).

    A key is remembered for as long as the stream runs, as a run's key set is. Where keys only
    repeat within a known time, ``delay`` bounds the state: keys older than the watermark are
    forgotten and later rows of theirs come through again or are late. Unlike the batch window
    the first *arrival* wins, not the lowest (pass, group, rank).
    """
    keyed = hits.withColumn(ts, F.col(ts).cast("timestamp")).withColumn(
        "url_key", url_key(F.col("url"))
    ).where(F.col("url_key").isNotNull())
    if not hits.isStreaming or delay is None:
        return keyed.dropDuplicates(["run_id", "url_key"])
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["run_id", "url_key"])


def route_stream(verdicts: DataFrame) -> DataFrame:
    """Stateless routing; needs the verdict, its dates and ``lower``/``upper`` bounds."""
    route, outside = route_column(
        F.col("verdict"), F.col("publication_date"), F.col("effective_date"), F.col("applies_from"),
        F.col("date_confidence"), F.col("lower"), F.col("upper"),
    )
    return verdicts.withColumn("route", route).withColumn("out_of_window", outside)


def route_windows(
    routed: DataFrame, ts: str = "ts", width: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Carried, borderline and dropped items per event-time window."""
    timed = routed.withColumn(ts, F.col(ts).cast("timestamp"))
    if routed.isStreaming:
        timed = timed.withWatermark(ts, delay)
    vetted = F.col("route") == "vetted"
    return (
        timed.groupBy(F.window(ts, width).alias("w"))
        .agg(
            F.count_if(vetted).alias("carried"),
            F.count_if(vetted & (F.col("verdict") == BORDERLINE)).alias("borderline"),
            F.count_if(~vetted).alias("dropped"),
        )
        .select(F.col("w.start").alias("window_start"), "carried", "borderline", "dropped")
    )


def failure_windows(
    calls: DataFrame,
    keys: list[str],
    ts: str = "ts",
    width: str = FAILURE_WINDOW,
    min_calls: int = MIN_CALLS["chat"],
    delay: str = "1 minute",
    slide: str | None = None,
) -> DataFrame:
    """Calls, failures and whether the ratio opens the circuit, per window.

    With ``slide`` the windows roll: one starts every ``slide`` and a call is in each that spans it.
    """
    timed = calls.withColumn(ts, F.col(ts).cast("timestamp"))
    if calls.isStreaming:
        timed = timed.withWatermark(ts, delay)
    return (
        timed.groupBy(F.window(ts, width, slide).alias("w"), *keys)
        .agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"))
        .select(
            F.col("w.start").alias("window_start"), *keys, "calls", "failures",
            (
                (F.col("calls") >= min_calls)
                & (F.col("failures") >= F.col("calls") * F.lit(FAILURE_RATIO))
            ).alias("open"),
        )
    )
