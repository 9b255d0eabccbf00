"""Full-text and history snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farsight.functions.text import is_blank
from farsight.operators.ordinals import first_per
from farsight.schemas import FULL_TEXT, HISTORY_SNAPSHOTS, HISTORY_STRUCT


def full_text_ref(run_id="run_id", group_id="group_id", item="id"):
    """Key of an item's snapshot: ``fulltext/{run}/{group}/{item}.txt``."""
    return F.concat(
        F.concat_ws("/", F.lit("fulltext"), F.col(run_id), F.col(group_id), F.col(item)), F.lit(".txt")
    )


def with_full_text_ref(items: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Adds ``full_text_ref``: set for vetted items that have text, else null."""
    keep = (F.col("route") == "vetted") & ~is_blank(F.col(text))
    return items.withColumn("full_text_ref", F.when(keep, full_text_ref()))


def write_full_text(items: DataFrame, path: str, text: str = "cleaned_text") -> None:
    """Writes the texts of items that have a reference, replacing the pass it repeats.

    Partitioned by run and pass only: groups are many and small, so they stay a
    sorted column inside the files (row-group statistics prune on them).
    """
    items.where(F.col("full_text_ref").isNotNull()).select(
        "run_id", "found_on_pass", "group_id", "id", F.col(text).alias("text")
    ).sortWithinPartitions("run_id", "found_on_pass", "group_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run_id", "found_on_pass").parquet(path)


def read_full_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FULL_TEXT).parquet(path)


def attach_full_text(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Items with ``full_text``: null without a reference or without a snapshot."""
    keys = ["run_id", "group_id", "id"]
    texts = snapshots.select(*keys, F.col("text").alias("_text"))
    return (
        items.join(texts, keys, "left")
        .withColumn("full_text", F.when(~is_blank(F.col("full_text_ref")), F.col("_text")))
        .drop("_text")
    )


def history_json(history: DataFrame, column: str = "history") -> DataFrame:
    """Nested history to snapshot text. Nulls are kept so that reading gives the same value."""
    return history.withColumn(
        "value_json", F.to_json(column, {"ignoreNullFields": "false"})
    ).drop(column)


def parse_history(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("history", F.from_json("value_json", HISTORY_STRUCT)).drop("value_json")


# Partitions of the snapshot table (sessions are too many for one folder each).
SESSION_BUCKETS = 64


def session_bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(SESSION_BUCKETS)).cast("int")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """Upserts snapshots by (session, checkpoint) into a table partitioned by session bucket.

    Appends only; reads take the latest ``seq`` of an id, so a retried write is harmless.
    Rebalancing gives few files per bucket and splits a bucket that is large.
    """
    columns = ["session_id", "checkpoint_id", "parent_checkpoint_id", "value_json", "seq"]
    bucketed = snapshots.select(*columns).withColumn("bucket", session_bucket(F.col("session_id")))
    bucketed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def latest_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Latest write of every snapshot."""
    table = spark.read.schema(HISTORY_SNAPSHOTS + ", bucket int").parquet(path)
    return first_per(table, ["bucket", "session_id", "checkpoint_id"], F.desc("seq"))


def snapshot_index(
    spark: SparkSession, path: str, session_id: str, parent: str | None = None
) -> DataFrame:
    """Snapshots of one session (optionally only a parent's children); one bucket is read."""
    rows = latest_snapshots(spark, path).where(
        (F.col("bucket") == session_bucket(F.lit(session_id)))
        & (F.col("session_id") == session_id)
    )
    if parent is not None:
        rows = rows.where(F.col("parent_checkpoint_id") == parent)
    return rows.drop("bucket")


def snapshot(spark: SparkSession, path: str, session_id: str, checkpoint_id: str) -> str:
    """The text of one snapshot; a missing one is an error."""
    found = (
        snapshot_index(spark, path, session_id)
        .where(F.col("checkpoint_id") == checkpoint_id)
        .select("value_json")
        .head()
    )
    if found is None:
        raise KeyError(f"snapshot {checkpoint_id!r} not found for session {session_id!r}")
    return found[0]


def child_snapshots(spark: SparkSession, path: str, parents: DataFrame) -> DataFrame:
    """The snapshots whose parent is one of ``parents`` (session_id, parent_checkpoint_id)."""
    asked = parents.select("session_id", "parent_checkpoint_id", session_bucket(F.col("session_id")).alias("bucket")).distinct()
    return latest_snapshots(spark, path).join(asked, ["bucket", "session_id", "parent_checkpoint_id"], "left_semi").drop("bucket")


def read_snapshots(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """``asked`` (session_id, checkpoint_id and others) with ``value_json`` and ``error``; a missing snapshot is an error of its row."""
    texts = latest_snapshots(spark, path).select("session_id", "checkpoint_id", "value_json", F.lit(True).alias("_found"))
    joined = asked.join(texts, ["session_id", "checkpoint_id"], "left")
    missing = F.format_string("snapshot %s not found for session %s", "checkpoint_id", "session_id")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), missing)).drop("_found")
