"""Keyed document tables on parquet: batch create, upsert, replace, delete, reads, versions.

A table is partitioned by a low-cardinality ``partition`` column. A batch rewrites only the
partitions it touches (dynamic partition overwrite), and within them only reads by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.operators.ordinals import first_per, ordinal

KEY = ["partition", "id"]


def latest(batch: DataFrame, keys: list[str] = KEY, *order) -> DataFrame:
    """One row per key of a batch: the last by ``order`` columns."""
    return first_per(batch, keys, *[F.desc(c) for c in order])


def upsert(current: DataFrame, batch: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Batch rows replace rows of the same key; others stay. ``batch`` has unique keys.

    Only the batch's keys meet the current table (anti join), not its whole rows.
    """
    return current.join(batch.select(*keys), keys, "left_anti").unionByName(
        batch, allowMissingColumns=True
    )


def create(current: DataFrame, batch: DataFrame, keys: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicting rows whose key exists)."""
    taken = current.select(*keys)
    return batch.join(taken, keys, "left_anti"), batch.join(taken, keys, "left_semi")


def replace(
    current: DataFrame, batch: DataFrame, keys: list[str] = KEY
) -> tuple[DataFrame, DataFrame]:
    """(table after replacing existing keys, batch rows whose key is missing)."""
    known = current.select(*keys)
    present = batch.join(known, keys, "left_semi")
    return upsert(current, present, keys), batch.join(known, keys, "left_anti")


def delete(current: DataFrame, doomed: DataFrame, keys: list[str] = KEY) -> DataFrame:
    return current.join(doomed.select(*keys), keys, "left_anti")


def point_reads(wanted: DataFrame, current: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Wanted keys with their row; columns are null where the key is missing."""
    return wanted.select(*keys).join(current, keys, "left")


def query(current: DataFrame, condition=None, partition=None) -> DataFrame:
    """All matching rows of one partition (pruned) or of the whole table."""
    rows = current if partition is None else current.where(F.col("partition") == partition)
    return rows if condition is None else rows.where(condition)


def write_upsert(
    spark: SparkSession, path: str, batch: DataFrame, schema: str, partition_by: str = "partition",
    keys: list[str] = KEY,
) -> None:
    """Upserts a batch into the parquet table at ``path``; untouched partitions stay as they are."""
    touched = batch.select(partition_by).distinct()
    merged = batch
    if _exists(spark, path):
        current = spark.read.schema(schema).parquet(path)
        merged = upsert(current.join(touched, partition_by, "left_semi"), batch, keys)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition_by
    ).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


# --- results ---------------------------------------------------------------------

DAY_MICROS = 86_400_000_000


def versioned_results(items: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (run, id) with its version: the n-th run, by start, that holds the id."""
    starts = runs.select("run_id", F.unix_micros("started_at").alias("_start"))
    once = first_per(items.drop("version"), ["run_id", "id"], "found_on_pass", "group_id")
    return ordinal(
        once.join(starts, "run_id"), ["id"], "_start", "version", slice_size=DAY_MICROS, ties=["run_id"]
    ).drop("_start")
