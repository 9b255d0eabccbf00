"""Controlled-vocabulary labels and prior-record exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.text import fold
from farsight.operators.ordinals import top_per

# Fixed value: exemplars per jurisdiction.
MAX_EXEMPLARS = 5


def single_label(
    items: DataFrame, terms: DataFrame, value: str, name: str = "impact_area"
) -> DataFrame:
    """Canonical spelling of a label value; off-list, blank or an empty vocabulary is null."""
    lookup = terms.select(F.col("key").alias("_key"), F.col("name").alias(name))
    return items.join(lookup, fold(F.col(value)) == F.col("_key"), "left").drop("_key")


def multi_label(
    items: DataFrame, terms: DataFrame, keys: list[str], values: str, name: str = "tags"
) -> DataFrame:
    """Canonical spellings of a list of label values, off-list and repeats dropped.

    First-occurrence order is kept; items without any get []. Repeats are removed
    before values are collected, so an item holds at most one value per term.
    """
    lookup = terms.select(F.col("key").alias("_key"), F.col("name").alias("_name"))
    matched = (
        items.select(*keys, F.posexplode(values).alias("_pos", "_v"))
        .select(*keys, "_pos", fold(F.col("_v")).alias("_key"))
        .join(lookup, "_key")
        .groupBy(*keys, "_name").agg(F.min("_pos").alias("_pos"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_l"))
        .select(*keys, F.transform("_l", lambda x: x["_name"]).alias(name))
    )
    return items.join(matched, keys, "left").withColumn(
        name, F.coalesce(name, F.array().cast("array<string>"))
    )


def exemplars(priors: DataFrame, k: int = MAX_EXEMPLARS) -> DataFrame:
    """First ``k`` prior records per jurisdiction in file order."""
    return top_per(
        priors.withColumn("jurisdiction_key", fold(F.col("jurisdiction"))),
        ["jurisdiction_key"], k, "file_pos", rank="exemplar_rank",
    )


def exemplar_lists(priors: DataFrame, k: int = MAX_EXEMPLARS) -> DataFrame:
    """``jurisdiction_key, exemplars`` with at most ``k`` records in the array."""
    fields = [c for c in priors.columns if c != "file_pos"]
    return (
        exemplars(priors, k)
        .groupBy("jurisdiction_key")
        .agg(F.array_sort(F.collect_list(F.struct("exemplar_rank", *fields))).alias("exemplars"))
    )


def attach_exemplars(groups: DataFrame, priors: DataFrame, k: int = MAX_EXEMPLARS) -> DataFrame:
    """Groups with their jurisdiction's exemplars (joined once per group, [] when none)."""
    lists = exemplar_lists(priors, k)
    return (
        groups.withColumn("jurisdiction_key", fold(F.col("jurisdiction")))
        .join(lists, "jurisdiction_key", "left")
        .withColumn("n_exemplars", F.coalesce(F.size("exemplars"), F.lit(0)))
        .drop("jurisdiction_key")
    )


def merge_labels(items: DataFrame, areas: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Two independent label tables (or one that has both) merged onto the items."""
    if areas is tags:
        merged = items.join(areas.select(*keys, "impact_area", "tags"), keys, "left")
    else:
        merged = items.join(areas.select(*keys, "impact_area"), keys, "left").join(
            tags.select(*keys, "tags"), keys, "left"
        )
    return merged.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
