"""Row numbers and ordered text parts that do not put a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Order values per slice. Where the order column is unique in its group (ranks,
# positions, ids), a slice holds at most this many rows, however large the group.
SLICE = 8192
# Joins one row per group and slice to the rows. Both have as many rows as the input has groups, while file sizes, by
# which a side is broadcast before it is measured, say little of rows that are unpacked and exploded: neither is broadcast.
PER_SLICE = "merge"
# Rows per text part.
PART_ROWS = 64


def ordinal(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str,
    start: int = 1,
    slice_size: int = SLICE,
    ties: list[str] | None = None,
) -> DataFrame:
    """Numbers the rows of each group by an integer order column.

    Rows are numbered within slices of the order's value range; a running sum over
    the (small, pre-aggregated) slice counts gives each slice its offset. The rows
    themselves are shuffled once, by group and slice. ``ties`` orders equal values.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / slice_size))
    by_slice = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*by_slice).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*by_slice).orderBy(order, *(ties or []))
    numbered = sliced.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(offsets.hint(PER_SLICE), by_slice)
        .withColumn(name, (F.col("_offset") + F.col("_row") + (start - 1)).cast("int"))
        .drop("_slice", "_row", "_offset")
    )


def last_before(
    df: DataFrame, keys: list[str], order: str, value: str, name: str, slice_size: int = SLICE
) -> DataFrame:
    """Adds the nearest earlier non-null ``value`` of each row's group (as-of on position).

    Looks back within the row's slice first; what comes in from earlier slices is a
    running last over one pre-aggregated value per slice.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / slice_size))
    by_slice = [*keys, "_slice"]
    earlier_slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        sliced.groupBy(*by_slice)
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier_slices))
        .drop("_last")
    )
    within = Window.partitionBy(*by_slice).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_near", F.last(value, ignorenulls=True).over(within))
        .join(carried.hint(PER_SLICE), by_slice)
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_slice", "_near", "_carry")
    )


def text_parts(
    lines: DataFrame, keys: list[str], ord_col: str, text_col: str, rows: int = PART_ROWS
) -> DataFrame:
    """Ordered rows to text parts of at most ``rows`` rows: keys, part, text.

    A group's whole text is its parts joined by newlines in part order, so a group
    of any size never meets in one task; groups of up to ``rows`` rows have one part.
    """
    return (
        lines.groupBy(*keys, F.floor((F.col(ord_col)) / rows).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(text_col).alias("t")))).alias("_l"))
        .select(*keys, "part", F.array_join(F.transform("_l", lambda x: x["t"]), "\n").alias("text"))
    )


def first_per(df: DataFrame, keys: list[Column | str], *order: Column | str) -> DataFrame:
    """First row of each key by a total order.

    Spark limits each map-side partition to one row per key before the shuffle, so a
    key that holds a third of all rows sends one row per partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_per(
    df: DataFrame, keys: list[Column | str], k: int, *order: Column | str, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each key with their 1-based rank (limited before the shuffle too)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
