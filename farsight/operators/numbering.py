"""Positions in a total order over any number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from farsight.session import stage_dir, staged


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "position", start: int = 0) -> DataFrame:
    """``df`` with each row's position among those of equal ``keys`` by ``order`` (nulls first), a long.

    The rows are range-partitioned by keys and order and written once; a key of any size spreads over
    the partitions. What is shuffled again is one count per partition and key, whose running sum is
    the offset of the partition. ``order`` has to be total for positions to be the same in every run;
    rows that agree in all of it share their positions in any order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id holds the partition in its upper bits and counts rows in its lower 33.
    written = staged(ranged.withColumn("_id", F.monotonically_increasing_id()), stage_dir(spark, "numbered"))
    sliced = written.withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start)
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_at"), "_shift")
    )
    same = F.col("_part") == F.col("_at")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    return sliced.join(offsets, same).withColumn(name, F.col("_id") + F.col("_shift")).select(*df.columns, name)
