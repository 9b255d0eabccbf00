"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Runtime SQL settings the operators rely on. UTC keeps instant -> date
# conversions stable; AQE sizes shuffles, turns small sides into broadcasts by
# their measured size and splits skewed join partitions (also where the join
# would otherwise keep its input partitioning). Pages are large rows, so Arrow batches
# hold few of them, by number and by bytes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "128",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings to ``spark`` and returns it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stage_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``, so a lost
    executor loses no stage. A local temporary folder is used only where that
    setting is unset and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="farsight-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` as parquet and returns the re-read table (flat lineage)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a local relation, whose size the optimizer knows.

    (Rows given as Python tuples become an RDD of unknown size, which is never broadcast.)
    """
    struct = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct.fields]
    arrays = [
        pa.array(values, type=to_arrow_type(field.dataType))
        for values, field in zip(columns, struct.fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=struct.names), struct)


def spread(scan: DataFrame) -> DataFrame:
    """A file scan over at least as many tasks as there are cores.

    For work that is heavy per row (parsing, tokenising) on tables of a few unsplittable
    files; a scan that already has enough tasks is returned as it is, unshuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
