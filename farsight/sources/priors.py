"""Prior records: the CSV scan and per-jurisdiction counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from farsight.functions.text import fold, is_blank, split_list, trim_ws
from farsight.schemas import PRIOR_COLUMNS

PRIOR_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for _, name in PRIOR_COLUMNS if name != "tags"]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("file_pos", T.LongType())]
)


def read_priors(spark: SparkSession, path: str | None) -> DataFrame:
    """Prior-record CSV, matched by header name; a missing path or file is an empty table.

    Quoted cells may span lines. Only rows with a jurisdiction and a company view
    stay, which also drops the description row under the header. ``file_pos``
    increases in file order.
    """
    if not path or not path.strip():
        return spark.createDataFrame([], PRIOR_SCHEMA)
    options = dict(
        header=True, multiLine=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE",
    )
    try:
        raw = spark.read.options(**options).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], PRIOR_SCHEMA)
    return prior_records(raw.withColumn("file_pos", F.monotonically_increasing_id()))


def prior_records(raw: DataFrame) -> DataFrame:
    """Header-named string columns (absent ones are null) to typed prior records."""
    have = {c.strip(): c for c in raw.columns}

    def cell(header: str):
        return F.col(f"`{have[header]}`") if header in have else F.lit(None).cast("string")

    columns = [
        split_list(cell(h)).alias(n) if n == "tags" else trim_ws(cell(h)).alias(n)
        for h, n in PRIOR_COLUMNS
    ]
    return raw.select(*columns, "file_pos").where(
        ~is_blank(F.col("jurisdiction")) & ~is_blank(F.col("company_view"))
    )


def prior_counts(priors: DataFrame) -> DataFrame:
    """Records per jurisdiction (ignoring case) with the grand total as the null row."""
    return priors.rollup(fold(F.col("jurisdiction")).alias("jurisdiction")).agg(
        F.count("*").alias("n_records")
    )


def export_columns(records: DataFrame) -> DataFrame:
    """Published updates in the prior-record column order, tags as a comma list."""
    return records.select(
        *[(F.array_join(n, ", ") if n == "tags" else F.col(n)).alias(h) for h, n in PRIOR_COLUMNS]
    )


def write_csv(records: DataFrame, path: str) -> None:
    """Writes the export as CSV that ``read_priors`` reads back."""
    export_columns(records).write.mode("overwrite").options(
        header=True, escape='"', quoteAll=True
    ).csv(path)
