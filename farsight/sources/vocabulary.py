"""Controlled vocabularies: seeding and scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farsight.functions.text import fold, is_blank, trim_ws
from farsight.operators.ordinals import first_per
from farsight.schemas import VOCABULARY
from farsight.session import local_table

IMPACT_AREA_TYPE, TAG_TYPE = "ImpactAreas", "tags"

# The two built-in taxonomies.
IMPACT_AREAS = [
    "Administration of employment taxes withholding & payments",
    "Employer tax reporting/filing requirements",
    "Taxation of equity & incentives",
    "Taxation of fringe benefits and employee expenses",
    "International/expat tax arrangements",
    "Employment taxes authority enforcement procedures",
    "Employment taxes rates & thresholds",
    "Employment taxes impact of termination/severance pay & benefits",
    "Employment taxes updates related to state of emergency",
    "Taxation of contractors and contingent labour",
    "Governance and controls of employment taxes requirements",
]
TAGS = [
    "Payroll Reporting", "National Insurance", "Social Security", "International Tax Treaties",
    "Remote Work", "PE", "Expat tax regime", "s.690", "Overseas Workday Relief", "Company Cars",
    "Evs", "Benefits In Kind", "ECOS", "Class 2 NIC", "CIS", "Construction",
    "Tax Authority Enforcement", "Employee Benefits", "Exemptions", "Eye Tests", "IR35",
    "Off Payroll", "End Client", "Remote Working", "Home Exemption", "Tax Return Deduction",
    "Pensions", "Salary Sacrifice", "Fuel Rates", "Income Tax",
]


def vocabulary_rows(names: DataFrame, doc_type: str) -> DataFrame:
    """A ``name`` column to vocabulary documents with ids derived from type and name."""
    return names.select(
        F.sha2(F.concat_ws("|", F.lit(doc_type), fold(F.col("name"))), 256).alias("id"),
        F.lit(doc_type).alias("doc_type"),
        "name",
    )


def builtin_vocabulary(spark: SparkSession) -> DataFrame:
    rows = [(n, IMPACT_AREA_TYPE) for n in IMPACT_AREAS] + [(n, TAG_TYPE) for n in TAGS]
    names = local_table(spark, rows, "name string, t string")
    return vocabulary_rows(names.where(F.col("t") == IMPACT_AREA_TYPE), IMPACT_AREA_TYPE).unionByName(
        vocabulary_rows(names.where(F.col("t") == TAG_TYPE), TAG_TYPE)
    )


def seed_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Writes the types present in ``vocabulary``; seeding again leaves the same rows."""
    first_per(vocabulary, ["id"], "name").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("doc_type").parquet(path)


def read_vocabulary(spark: SparkSession, path: str, doc_type: str) -> DataFrame:
    """Terms of one type; only that type's partition is read."""
    table = spark.read.schema(VOCABULARY).parquet(path)
    return vocabulary_terms(table, doc_type)


def vocabulary_terms(vocabulary: DataFrame, doc_type: str) -> DataFrame:
    """``key, name`` of one type: trimmed, blanks dropped, distinct ignoring case.

    The first spelling in name order wins; order by ``name`` where order matters.
    """
    terms = vocabulary.where((F.col("doc_type") == doc_type) & ~is_blank(F.col("name")))
    # min over (stored name) keeps the reference order: sorted by the untrimmed name.
    return (
        terms.groupBy(fold(F.col("name")).alias("key"))
        .agg(F.min("name").alias("name"))
        .select("key", trim_ws(F.col("name")).alias("name"))
    )
