"""Deterministic gates before results are stored: fields, duplicates, authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farsight.functions.text import is_blank
from farsight.functions.urls import normalize_host, url_host, url_key
from farsight.operators.ordinals import first_per
from farsight.session import local_table

# Authority of source domains (with an optional path) and their order.
AUTHORITY_RULES = [
    ("legislation.gov.uk", "", "Legislation"),
    ("supremecourt.uk", "", "CourtRuling"),
    ("gov.uk", "/hm-revenue-customs", "RegulatorGuidance"),
]
AUTHORITY_RANK = {"Unknown": 0, "RegulatorGuidance": 1, "CourtRuling": 2, "Legislation": 3}
REQUIRED = ["run_id", "group_id", "id", "verdict", "date_confidence"]
VERDICTS = ["Relevant", "Borderline", "NotRelevant"]
CONFIDENCES = ["Unknown", "Low", "Medium", "High"]


def field_issues(items: DataFrame, required: list[str] = REQUIRED) -> Column:
    """Reasons an item fails the field checks (empty when it passes)."""
    checks = [
        F.when(is_blank(F.col(c).cast("string")), F.lit(f"{c} is required")) for c in required
    ]
    if "verdict" in items.columns:
        checks.append(F.when(~F.col("verdict").isin(VERDICTS), F.lit("verdict is not a known value")))
    if "date_confidence" in items.columns:
        checks.append(
            F.when(~F.col("date_confidence").isin(CONFIDENCES), F.lit("date_confidence is not a known value"))
        )
    if "source_urls" in items.columns:
        checks.append(F.when(F.coalesce(F.size("source_urls") <= 0, F.lit(True)), F.lit("source_urls is required")))
    if "version" in items.columns:
        checks.append(F.when(F.coalesce(F.col("version") < 1, F.lit(True)), F.lit("version must be positive")))
    return F.array_compact(F.array(*checks))


def quality_gate(items: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    return items.withColumn("issues", field_issues(items, required))


def unstored(items: DataFrame, stored: DataFrame, url: Column) -> DataFrame:
    """Items whose canonical URL key is not stored yet (``stored``: url_key)."""
    keyed = items.withColumn("url_key", url_key(url))
    return keyed.join(stored.select("url_key").distinct(), "url_key", "left_anti")


def authority_rules(spark, rules=AUTHORITY_RULES) -> DataFrame:
    return local_table(spark, rules, "host_suffix string, path string, authority string")


def stamp_authority(items: DataFrame, rules: DataFrame, url: str, keys: list[str]) -> DataFrame:
    """Adds ``level_of_authority`` and ``authority_rank`` by source domain.

    Each host is looked up once per suffix (``a.b.c``, ``b.c``, ``c``), so matching is an
    equi-join; the longest matching rule wins and no match is Unknown. Only probes that
    meet a rule are shuffled.
    """
    hosts = items.select(
        *keys,
        F.split(normalize_host(url_host(F.col(url))), r"\.").alias("_labels"),
        F.regexp_extract(url_key(F.col(url)), r"^[^/?]+(/[^?]*)", 1).alias("_path"),
    )
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size("_labels")),
        lambda n: F.array_join(F.slice("_labels", n, F.size("_labels")), "."),
    )
    probes = (
        hosts.where(F.col("_labels").isNotNull())
        .select(*keys, "_path", suffixes.alias("_suffixes"))
        .select(*keys, "_path", F.explode("_suffixes").alias("host_suffix"))
    )
    rank = F.create_map(*[F.lit(x) for kv in AUTHORITY_RANK.items() for x in kv])
    rule = rules.withColumnRenamed("path", "_rule_path")
    fits = (F.col("_rule_path") == "") | (F.col("_path") == F.col("_rule_path")) | F.col(
        "_path"
    ).startswith(F.concat("_rule_path", F.lit("/")))
    matched = (
        probes.join(rule, "host_suffix")
        .where(fits)
        .groupBy(*keys)
        .agg(F.max_by("authority", F.length("host_suffix") * 100000 + F.length("_rule_path")).alias("_a"))
    )
    return (
        items.drop("level_of_authority").join(matched, keys, "left")
        .withColumn("level_of_authority", F.coalesce("_a", F.lit("Unknown")))
        .withColumn("authority_rank", F.element_at(rank, F.col("level_of_authority")))
        .drop("_a")
    )


def by_authority(items: DataFrame, keys: list[str], *then: str) -> DataFrame:
    """Best item per key: higher authority first, then the given columns."""
    return first_per(items, keys, F.desc("authority_rank"), *then)


def gate(
    items: DataFrame, stored: DataFrame, rules: DataFrame, url: str, keys: list[str],
    required: list[str] = REQUIRED,
) -> tuple[DataFrame, DataFrame]:
    """(accepted with authority stamped, rejected with reasons kept for audit)."""
    checked = quality_gate(items, required).withColumn("url_key", url_key(F.col(url)))
    taken = stored.select("url_key", F.lit(True).alias("_stored")).distinct()
    marked = checked.join(taken, "url_key", "left").withColumn(
        "issues",
        F.when(F.col("_stored"), F.array_append("issues", F.lit("already stored"))).otherwise(F.col("issues")),
    ).drop("_stored")
    accepted = stamp_authority(marked.where(F.size("issues") == 0).drop("issues"), rules, url, keys)
    return accepted, marked.where(F.size("issues") > 0)
