"""Record fields: dates, references, the base record and the judged overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions import answers as A
from farsight.functions.dates import iso
from farsight.functions.text import distinct_ignore_case, is_blank, trim_to_null

# Judged fields: wire name and column.
JUDGED = [
    ("titleOfUpdate", "title_of_update"),
    ("summaryOfUpdate", "summary_of_update"),
    ("companyView", "company_view"),
    ("levelOfAuthority", "level_of_authority"),
    ("statusOfChange", "status_of_change"),
    ("regulator", "regulator"),
]
RECORD_COLUMNS = [
    "jurisdiction", "impact_area", "tags", "title_of_update", "summary_of_update", "company_view",
    "level_of_authority", "status_of_change", "announcement_date", "effective_date_of_change",
    "supporting_reference", "regulator",
]
# References per text part of a group.
PART_REFERENCES = 1024


def earliest_dates(items: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest publication and effective date as text, null when none."""
    return items.groupBy(*keys).agg(
        iso(F.min("publication_date")).alias("announcement_date"),
        iso(F.min("effective_date")).alias("effective_date_of_change"),
    )


def source_references(
    items: DataFrame, keys: list[str], position: str, urls: str = "source_urls"
) -> DataFrame:
    """Distinct non-blank URLs (ignoring case, first spelling, first-seen order).

    Rows: keys, ref_pos (position of first sight), url. Repeats go in a pre-aggregated
    group-by, so a URL or group of any size is fine; ``join_references`` writes the text.
    """
    rows = items.select(
        *keys, F.col(position).alias("_p"), F.posexplode(urls).alias("_i", "url")
    ).where(~is_blank(F.col("url")))
    first = F.min(F.struct(F.col("_p"), F.col("_i"), F.col("url")))
    return (
        rows.groupBy(*keys, F.lower("url").alias("_k")).agg(first.alias("_f"))
        .select(*keys, F.col("_f._p").alias("ref_pos"), F.col("_f._i").alias("ref_sub"), F.col("_f.url").alias("url"))
    )


def join_references(references: DataFrame, keys: list[str], span: int = PART_REFERENCES) -> DataFrame:
    """References joined by ``" | "``, in parts of ``span`` positions (part 0 first)."""
    return (
        references.groupBy(*keys, F.floor(F.col("ref_pos") / span).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("ref_pos", "ref_sub", "url"))).alias("_l"))
        .select(
            *keys, "part",
            F.array_join(F.transform("_l", lambda x: x["url"]), " | ").alias("supporting_reference"),
        )
    )


def base_records(items: DataFrame) -> DataFrame:
    """Record of each item from its own fields: needs jurisdiction, impact_area and tags.

    One item per record, so dates and references need no grouping.
    """
    urls = distinct_ignore_case(F.filter("source_urls", lambda u: ~is_blank(u)))
    return (
        items.withColumn("impact_area", trim_to_null(F.col("impact_area")))
        .withColumn("announcement_date", iso(F.col("publication_date")))
        .withColumn("effective_date_of_change", iso(F.col("effective_date")))
        .withColumn(
            "supporting_reference", F.nullif(F.array_join(urls, " | "), F.lit(""))
        )
    )


def parse_labels(answers: DataFrame, area_payload: str, tags_payload: str) -> DataFrame:
    """Label answers to ``impact_area_value`` and ``tag_values`` ([] when unreadable)."""
    area = A.answer(F.col(area_payload), {"impactArea": A.text, "rationale": A.text})
    tags = A.answer(F.col(tags_payload), {"tags": A.texts, "rationale": A.text})
    return answers.withColumns({
        "impact_area_value": area["impactArea"],
        "tag_values": F.coalesce(tags["tags"], F.array().cast("array<string>")),
    })


def parse_records(answers: DataFrame, payload: str = "payload") -> DataFrame:
    """Record answers to judged columns, trimmed or null; an unreadable answer gives no row."""
    parsed = answers.withColumn("_r", A.answer(F.col(payload), {wire: A.text for wire, _ in JUDGED}))
    return parsed.where(F.col("_r").isNotNull()).select(
        *[c for c in answers.columns if c != payload],
        *[trim_to_null(F.col("_r")[wire]).alias(name) for wire, name in JUDGED],
    )


def overlay(base: DataFrame, judged: DataFrame | None, keys: list[str]) -> DataFrame:
    """Judged fields laid over base records: trimmed or null where an answer exists.

    A record without an answer keeps its own fields (null where the base has none).
    """
    names = [name for _, name in JUDGED]
    for name in names:
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast("string"))
    if judged is None:
        return base
    answers = judged.select(
        *keys, F.lit(True).alias("_judged"), *[F.col(n).alias(f"_{n}") for n in names]
    )
    joined = base.join(answers, keys, "left")
    for name in names:
        joined = joined.withColumn(
            name,
            F.when(F.col("_judged"), trim_to_null(F.col(f"_{name}"))).otherwise(F.col(name)),
        )
    return joined.drop("_judged", *[f"_{n}" for n in names])


def enrich(items: DataFrame, what_it_does=None) -> DataFrame:
    """Adds ``what_it_does`` from an optional column expression (null by default)."""
    value = what_it_does if what_it_does is not None else F.lit(None).cast("string")
    return items.withColumn("what_it_does", value)
