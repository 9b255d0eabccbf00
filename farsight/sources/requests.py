"""Scan requests: topic groups, stable group ids, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farsight.functions.dates import strict_iso_date
from farsight.functions.text import is_blank, split_list, trim_ws
from farsight.operators.ordinals import ordinal

# Fixed value: passes a group may take.
MAX_LOOPS = 3


def read_request_dates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with typed dates, rejected rows) of requests whose dates are text.

    A date may be missing; one that is given must be an ISO date or date-time, of which the
    written local date counts.
    """
    typed = raw
    bad = F.lit(False)
    for name in ("start_date", "end_date"):
        typed = typed.withColumn(f"_{name}", strict_iso_date(F.col(name)))
        bad = bad | (F.col(name).isNotNull() & F.col(f"_{name}").isNull())
    typed = typed.withColumn("_bad", bad)
    accepted = typed.where(~F.col("_bad")).withColumns(
        {"start_date": F.col("_start_date"), "end_date": F.col("_end_date")}
    )
    helpers = ["_start_date", "_end_date", "_bad"]
    return accepted.drop(*helpers), typed.where("_bad").drop(*helpers)


def group_base_id(keywords: Column) -> Column:
    """Slug of the first keyword plus 8 hex digits over the order-free keyword set."""
    slug = F.btrim(
        F.regexp_replace(F.lower(F.try_element_at(keywords, F.lit(1))), "[^a-z0-9]+", "-"),
        F.lit("-"),
    )
    folded = F.array_join(F.array_sort(F.transform(keywords, F.lower)), "\n")
    return F.concat_ws(
        "-",
        F.when(slug == "", F.lit("group")).otherwise(slug),
        F.substring(F.sha2(folded, 256), 1, 8),
    )


def topic_groups(requests: DataFrame, max_loops: int = MAX_LOOPS) -> DataFrame:
    """Requests to one row per topic group that has a keyword, in request order.

    ``max_loops`` is the number of passes a group may take.

    Equal groups of a run share a base id; the n-th of them gets the suffix ``-n``.
    """
    rows = (
        requests.select("run_id", F.posexplode("topic_groups").alias("group_ord", "entry"))
        .withColumn("keywords", split_list(F.col("entry")))
        .where(F.size("keywords") > 0)
        .withColumn("base_id", group_base_id(F.col("keywords")))
    )
    numbered = ordinal(rows, ["run_id", "base_id"], "group_ord", "nth")
    return numbered.select(
        "run_id",
        "group_ord",
        F.when(F.col("nth") == 1, F.col("base_id"))
        .otherwise(F.concat_ws("-", "base_id", F.col("nth").cast("string")))
        .alias("group_id"),
        F.array_join("keywords", ", ").alias("group_name"),
        "keywords",
        F.lit(max_loops).alias("max_loops"),
    )


def request_issues(
    jurisdiction: Column, start_date: Column, end_date: Column, groups: Column
) -> Column:
    """Rule violations of one request as ``array<struct<property,message>>``."""

    def issue(when: Column, prop: str, message: str) -> Column:
        return F.when(when, F.struct(F.lit(prop).alias("property"), F.lit(message).alias("message")))

    length = F.length(jurisdiction)
    empty_group = F.exists(F.coalesce(groups, F.array().cast("array<string>")), is_blank)
    return F.array_compact(
        F.array(
            issue(
                F.coalesce(end_date < start_date, F.lit(False)),
                "EndDate", "endDate must be on or after startDate.",
            ),
            issue(is_blank(jurisdiction), "Jurisdiction", "'Jurisdiction' must not be empty."),
            issue(
                F.coalesce(~length.between(2, 100), F.lit(False)),
                "Jurisdiction", "'Jurisdiction' must be between 2 and 100 characters.",
            ),
            issue(
                F.coalesce(F.size(groups) <= 0, F.lit(True)),
                "TopicGroups", "At least one topic group must be selected.",
            ),
            issue(empty_group, "TopicGroups", "'Topic Groups' must not be empty."),
        )
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests with their ``issues``; a request is valid when the array is empty."""
    return requests.withColumn(
        "issues",
        request_issues(
            F.col("jurisdiction"), F.col("start_date"), F.col("end_date"), F.col("topic_groups")
        ),
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests."""
    checked = check_requests(requests)
    return (
        checked.where(F.size("issues") == 0).drop("issues"),
        checked.where(F.size("issues") > 0),
    )


def issue_property(prop: Column) -> Column:
    """Blank property names report as ``validation``."""
    return F.when(is_blank(prop), F.lit("validation")).otherwise(trim_ws(prop))


def issue_report(checked: DataFrame) -> DataFrame:
    """Per request: property -> messages as a map (built within the row, no shuffle)."""
    props = F.array_distinct(F.transform("issues", lambda i: issue_property(i["property"])))
    entries = F.transform(
        props,
        lambda p: F.struct(
            p.alias("key"),
            F.transform(
                F.filter("issues", lambda i: issue_property(i["property"]) == p),
                lambda i: i["message"],
            ).alias("value"),
        ),
    )
    return checked.where(F.size("issues") > 0).select(
        "run_id", F.map_from_entries(entries).alias("errors")
    )


def issue_counts(checked: DataFrame) -> DataFrame:
    """How often each (property, message) was raised."""
    return (
        checked.select(F.explode("issues").alias("i"))
        .groupBy(issue_property(F.col("i.property")).alias("property"), F.col("i.message"))
        .agg(F.count("*").alias("n"))
    )
