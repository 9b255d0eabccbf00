"""Hits: validity, allowlist, domain rules, dedupe within and across groups, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from farsight.functions.text import is_blank, trim_ws
from farsight.functions.urls import (
    allowlist_host,
    is_absolute_http,
    normalize_host,
    url_host,
    url_key,
)
from farsight.operators.ordinals import first_per, top_per
from farsight.sources.corpus import MAX_RESULTS

# Domain-rule boost levels.
BOOST_LEVELS = ["default", "elevated", "demoted"]

RUN_KEY = ["run_id", "url_key"]
GROUP_KEY = ["run_id", "group_id", "url_key"]


def with_key(hits: DataFrame) -> DataFrame:
    return hits.withColumn("url_key", url_key(F.col("url")))


# --- allowlist -------------------------------------------------------------------


def allowed_hosts(allowlist: DataFrame) -> DataFrame:
    """Distinct (run_id, host); blank entries do not count."""
    return (
        allowlist.select("run_id", allowlist_host(F.col("entry")).alias("host"))
        .where(F.col("host").isNotNull())
        .distinct()
    )


def mark_allowed(hits: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Adds ``allowed``: the host is on the run's allowlist, or the run has none."""
    hosts = allowed_hosts(allowlist)
    listed = hosts.select("run_id", "host", F.lit(True).alias("_listed"))
    runs = hosts.select("run_id", F.lit(True).alias("_has_list")).distinct()
    return (
        hits.withColumn("host", normalize_host(url_host(trim_ws(F.col("url")))))
        .join(listed, ["run_id", "host"], "left")
        .join(runs, "run_id", "left")
        .withColumn("allowed", F.col("_listed").isNotNull() | F.col("_has_list").isNull())
        .drop("_listed", "_has_list", "host")
    )


def allowed(hits: DataFrame, allowlist: DataFrame) -> DataFrame:
    return mark_allowed(hits, allowlist).where("allowed").drop("allowed")


# --- domain rules ----------------------------------------------------------------


# What is wrong with a rule.
NO_DOMAIN = "each entry requires a non-empty 'domain'"
NO_SUB_PAGES = "include_sub_pages must be set to true or false"
BAD_BOOST = "invalid boost_level; allowed: Default, Elevated, Demoted"


def domain_rule_issues(rules: DataFrame) -> DataFrame:
    """Rules with their ``issues`` (empty when the rule is usable)."""
    boost = F.lower(trim_ws(F.col("boost_level")))
    has_boost = ~is_blank(F.col("boost_level"))
    return rules.withColumn(
        "issues",
        F.array_compact(
            F.array(
                F.when(is_blank(F.col("domain")), F.lit(NO_DOMAIN)),
                F.when(
                    F.col("include_sub_pages").isNull(),
                    F.lit(NO_SUB_PAGES),
                ),
                F.when(
                    has_boost & ~boost.isin(BOOST_LEVELS),
                    F.lit(BAD_BOOST),
                ),
                F.when(
                    has_boost & (F.col("include_sub_pages") == F.lit(False)),
                    F.lit("boost_level is set but include_sub_pages is false"),
                ),
            )
        ),
    )


def apply_domain_rules(pages: DataFrame, rules: DataFrame, page_id: str, url: str = "url") -> DataFrame:
    """Pages the rules let through, with ``boost`` (1, 0 or -1).

    A rule matches its exact page, or with ``include_sub_pages`` every page below it.
    Blocked wins over allowed; without allowed rules every page is allowed. A page is
    looked up once per path prefix, so matching is an equi-join whatever the rule count.
    """
    usable = domain_rule_issues(rules).where(F.size("issues") == 0)
    domain = trim_ws(F.col("domain"))
    absolute = F.when(is_absolute_http(domain), domain).otherwise(F.concat(F.lit("https://"), domain))
    level = F.lower(trim_ws(F.col("boost_level")))
    keyed = (
        usable.select(
            F.rtrim(url_key(absolute), F.lit("/")).alias("prefix"),
            (F.col("list") == "blocked").alias("blocked"),
            F.col("include_sub_pages").alias("sub"),
            F.when(level == "elevated", 1).when(level == "demoted", -1).otherwise(0).alias("b"),
        )
        .groupBy("prefix")
        .agg(
            F.coalesce(F.bool_or(F.col("blocked") & F.col("sub")), F.lit(False)).alias("block_below"),
            F.coalesce(F.bool_or("blocked"), F.lit(False)).alias("block_here"),
            F.coalesce(F.bool_or(~F.col("blocked") & F.col("sub")), F.lit(False)).alias("allow_below"),
            F.coalesce(F.bool_or(~F.col("blocked")), F.lit(False)).alias("allow_here"),
            F.max(F.when(~F.col("blocked") & F.col("sub"), F.col("b"))).alias("b"),
        )
    )
    keyed_pages = pages.select(page_id, F.rtrim(url_key(F.col(url)), F.lit("/")).alias("_key"))
    steps = F.split(F.split_part("_key", F.lit("?"), F.lit(1)), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("_steps")),
        lambda n: F.array_join(F.slice("_steps", F.lit(1), n), "/"),
    )
    # Columns first, explode last: what a select computes beside an explode runs per row.
    probes = (
        keyed_pages.where(F.col("_key").isNotNull())
        .withColumn("_steps", steps)
        .withColumn("_prefixes", F.array_distinct(F.array_append(prefixes, F.col("_key"))))
        .select(page_id, "_key", F.explode("_prefixes").alias("prefix"))
    )
    here = F.col("_key") == F.col("prefix")
    any_allow = keyed.agg(F.coalesce(F.bool_or("allow_here"), F.lit(False)).alias("any_allow"))
    open_list = ~any_allow.scalar()
    verdicts = (
        probes.join(keyed, "prefix")
        .groupBy(page_id)
        .agg(
            F.bool_or(F.col("block_below") | (here & F.col("block_here"))).alias("_blocked"),
            F.bool_or(F.col("allow_below") | (here & F.col("allow_here"))).alias("_allowed"),
            F.max("b").alias("_boost"),
        )
    )
    return (
        pages.where(is_absolute_http(trim_ws(F.col(url))))
        .join(verdicts, page_id, "left")
        .where(~F.coalesce("_blocked", F.lit(False)) & F.coalesce("_allowed", open_list))
        .withColumn("boost", F.coalesce("_boost", F.lit(0)))
        .drop("_blocked", "_allowed", "_boost")
    )


# --- ranks of one search ---------------------------------------------------------


def rank_citations(
    citations: DataFrame,
    keys: list[str],
    allowlist: DataFrame | None = None,
    k: int = MAX_RESULTS,
    position: str = "pos",
) -> DataFrame:
    """Citations of each query to ranked hits.

    Only absolute http(s) URLs on the allowlist count; exact repeats ignoring case are
    dropped; the first ``k`` in citation order get ranks 1..k.
    """
    usable = citations.where(is_absolute_http(F.col("url")))
    if allowlist is not None:
        usable = allowed(usable, allowlist)
    distinct = first_per(usable, [*keys, F.lower("url")], position)
    return top_per(distinct, keys, k, position).withColumn("domain", url_host(F.col("url")))


def off_allowlist_counts(
    citations: DataFrame,
    keys: list[str],
    allowlist: DataFrame,
    k: int = MAX_RESULTS,
    position: str = "pos",
) -> DataFrame:
    """Per query: off-allowlist citations seen before the k-th hit was reached."""
    marked = mark_allowed(citations.where(is_absolute_http(F.col("url"))), allowlist)
    kth = (
        rank_citations(citations, keys, allowlist, k, position)
        .where(F.col("rank") == k)
        .select(*keys, F.col(position).alias("_kth"))
    )
    before = F.col("_kth").isNull() | (F.col(position) < F.col("_kth"))
    return (
        marked.where(~F.col("allowed"))
        .join(kth, keys, "left")
        .groupBy(*keys)
        .agg(F.count_if(before).alias("off_allowlist"))
        .where(F.col("off_allowlist") > 0)
    )


# --- dedupe ----------------------------------------------------------------------

ORDER = ["pass", "group_ord", "rank"]


def unseen(hits: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Hits whose key is not among the seen keys (null keys never match)."""
    return hits.join(seen.select(*keys).distinct(), keys, "left_anti")


def prefilter(
    hits: DataFrame, seen_in_group: DataFrame | None = None, seen_in_run: DataFrame | None = None
) -> DataFrame:
    """Hits that survive: valid, new to their group, new to their run.

    First wins by (pass, group order, rank). The first hit of a key in its group that
    is also first in the run is simply the first of the run, so one window does both.
    """
    keyed = with_key(hits).where(F.col("url_key").isNotNull())
    if seen_in_group is not None:
        keyed = unseen(keyed, seen_in_group, GROUP_KEY)
    if seen_in_run is not None:
        keyed = unseen(keyed, seen_in_run, RUN_KEY)
    return first_per(keyed, RUN_KEY, *ORDER, "group_id", "url")


def new_group_keys(hits: DataFrame, seen_in_group: DataFrame | None = None) -> DataFrame:
    """Keys each group meets for the first time, with the pass it meets them in.

    A key lost to another group of the run counts as seen by its own group too.
    """
    keyed = with_key(hits).where(F.col("url_key").isNotNull())
    if seen_in_group is not None:
        keyed = unseen(keyed, seen_in_group, GROUP_KEY)
    return keyed.groupBy(*GROUP_KEY).agg(F.min("pass").alias("pass"))


def seen_keys(*tables: DataFrame, keys: list[str] = GROUP_KEY) -> DataFrame:
    """Distinct union of key tables."""
    union = tables[0].select(*keys)
    for table in tables[1:]:
        union = union.unionByName(table.select(*keys))
    return union.distinct()


def prefilter_counts(
    hits: DataFrame, seen_in_group: DataFrame | None = None, seen_in_run: DataFrame | None = None
) -> DataFrame:
    """Per (run, group, pass): hits in, kept, invalid, in-group and cross-group repeats.

    Hits are first counted per group, pass and key (map-side), which leaves a key one row
    per group and pass whatever share of the hits it has; the windows see only those rows,
    and a key is worked out once per hit.
    """
    pass_key = ["run_id", "group_id", "pass"]
    counted = (
        with_key(hits)
        .groupBy("run_id", "group_id", "group_ord", "pass", "url_key")
        .agg(F.count("*").alias("n"), F.min("rank").alias("rank"))
    )
    valid = F.col("url_key").isNotNull()
    for seen, keys, flag in (
        (seen_in_group, GROUP_KEY, "_in_group"), (seen_in_run, RUN_KEY, "_in_run"),
    ):
        if seen is None:
            counted = counted.withColumn(flag, F.lit(False))
        else:
            marks = seen.select(*keys).distinct().withColumn(flag, F.lit(True))
            counted = counted.join(marks, keys, "left").fillna(False, [flag])
    in_group = Window.partitionBy(*GROUP_KEY).orderBy("pass")
    in_run = Window.partitionBy(*RUN_KEY, "_new").orderBy(*ORDER, "group_id")
    labelled = counted.withColumn(
        "_new", valid & ~F.col("_in_group") & (F.row_number().over(in_group) == 1)
    ).withColumn("_kept", F.col("_new") & ~F.col("_in_run") & (F.row_number().over(in_run) == 1))
    return (
        labelled.groupBy(*pass_key)
        .agg(
            F.sum("n").alias("n_in"),
            F.count_if("_kept").alias("kept"),
            F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid"),
            F.sum(F.when(valid, F.col("n") - F.col("_new").cast("int")).otherwise(0)).alias("dupe_group"),
            F.count_if(F.col("_new") & ~F.col("_kept")).alias("dupe_cross_group"),
        )
    )
