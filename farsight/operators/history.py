"""Pass history: flat tables are the truth, the nested history is a view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.verdicts import FINALIZE, RETRY
from farsight.operators.ordinals import first_per
from farsight.schemas import HISTORY_STRUCT, HIT_STRUCT, ITEM_STRUCT, PASS_STRUCT

GROUP = ["run_id", "group_id"]
PASS = [*GROUP, "pass"]
HIT_FIELDS = ["url", "title", "domain", "source_query", "rank"]
ITEM_FIELDS = [
    "id", "found_on_pass", "source_urls", "domain", "full_text_ref", "verdict", "eval_rationale",
    "unverified", "publication_date", "effective_date", "applies_from", "applies_to",
    "date_confidence",
]
# Passes and keys one nested row may hold; a longer history has several rows.
PART_PASSES = 64
PART_KEYS = 4096


def reviewed_items(items: DataFrame, route: str) -> DataFrame:
    """Vetted (or discarded) items of all reviewed passes; order by pass, doc_index."""
    return items.where(F.col("route") == route)


def tried_queries(passes: DataFrame) -> DataFrame:
    return passes.select(*PASS, "query")


def review_notes(passes: DataFrame) -> DataFrame:
    """Notes and decisions of reviewed passes."""
    return passes.where(F.col("final_decision").isNotNull()).select(
        *PASS, "thought_process", "final_decision"
    )


def current_pass(passes: DataFrame) -> DataFrame:
    """Last pass of each group (one row per map partition and group is shuffled)."""
    return first_per(passes, GROUP, F.desc("pass"))


def loop_counts(passes: DataFrame) -> DataFrame:
    return passes.groupBy(*GROUP).agg(F.count("*").cast("int").alias("loop_count"))


def nested_passes(passes: DataFrame, hits: DataFrame, items: DataFrame) -> DataFrame:
    """One row per pass with its hits and review nested (at most one query's hits each)."""
    hit_lists = hits.groupBy(*PASS).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("rank").alias("_r"), F.struct(*HIT_FIELDS).alias("h")))),
            lambda x: x["h"],
        ).alias("hits")
    )

    def listed(route: str):
        entry = F.when(
            F.col("route") == route,
            F.struct(F.col("doc_index").alias("_i"), F.struct(*ITEM_FIELDS).alias("x")),
        )
        return F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["x"]).alias(route)

    item_lists = items.withColumn("pass", F.col("found_on_pass")).groupBy(*PASS).agg(
        listed("vetted"), listed("discarded")
    )
    empty_items = F.array().cast(f"array<{ITEM_STRUCT}>")
    review = F.when(
        F.col("final_decision").isNotNull(),
        F.struct(
            "thought_process", "llm_decision", "final_decision", "decision_override",
            "override_reason",
            F.coalesce("vetted", empty_items).alias("vetted"),
            F.coalesce("discarded", empty_items).alias("discarded"),
        ),
    )
    return (
        passes.join(hit_lists, PASS, "left").join(item_lists, PASS, "left")
        .select(
            *PASS,
            F.struct(
                "pass", "query", "query_rationale",
                F.coalesce("hits", F.array().cast(f"array<{HIT_STRUCT}>")).alias("hits"),
                review.alias("review"), "search_failed", "search_failure_reason",
            ).cast(PASS_STRUCT).alias("entry"),
        )
    )


def nested_history(
    passes: DataFrame, hits: DataFrame, items: DataFrame, processed_keys: DataFrame
) -> DataFrame:
    """``run_id, group_id, part, history``: passes in order and the keys already processed.

    Groups within the usual pass and key counts have the single part 0; longer histories
    go on in further parts, so no row grows without bound.
    """
    entries = (
        nested_passes(passes, hits, items)
        .groupBy(*GROUP, F.floor((F.col("pass") - 1) / PART_PASSES).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("pass", "entry"))).alias("_e"))
        .select(*GROUP, "part", F.transform("_e", lambda e: e["entry"]).alias("passes"))
    )
    sizes = processed_keys.groupBy(*GROUP).agg(
        F.ceil(F.count("*") / F.lit(PART_KEYS)).cast("int").alias("_parts")
    )
    keys = (
        processed_keys.join(sizes, GROUP)
        .groupBy(*GROUP, F.pmod(F.xxhash64("url_key"), F.col("_parts")).cast("int").alias("part"))
        .agg(F.array_sort(F.collect_list("url_key")).alias("processed_keys"))
    )
    return entries.join(keys, [*GROUP, "part"], "full").select(
        *GROUP, "part",
        F.struct(
            F.coalesce("passes", F.array().cast(f"array<{PASS_STRUCT}>")).alias("passes"),
            F.coalesce("processed_keys", F.array().cast("array<string>")).alias("processed_keys"),
        ).cast(HISTORY_STRUCT).alias("history"),
    )


def restore_passes(histories: DataFrame) -> DataFrame:
    """Nested history back to flat pass rows."""
    return histories.select(*GROUP, F.explode("history.passes").alias("p")).select(
        *GROUP, F.col("p.pass").alias("pass"), "p.query", "p.query_rationale",
        "p.search_failed", "p.search_failure_reason",
        F.col("p.review.thought_process").alias("thought_process"),
        F.col("p.review.llm_decision").alias("llm_decision"),
        F.col("p.review.final_decision").alias("final_decision"),
        F.col("p.review.decision_override").alias("decision_override"),
        F.col("p.review.override_reason").alias("override_reason"),
    )


def restore_keys(histories: DataFrame) -> DataFrame:
    return histories.select(*GROUP, F.explode("history.processed_keys").alias("url_key"))


def restore_items(histories: DataFrame) -> DataFrame:
    """Nested history back to flat items with their route and position."""
    passes = histories.select(*GROUP, F.explode("history.passes").alias("p"))

    def side(route: str) -> DataFrame:
        return passes.select(*GROUP, F.posexplode(f"p.review.{route}").alias("route_pos", "x")).select(
            *GROUP, "route_pos", F.lit(route).alias("route"), "x.*"
        )

    return side("vetted").unionByName(side("discarded"))


def next_passes(groups: DataFrame, passes: DataFrame) -> DataFrame:
    """Unfinished groups with the pass to run next (resume from the last saved pass)."""
    last = passes.groupBy(*GROUP).agg(
        F.max("pass").alias("_last"), F.max_by("final_decision", "pass").alias("_decision")
    )
    return (
        groups.join(last, GROUP, "left")
        .withColumn("_last", F.coalesce("_last", F.lit(0)))
        .where(
            (F.col("_last") < F.col("max_loops"))
            & (F.coalesce("_decision", F.lit(RETRY)) != FINALIZE)
        )
        .withColumn("next_pass", (F.col("_last") + 1).cast("int"))
        .drop("_last", "_decision")
    )
