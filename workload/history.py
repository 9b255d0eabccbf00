"""History, status, snapshot and result-assembly queries; conversations are pass histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions import verdicts as W
from farsight.operators import history as H
from farsight.operators import metrics as M
from farsight.operators.ordinals import last_before
from farsight.operators.verdicts import still_active
from farsight.plans.scan import scan_results
from farsight.session import stage_dir
from farsight.sources import snapshots as N
from workload.registry import Tables, query

# A conversation is a group, a turn a pass; the turn's first words are its query, an
# assistant turn is a reviewed pass, a system turn a failed search.


def run():
    """Every conversation is a run of its own."""
    return F.concat(F.lit("run "), F.col("conv_id").cast("string")).alias("run_id")


def turns(t: Tables) -> DataFrame:
    role = F.col("role")
    reviewed = role == "assistant"
    return t.conversations.select(
        run(), F.col("conv_id").cast("string").alias("group_id"), (F.col("turn") + 1).cast("int").alias("pass"),
        F.col("text").alias("query"), F.lit(None).cast("string").alias("query_rationale"),
        (role == "system").alias("search_failed"), F.when(role == "system", "timeout").alias("search_failure_reason"),
        F.when(reviewed, F.concat(F.lit("note "), F.col("turn").cast("string"))).alias("thought_process"),
        F.when(reviewed, W.RETRY).alias("llm_decision"),
        F.when(reviewed, F.when(F.length("text") > 500, W.FINALIZE).otherwise(W.RETRY)).alias("final_decision"),
        F.when(reviewed, F.length("text") > 500).alias("decision_override"),
        F.when(reviewed & (F.length("text") > 500), "cap").alias("override_reason"),
    )


def sentences(t: Tables) -> DataFrame:
    """Sentences of every turn as hits with ranks."""
    parts = F.filter(F.split("text", r"\. ?"), lambda s: s != "")
    return t.conversations.select("conv_id", "turn", "role", F.posexplode(parts).alias("pos", "s"))


def turn_hits(t: Tables) -> DataFrame:
    return sentences(t).select(
        run(), F.col("conv_id").cast("string").alias("group_id"), (F.col("turn") + 1).cast("int").alias("pass"),
        (F.col("pos") + 1).alias("rank"), F.concat(F.lit("https://example.org/"), F.sha2("s", 256)).alias("url"),
        F.lit(None).cast("string").alias("title"), F.lit("example.org").alias("domain"), F.col("role").alias("source_query"),
    )


def turn_items(t: Tables) -> DataFrame:
    """Sentences of assistant turns as items; short ones are discarded."""
    none = F.lit(None).cast("date")
    return sentences(t).where(F.col("role") == "assistant").select(
        run(), F.col("conv_id").cast("string").alias("group_id"), (F.col("turn") + 1).cast("int").alias("found_on_pass"),
        F.col("pos").alias("doc_index"), F.substring(F.sha2("s", 256), 1, 16).alias("id"),
        F.array(F.concat(F.lit("https://example.org/"), F.sha2("s", 256))).alias("source_urls"), F.lit("example.org").alias("domain"),
        F.lit(None).cast("string").alias("full_text_ref"), F.when(F.length("s") > 40, W.RELEVANT).otherwise(W.NOT_RELEVANT).alias("verdict"),
        F.col("s").alias("eval_rationale"), F.lit(False).alias("unverified"), F.lit("2025-06-15").cast("date").alias("publication_date"),
        none.alias("effective_date"), none.alias("applies_from"), none.alias("applies_to"), F.lit(W.HIGH).alias("date_confidence"),
        F.when(F.length("s") > 40, "vetted").otherwise("discarded").alias("route"),
    )


def turn_keys(t: Tables) -> DataFrame:
    return turn_hits(t).select("run_id", "group_id", F.col("url").alias("url_key")).distinct()


def histories(t: Tables) -> DataFrame:
    return H.nested_history(turns(t), turn_hits(t), turn_items(t), turn_keys(t))


def round_trip(t: Tables) -> DataFrame:
    return N.parse_history(N.history_json(histories(t)))


SQL_TURNS = """
  t AS (SELECT CAST(conv_id AS VARCHAR) AS group_id, CAST(turn + 1 AS INTEGER) AS pass, role, text, turn,
    CASE WHEN role = 'assistant' THEN CASE WHEN length(text) > 500 THEN 'Finalize' ELSE 'Retry' END END AS final_decision FROM conversations),
  s AS (SELECT group_id, pass, role, unnest(list_filter(string_split_regex(text, '\\. ?'), lambda x: x <> '')) AS s,
    unnest(range(len(list_filter(string_split_regex(text, '\\. ?'), lambda x: x <> '')))) AS pos FROM t)"""


@query(
    "history_roundtrip",
    f"""WITH {SQL_TURNS} SELECT group_id, pass, text AS query, role = 'system' AS search_failed,
    CASE WHEN role = 'assistant' THEN 'note ' || turn END AS thought_process, final_decision,
    CASE WHEN role = 'assistant' THEN length(text) > 500 END AS decision_override FROM t""",
)
def history_roundtrip(t):
    return H.restore_passes(round_trip(t)).select(
        "group_id", "pass", "query", "search_failed", "thought_process", "final_decision", "decision_override"
    )


@query(
    "history_items",
    f"""WITH {SQL_TURNS}, i AS (SELECT *, CASE WHEN length(s) > 40 THEN 'vetted' ELSE 'discarded' END AS route FROM s WHERE role = 'assistant')
  SELECT group_id, pass AS found_on_pass, route, CAST(row_number() OVER (PARTITION BY group_id, pass, route ORDER BY pos) - 1 AS INTEGER) AS route_pos,
    s AS eval_rationale, '2025-06-15' AS publication_date FROM i""",
)
def history_items(t):
    return H.restore_items(round_trip(t)).select(
        "group_id", "found_on_pass", "route", "route_pos", "eval_rationale",
        F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"),
    )


@query(
    "history_keys",
    f"""WITH {SQL_TURNS} SELECT DISTINCT group_id, 'https://example.org/' || sha256(s) AS url_key FROM s""",
)
def history_keys(t):
    return H.restore_keys(round_trip(t)).drop("run_id")


@query(
    "history_nested",
    f"""WITH {SQL_TURNS}, p AS (SELECT group_id, count(*) AS n_passes, string_agg(pass, ',' ORDER BY pass) AS passes FROM t GROUP BY 1),
  h AS (SELECT group_id, count(*) AS n_hits FROM s GROUP BY 1), k AS (SELECT group_id, count(DISTINCT s) AS n_keys FROM s GROUP BY 1)
  SELECT group_id, CAST(0 AS INTEGER) AS part, CAST(n_passes AS INTEGER) AS n_passes, passes, CAST(n_hits AS INTEGER) AS n_hits, CAST(n_keys AS INTEGER) AS n_keys
  FROM p JOIN h USING (group_id) JOIN k USING (group_id)""",
)
def history_nested(t):
    return histories(t).select(
        "group_id", "part", F.size("history.passes").alias("n_passes"),
        F.array_join(F.transform("history.passes", lambda p: p["pass"].cast("string")), ",").alias("passes"),
        F.aggregate("history.passes", F.lit(0), lambda a, p: a + F.size(p["hits"])).alias("n_hits"),
        F.size("history.processed_keys").alias("n_keys"),
    )


@query(
    "history_views",
    f"""WITH {SQL_TURNS} SELECT 'query' AS kind, group_id, pass, text AS value FROM t
  UNION ALL SELECT 'review', group_id, pass, 'note ' || turn || ' ' || final_decision FROM t WHERE role = 'assistant'
  UNION ALL SELECT 'vetted', group_id, pass, s FROM s WHERE role = 'assistant' AND length(s) > 40
  UNION ALL SELECT 'discarded', group_id, pass, s FROM s WHERE role = 'assistant' AND length(s) <= 40""",
)
def history_views(t):
    """Queries, review notes and decisions, vetted and discarded items over all passes."""
    passes, rows = turns(t), turn_items(t)
    key = ["group_id", "pass"]
    views = H.tried_queries(passes).select(F.lit("query").alias("kind"), *key, F.col("query").alias("value"))
    views = views.unionByName(H.review_notes(passes).select(
        F.lit("review").alias("kind"), *key, F.concat_ws(" ", "thought_process", "final_decision").alias("value")
    ))
    for route in ("vetted", "discarded"):
        views = views.unionByName(H.reviewed_items(rows, route).select(
            F.lit(route).alias("kind"), "group_id", F.col("found_on_pass").alias("pass"), F.col("eval_rationale").alias("value")
        ))
    return views


@query(
    "current_pass",
    f"""WITH {SQL_TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pass DESC) AS rn, count(*) OVER (PARTITION BY group_id) AS n FROM t)
  SELECT group_id, pass, text AS query, CAST(n AS INTEGER) AS loop_count FROM r WHERE rn = 1""",
)
def current_pass(t):
    passes = turns(t)
    return H.current_pass(passes).join(H.loop_counts(passes), H.GROUP).select("group_id", "pass", "query", "loop_count")


MAX_LOOPS = 6


def turn_groups(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        run(), F.col("conv_id").cast("string").alias("group_id"),
        F.col("conv_id").cast("int").alias("group_ord"), F.lit(MAX_LOOPS).alias("max_loops"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("group_name"),
    )


@query(
    "resume_next_pass",
    f"""WITH {SQL_TURNS}, l AS (SELECT group_id, max(pass) AS last, arg_max(coalesce(final_decision, 'Retry'), pass) AS d FROM t GROUP BY 1)
  SELECT group_id, CAST(last + 1 AS INTEGER) AS next_pass FROM l WHERE last < {MAX_LOOPS} AND d <> 'Finalize'""",
)
def resume_next_pass(t):
    return H.next_passes(turn_groups(t), turns(t)).select("group_id", "next_pass")


@query(
    "active_groups",
    f"""WITH {SQL_TURNS}, l AS (SELECT group_id, max(pass) AS last, arg_max(coalesce(final_decision, 'Retry'), pass) AS d FROM t GROUP BY 1)
  SELECT group_id, last AS pass FROM l WHERE last < {MAX_LOOPS} AND d = 'Retry'""",
)
def active_groups(t):
    last = H.current_pass(turns(t)).withColumn("max_loops", F.lit(MAX_LOOPS))
    return still_active(last).select("group_id", "pass")


@query(
    "group_status",
    f"""WITH {SQL_TURNS}, c AS (SELECT group_id, count(*) AS carried FROM s WHERE role = 'assistant' AND length(s) > 40 GROUP BY 1),
  l AS (SELECT group_id, count(*) AS n, arg_max(role, pass) AS last_role FROM t WHERE pass = 1 OR role <> 'user' GROUP BY 1)
  SELECT group_id, CAST(n AS INTEGER) AS loop_count, coalesce(carried, 0) AS carried,
    CASE WHEN coalesce(carried, 0) = 0 AND last_role = 'system' THEN 'Failed' ELSE 'Completed' END AS status FROM l LEFT JOIN c USING (group_id)""",
)
def group_status(t):
    """Over the first and the non-user turns, so that groups end on every kind of pass."""
    passes = turns(t).join(
        t.conversations.select(F.col("conv_id").cast("string").alias("group_id"), (F.col("turn") + 1).cast("int").alias("pass"), "role"),
        ["group_id", "pass"],
    ).where((F.col("pass") == 1) | (F.col("role") != "user"))
    groups = turn_groups(t).join(passes.select("group_id").distinct(), "group_id", "left_semi")
    return M.group_status(groups, passes, turn_items(t)).select("group_id", "loop_count", "carried", "status")


# --- runs: event days are runs, users are groups --------------------------------------------


def run_results(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyyMMdd").alias("run_id"), F.col("user_id").cast("string").alias("group_id")).agg(
        F.when(F.bool_or(F.col("event_type") == "purchase"), M.COMPLETED).otherwise(M.FAILED).alias("status"),
    )


@query(
    "run_outcomes",
    """WITH g AS (SELECT strftime(ts, '%Y%m%d') AS run_id, user_id, bool_or(event_type = 'purchase') AS ok FROM events GROUP BY 1, 2),
  r AS (SELECT strftime(ts, '%Y%m%d') AS run_id, date_diff('microsecond', min(ts), max(ts)) // 1000 AS duration_ms FROM events GROUP BY 1)
  SELECT run_id, count(*) AS n_groups, count(*) FILTER (NOT ok) AS n_failed, any_value(duration_ms) AS duration_ms FROM g JOIN r USING (run_id) GROUP BY 1""",
)
def run_outcomes(t):
    runs = t.events.groupBy(F.date_format("ts", "yyyyMMdd").alias("run_id")).agg(
        F.min("ts").cast("timestamp").alias("started_at"), F.max("ts").cast("timestamp").alias("completed_at")
    )
    return M.run_outcomes(run_results(t), runs)


@query(
    "status_counts",
    """SELECT CASE WHEN ok THEN 'Completed' ELSE 'Failed' END AS status, count(*) AS n_groups
  FROM (SELECT bool_or(event_type = 'purchase') AS ok FROM events GROUP BY strftime(ts, '%Y%m%d'), user_id) GROUP BY 1""",
)
def status_counts(t):
    return M.status_counts(run_results(t))


# --- sinks read back ---------------------------------------------------------------------------


@query(
    "full_text_snapshots",
    r"""SELECT doc_id, CASE WHEN lang <> 'de' AND regexp_matches(text, '[^\s\x{85}\p{Z}]')
      THEN 'fulltext/run-' || lang || '/' || source || '/' || doc_id || '.txt' END AS full_text_ref,
    CASE WHEN lang <> 'de' AND regexp_matches(text, '[^\s\x{85}\p{Z}]') THEN sha256(text) END AS text_hash FROM documents""",
)
def full_text_snapshots(t):
    """Vetted texts written by run and pass, read back by reference; German items are discarded."""
    rows = t.documents.select(
        F.concat(F.lit("run-"), "lang").alias("run_id"), F.col("source").alias("group_id"), F.col("doc_id").cast("string").alias("id"),
        F.lit(1).alias("found_on_pass"), F.when(F.col("lang") == "de", "discarded").otherwise("vetted").alias("route"),
        F.col("text").alias("cleaned_text"), "doc_id",
    )
    referenced = N.with_full_text_ref(rows)
    path = stage_dir(t.spark, "fulltext")
    N.write_full_text(referenced, path)
    back = N.attach_full_text(referenced.drop("cleaned_text"), N.read_full_text(t.spark, path))
    return back.select("doc_id", "full_text_ref", F.sha2("full_text", 256).alias("text_hash"))


def turn_snapshots(t: Tables) -> str:
    """Path of a written snapshot table: every turn, its parent the turn before."""
    path = stage_dir(t.spark, "snapshots")
    N.write_snapshots(t.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("checkpoint_id"),
        F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_checkpoint_id"),
        F.col("text").alias("value_json"), F.lit(1).cast("long").alias("seq"),
    ), path)
    return path


@query(
    "snapshot_children",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS checkpoint_id, CAST(turn - 1 AS VARCHAR) AS parent_checkpoint_id, text AS value_json
  FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user')""",
)
def snapshot_children(t):
    """Children of every turn of a user; first turns have no parent."""
    parents = t.conversations.where(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("parent_checkpoint_id"))
    return N.child_snapshots(t.spark, turn_snapshots(t), parents).select("session_id", "checkpoint_id", "parent_checkpoint_id", "value_json")


@query(
    "snapshot_reads",
    """SELECT CAST(c.conv_id AS VARCHAR) AS session_id, CAST(c.turn + 1 AS VARCHAR) AS checkpoint_id, n.text AS value_json,
    CASE WHEN n.turn IS NULL THEN 'snapshot ' || (c.turn + 1) || ' not found for session ' || c.conv_id END AS error
  FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""",
)
def snapshot_reads(t):
    """The snapshot after every turn; the one after the last is missing, which is an error of its row."""
    asked = t.conversations.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("string").alias("checkpoint_id"))
    return N.read_snapshots(t.spark, turn_snapshots(t), asked).select("session_id", "checkpoint_id", "value_json", "error")


@query(
    "snapshot_index",
    """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS checkpoint_id,
    CASE WHEN turn > 0 THEN CAST(turn - 1 AS VARCHAR) END AS parent_checkpoint_id, text AS value_json FROM conversations""",
)
def snapshot_index(t):
    """Every turn a snapshot whose parent is the turn before; a first write of each is superseded."""
    rows = t.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("checkpoint_id"),
        F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent_checkpoint_id"),
        F.col("text").alias("value_json"), F.lit(2).cast("long").alias("seq"),
    )
    path = stage_dir(t.spark, "snapshots")
    N.write_snapshots(rows.withColumn("value_json", F.lit("draft")).withColumn("seq", F.lit(1).cast("long")), path)
    N.write_snapshots(rows, path)
    return N.latest_snapshots(t.spark, path).select(
        "session_id", "checkpoint_id", "parent_checkpoint_id", "value_json"
    )


@query(
    "scan_results",
    f"""WITH {SQL_TURNS}, v AS (SELECT group_id, string_agg(s, '|' ORDER BY pass, pos) AS items FROM s WHERE role = 'assistant' AND length(s) > 40 GROUP BY 1)
  SELECT group_id, CAST(group_id AS INTEGER) AS group_ord, 'Conversation ' || group_id AS group_name, '2026-01-01' AS started, items
  FROM (SELECT DISTINCT group_id FROM t) g LEFT JOIN v USING (group_id)""",
)
def result_assembly(t):
    """Nested group results in request order; items in pass and document order."""
    results = M.group_status(turn_groups(t), turns(t), turn_items(t))
    records = turn_items(t).where(F.col("route") == "vetted").withColumns({
        "jurisdiction": F.lit("UK"), "impact_area": F.lit(None).cast("string"), "tags": F.array(F.lit("x")),
        "title_of_update": F.col("eval_rationale"), "summary_of_update": F.lit(""), "company_view": F.lit(""),
        "level_of_authority": F.lit(""), "status_of_change": F.lit(""), "announcement_date": F.lit(""),
        "effective_date_of_change": F.lit(""), "supporting_reference": F.lit(""), "regulator": F.lit(""),
    })
    requests = t.conversations.select(run()).distinct().withColumn("started_at", F.lit("2026-01-01").cast("timestamp"))
    nested = scan_results(results, records, requests)
    titles = F.array_join(F.transform("items", lambda i: i["title_of_update"]), "|")
    return nested.select(
        "group_id", "group_ord", "group_name", F.date_format("started_at", "yyyy-MM-dd").alias("started"), titles.alias("items")
    )


@query(
    "nearest_preceding_label",
    """SELECT conv_id, CAST(turn AS INTEGER) AS turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS label FROM conversations""",
)
def nearest_preceding_label(t):
    """Each turn with the nearest earlier user turn's text."""
    rows = t.conversations.select("conv_id", F.col("turn").cast("int").alias("turn"), F.when(F.col("role") == "user", F.col("text")).alias("v"))
    return last_before(rows, ["conv_id"], "turn", "v", "label").select("conv_id", "turn", "label")
