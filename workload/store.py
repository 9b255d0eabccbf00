"""Keyed store, gate, version, learnings and streaming-form queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.urls import url_key
from farsight.operators import gates as G
from farsight.operators import learnings as L
from farsight.schemas import DOCUMENT_STORE
from farsight.session import stage_dir
from farsight.sources import store as S
from farsight.streaming import stateful, streams as T
from workload.registry import (
    ORACLES, SQL_PAGE_RUN, Tables, page_run, query, sql_host, sql_norm_host, sql_url_key,
)
from workload.verdicts import SQL_ROUTED, order_items

# --- keyed batches: orders before 1998 are stored, those from 1997 on arrive -------------


def documents_of(orders: DataFrame, mark: str) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("partition"),
        F.concat(F.lit(mark), F.col("o_totalprice").cast("long").cast("string")).alias("payload"),
        F.year("o_orderdate").alias("version"),
    )


def stored(t: Tables) -> DataFrame:
    return documents_of(t.orders.where(F.year("o_orderdate") < 1998), "old ")


def arriving(t: Tables) -> DataFrame:
    return documents_of(t.orders.where(F.year("o_orderdate") >= 1997), "new ")


SQL_STORE = """
  o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS "partition", CAST(trunc(o_totalprice) AS BIGINT) AS price,
          CAST(year(o_orderdate) AS INTEGER) AS version FROM orders)"""


@query(
    "batch_upsert",
    f"""WITH {SQL_STORE} SELECT id, "partition", CASE WHEN version >= 1997 THEN 'new ' ELSE 'old ' END || price AS payload, version FROM o""",
)
def batch_upsert(t):
    twice = arriving(t).withColumn("seq", F.lit(2)).unionByName(
        arriving(t).withColumn("payload", F.lit("stale")).withColumn("seq", F.lit(1))
    )
    return S.upsert(stored(t), S.latest(twice, S.KEY, "seq").drop("seq"))


@query("upsert_written", ORACLES["batch_upsert"])
def upsert_written(t):
    """The table written first and upserted with the arriving batch, twice, then read back."""
    path = stage_dir(t.spark, "store")
    for batch in (stored(t), arriving(t), arriving(t)):
        S.write_upsert(t.spark, path, batch, DOCUMENT_STORE)
    return t.spark.read.schema(DOCUMENT_STORE).parquet(path)


@query(
    "create_conflicts",
    f"""WITH {SQL_STORE} SELECT "partition", count(*) FILTER (version > 1997) AS created, count(*) FILTER (version = 1997) AS conflicts
  FROM o WHERE version >= 1997 GROUP BY 1""",
)
def create_conflicts(t):
    added, taken = S.create(stored(t), arriving(t))
    both = added.withColumn("c", F.lit(0)).unionByName(taken.withColumn("c", F.lit(1)))
    return both.groupBy("partition").agg(
        F.count_if(F.col("c") == 0).alias("created"), F.count_if(F.col("c") == 1).alias("conflicts")
    )


@query(
    "batch_replace",
    f"""WITH {SQL_STORE} SELECT id, CASE WHEN version = 1997 THEN 'new ' ELSE 'old ' END || price AS payload, 'stored' AS state FROM o WHERE version < 1998
  UNION ALL SELECT id, 'new ' || price, 'missing' FROM o WHERE version >= 1998""",
)
def batch_replace(t):
    after, missing = S.replace(stored(t), arriving(t))
    return after.select("id", "payload", F.lit("stored").alias("state")).unionByName(
        missing.select("id", "payload", F.lit("missing").alias("state"))
    )


@query("batch_delete", f"""WITH {SQL_STORE} SELECT id, "partition", version FROM o WHERE version < 1997""")
def batch_delete(t):
    return S.delete(stored(t), arriving(t)).select("id", "partition", "version")


@query(
    "point_reads",
    f"""WITH {SQL_STORE} SELECT id, "partition", CASE WHEN version = 1997 THEN 'old ' || price END AS payload FROM o WHERE version >= 1997""",
)
def point_reads(t):
    return S.point_reads(arriving(t), stored(t)).select("id", "partition", "payload")


@query(
    "partition_query",
    f"""WITH {SQL_STORE} SELECT 'one partition' AS scope, version, count(*) AS n FROM o WHERE version < 1998 AND "partition" = '2-HIGH' GROUP BY 2
  UNION ALL SELECT 'all', version, count(*) FROM o WHERE version < 1998 GROUP BY 2""",
)
def partition_query(t):
    scoped = S.query(stored(t), partition="2-HIGH").withColumn("scope", F.lit("one partition"))
    whole = S.query(stored(t)).withColumn("scope", F.lit("all"))
    return scoped.unionByName(whole).groupBy("scope", "version").agg(F.count("*").alias("n"))


# --- versions: customers are items, order years are runs ---------------------------------


@query(
    "versioned_results",
    """SELECT run_id, id, CAST(row_number() OVER (PARTITION BY id ORDER BY run_id) AS INTEGER) AS version
  FROM (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS run_id, CAST(o_custkey AS VARCHAR) AS id FROM orders)""",
)
def versioned_results(t):
    items = t.orders.select(
        F.date_format("o_orderdate", "yyyyMM").alias("run_id"), F.col("o_custkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("group_id"), F.lit(1).alias("found_on_pass"), F.lit(1).alias("version"),
    )
    runs = t.orders.select(F.date_format("o_orderdate", "yyyyMM").alias("run_id")).distinct().withColumn(
        "started_at", F.to_timestamp(F.concat("run_id", F.lit("01")), "yyyyMMdd")
    )
    return S.versioned_results(items, runs).select("run_id", "id", "version")


# --- gates ---------------------------------------------------------------------------------


def gate_items(t: Tables) -> DataFrame:
    """Pages as results: French ones lack an id, German ones have an unknown verdict."""
    run = page_run()
    return t.pages.select(
        run.alias("run_id"), F.lit("g").alias("group_id"),
        F.when(run == "fr", F.lit(" ")).otherwise(F.col("page_id").cast("string")).alias("id"),
        F.when(run == "de", "Maybe").otherwise("Relevant").alias("verdict"),
        F.lit("High").alias("date_confidence"), "page_id", "url",
    )


SQL_GATE = f"""
  gi AS (SELECT page_id, url, {SQL_PAGE_RUN} AS run_id, {sql_url_key('url')} AS url_key, {sql_norm_host('url')} AS host FROM pages),
  ge AS (SELECT *, CASE run_id WHEN 'fr' THEN 'id is required' WHEN 'de' THEN 'verdict is not a known value' ELSE '' END AS issues,
          {sql_host('url')} LIKE '%.net' AS was_stored FROM gi)"""


@query("quality_gate", f"WITH {SQL_GATE} SELECT page_id, issues FROM ge")
def quality_gate(t):
    return G.quality_gate(gate_items(t)).select("page_id", F.array_join("issues", "; ").alias("issues"))


def stored_pages(t: Tables) -> DataFrame:
    return t.pages.where(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).endswith(".net")).select(
        url_key(F.col("url")).alias("url_key")
    )


@query("store_dedupe", f"WITH {SQL_GATE} SELECT page_id, url_key FROM ge WHERE NOT was_stored")
def store_dedupe(t):
    return G.unstored(t.pages.select("page_id", "url"), stored_pages(t), F.col("url")).select("page_id", "url_key")


# Authority by host suffix on the invented hosts; the longest suffix and path win.
RULES = [
    ("example.com", "", "RegulatorGuidance"), ("www.example.com", "", "CourtRuling"),
    ("example.net", "/en", "Legislation"), ("example.net", "", "CourtRuling"),
]


def rules(t: Tables) -> DataFrame:
    return G.authority_rules(t.spark, RULES)


SQL_AUTHORITY = """CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 'RegulatorGuidance'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND regexp_matches(url_key, '^[^/]+/en(/|\\?|$)') THEN 'Legislation'
    WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'CourtRuling' ELSE 'Unknown' END"""


@query("authority_stamp", f"WITH {SQL_GATE} SELECT page_id, {SQL_AUTHORITY} AS level_of_authority FROM ge")
def authority_stamp(t):
    return G.stamp_authority(t.pages.select("page_id", "url"), rules(t), "url", ["page_id"]).select(
        "page_id", "level_of_authority"
    )


@query(
    "authority_tie_break",
    f"""WITH {SQL_GATE}, a AS (SELECT *, {SQL_AUTHORITY} AS level_of_authority FROM ge)
  SELECT run_id, arg_min(page_id, (-CASE level_of_authority WHEN 'Legislation' THEN 3 WHEN 'CourtRuling' THEN 2
    WHEN 'RegulatorGuidance' THEN 1 ELSE 0 END) * CAST(1000000000 AS BIGINT) + page_id) AS page_id FROM a GROUP BY 1""",
)
def authority_tie_break(t):
    items = t.pages.select("page_id", "url", page_run().alias("run_id"))
    stamped = G.stamp_authority(items, rules(t), "url", ["page_id"])
    return G.by_authority(stamped, ["run_id"], "page_id").select("run_id", "page_id")


@query(
    "gate_composition",
    f"""WITH {SQL_GATE} SELECT page_id, issues = '' AND NOT was_stored AS accepted,
    concat_ws('; ', nullif(issues, ''), CASE WHEN was_stored THEN 'already stored' END) AS issues,
    CASE WHEN issues = '' AND NOT was_stored THEN {SQL_AUTHORITY} END AS level_of_authority FROM ge""",
)
def gate_composition(t):
    accepted, rejected = G.gate(gate_items(t), stored_pages(t), rules(t), "url", ["page_id"])
    return accepted.select(
        "page_id", F.lit(True).alias("accepted"), F.lit("").alias("issues"), "level_of_authority"
    ).unionByName(rejected.select(
        "page_id", F.lit(False).alias("accepted"), F.array_join("issues", "; ").alias("issues"),
        F.lit(None).cast("string").alias("level_of_authority"),
    ))


# --- learnings: orders are completed answers, the customer's segment the jurisdiction -----


def learnings(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("c_acctbal") > 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("jurisdiction"),
        F.col("o_orderpriority").alias("group_id"),
        F.when(status == "F", "Approved").when(status == "P", "Pending").otherwise("Rejected").alias("review_status"),
        F.year("o_orderdate").cast("string").alias("date_range"),
        F.col("o_orderdate").cast("timestamp").alias("completed_at"),
    )


SQL_LEARNINGS = """
  l AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, lower(c_mktsegment) AS jurisdiction_key, o_orderpriority AS group_id, o_orderstatus AS st,
      CAST(year(o_orderdate) AS VARCHAR) AS date_range, o_orderdate AS done FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "learnings_topk",
    f"""WITH {SQL_LEARNINGS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY jurisdiction_key, group_id ORDER BY done DESC, id) AS INTEGER) AS recency_rank
    FROM l WHERE st = 'F') SELECT jurisdiction_key, group_id, id, recency_rank FROM r WHERE recency_rank <= 5""",
)
def learnings_topk(t):
    return L.approved_top(learnings(t)).select("jurisdiction_key", "group_id", "id", "recency_rank")


@query(
    "learnings_by_jurisdiction",
    f"""WITH {SQL_LEARNINGS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY jurisdiction_key ORDER BY done DESC, id) AS INTEGER) AS recency_rank
    FROM l) SELECT jurisdiction_key, id, recency_rank FROM r WHERE recency_rank <= 3""",
)
def learnings_by_jurisdiction(t):
    return L.approved_top(learnings(t), by_group=False, k=3, require_approved=False).select(
        "jurisdiction_key", "id", "recency_rank"
    )


@query(
    "near_duplicate_latest",
    f"""WITH {SQL_LEARNINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction_key, group_id, date_range ORDER BY done DESC, id) AS rn FROM l)
  SELECT jurisdiction_key, group_id, date_range, id FROM r WHERE rn = 1""",
)
def near_duplicate_latest(t):
    return L.latest_per_scan(learnings(t)).select("jurisdiction_key", "group_id", "date_range", "id")


@query(
    "completed_answers",
    """SELECT c_custkey || ':' || c_mktsegment AS id, c_mktsegment AS group_name, 'Pending' AS review_status,
    '1997-01-01..' AS date_range, CAST(CASE WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS INTEGER) AS loop_count FROM customer""",
)
def completed_answers(t):
    """Saved twice: the second write of a (run, group) replaces the first."""
    rows = t.customer.select(
        F.col("c_custkey").cast("string").alias("run_id"), F.col("c_mktsegment").alias("group_id"),
        F.col("c_mktsegment").alias("group_name"), "c_acctbal",
    )
    runs = t.customer.select(
        F.col("c_custkey").cast("string").alias("run_id"), F.lit("UK").alias("jurisdiction"),
        F.lit("1997-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
        F.lit("2026-01-01").cast("timestamp").alias("completed_at"),
    )
    first = L.completed_answers(rows.withColumn("loop_count", F.lit(1)), runs)
    second = L.completed_answers(rows.where(F.col("c_acctbal") > 0).withColumn("loop_count", F.lit(2)), runs)
    return L.save_answers(first, second).select("id", "group_name", "review_status", "date_range", "loop_count")


# --- batch forms of the streaming operators ------------------------------------------------


@query(
    "call_failure_windows",
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS calls,
    count(*) FILTER (event_type = 'error') AS failures,
    count(*) >= 10 AND count(*) FILTER (event_type = 'error') >= 0.5 * count(*) AS open FROM events GROUP BY 1""",
)
def call_failure_windows(t):
    calls = t.events.withColumn("failed", F.col("event_type") == "error")
    windows = T.failure_windows(calls, [], width="1 hour")
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "call_failure_windows_by_user",
    """SELECT strftime(time_bucket(INTERVAL 30 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS calls,
    count(*) FILTER (event_type = 'error') AS failures,
    count(*) >= 1 AND count(*) FILTER (event_type = 'error') >= 0.5 * count(*) AS open FROM events GROUP BY 1, 2""",
)
def call_failure_windows_by_user(t):
    calls = t.events.withColumn("failed", F.col("event_type") == "error")
    windows = T.failure_windows(calls, ["user_id"], min_calls=1)
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "call_failure_windows_rolling",
    """SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures,
    count(*) >= 10 AND count(*) FILTER (event_type = 'error') >= 0.5 * count(*) AS open
  FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS w FROM events, range(4) r(k)) GROUP BY w""",
)
def call_failure_windows_rolling(t):
    """Hour-long windows of which one starts every quarter of an hour."""
    calls = t.events.withColumn("failed", F.col("event_type") == "error")
    windows = T.failure_windows(calls, [], width="1 hour", slide="15 minutes")
    return windows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    "dedupe_batch_form",
    """SELECT DISTINCT event_type AS run_id, 'example.org/u' || user_id AS url_key FROM events""",
)
def dedupe_batch_form(t):
    url = F.concat(F.lit("https://www.Example.org/U"), F.col("user_id").cast("string"), F.lit("/?utm_id=1"))
    hits = t.events.select("ts", F.col("event_type").alias("run_id"), url.alias("url"))
    return T.dedupe_hits(hits).select("run_id", "url_key")


@query(
    "route_windows_batch_form",
    f"""WITH {SQL_ROUTED}, x AS (SELECT r.*, o_orderdate FROM routed r JOIN orders USING (o_orderkey))
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS window_start, count(*) FILTER (route = 'vetted') AS carried,
    count(*) FILTER (route = 'vetted' AND verdict = 'Borderline') AS borderline, count(*) FILTER (route = 'discarded') AS dropped
  FROM x GROUP BY 1""",
)
def route_windows_batch_form(t):
    routed = order_items(t).join(t.orders.select("o_orderkey", F.col("o_orderdate").alias("ts")), "o_orderkey")
    return T.route_windows(routed).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


# --- streams with state ------------------------------------------------------------------------


@query(
    "rolling_call_failures",
    """SELECT event_id, calls, failures, calls >= 2 AND failures >= 0.5 * calls AS open FROM (
    SELECT event_id, count(*) OVER w AS calls, count(*) FILTER (event_type = 'error') OVER w AS failures FROM events
    WINDOW w AS (PARTITION BY user_id % 8 ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW))""",
)
def rolling_call_failures(t):
    """For every call the ten minutes before it, by the user's shard."""
    calls = t.events.select("event_id", "ts", F.pmod("user_id", F.lit(8)).alias("shard"), (F.col("event_type") == "error").alias("failed"))
    return stateful.rolling_failures(calls, ["shard"], seconds=600, min_calls=2).select("event_id", "calls", "failures", "open")


def event_hits(t: Tables) -> DataFrame:
    """Events as hits whose order of arrival is not that of their passes and ranks."""
    url = F.concat(F.lit("https://www.Example.org/U"), F.col("user_id").cast("string"), F.lit("/?utm_id="), F.col("event_id").cast("string"))
    of = lambda n: F.pmod(F.xxhash64("event_id"), F.lit(n)).cast("int")
    group = F.pmod("event_id", F.lit(5)).cast("int")
    return t.events.select(
        F.col("event_type").alias("run_id"), F.concat(F.lit("g"), group.cast("string")).alias("group_id"), group.alias("group_ord"),
        (F.pmod("event_id", F.lit(3)) + 1).cast("int").alias("pass"), (F.col("event_id") % 7).cast("int").alias("rank"), url.alias("url"))


_SQL_FIRST = """SELECT run_id, url_key, pass, group_ord, rank, url FROM (
    SELECT event_type AS run_id, 'example.org/u' || user_id AS url_key, CAST(event_id % 3 + 1 AS INTEGER) AS pass, CAST(event_id % 5 AS INTEGER) AS group_ord,
      CAST(event_id % 7 AS INTEGER) AS rank, 'https://www.Example.org/U' || user_id || '/?utm_id=' || event_id AS url,
      row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 3, event_id % 5, event_id % 7, 'https://www.Example.org/U' || user_id || '/?utm_id=' || event_id) AS rn
    FROM events) WHERE rn = 1"""
FIRST_COLUMNS = ["run_id", "url_key", "pass", "group_ord", "rank", "url"]


@query("first_hits_batch_form", _SQL_FIRST)
def first_hits_batch_form(t):
    return stateful.first_hits(event_hits(t)).select(*FIRST_COLUMNS)


@query("first_hits_stream", _SQL_FIRST)
def first_hits_stream(t):
    """The same by a stream of eight files: corrections are appended, and each key's highest version is its first hit."""
    root, spark = stage_dir(t.spark, "first-hits"), t.spark
    hits = event_hits(t)
    hits.repartition(8).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stateful.first_hits(stream).writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    versions = spark.read.parquet(f"{root}/out")
    best = F.max_by(F.struct(*[c for c in FIRST_COLUMNS if c not in ("run_id", "url_key")]), "version").alias("b")
    return versions.groupBy("run_id", "url_key").agg(best).select("run_id", "url_key", "b.*")
