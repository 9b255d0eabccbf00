"""Request, topic-group and date queries over ``part``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.dates import (
    iso, leading_date, lenient_date, strict_iso_date, window_end, window_text,
)
from farsight.functions.text import fallback_query, split_list
from farsight.sources import requests as Q
from workload.registry import Tables, query

# Each part is a request: its name, brand and type as keyword lists; the first list comes
# twice (same id), the third has no keyword, the fourth is the first in another order.


def part_requests(t: Tables) -> DataFrame:
    first = F.concat_ws(
        " ,", F.regexp_replace("p_name", " ", ", "), F.upper("p_name"), F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" "), "p_type"
    )
    back = F.concat_ws(",", "p_type", F.upper("p_name"), F.regexp_replace("p_name", " ", ", "))
    return t.spread("part", "p_partkey", "p_name", "p_brand", "p_type").select(
        F.col("p_partkey").cast("string").alias("run_id"),
        F.array(first, F.concat_ws(", ", "p_brand", F.lit("")), F.lit(" , ,"), first, back).alias("topic_groups"),
    )


SQL_GROUPS = """
  raw AS (SELECT CAST(p_partkey AS VARCHAR) AS run_id, unnest([
      {first}, p_brand || ', ', ' , ,', {first}, p_type || ',' || upper(p_name) || ',' || replace(p_name, ' ', ', ')
    ]) AS entry, unnest([0, 1, 2, 3, 4]) AS group_ord FROM part),
  s AS (SELECT *, list_filter(list_transform(string_split(entry, ','), lambda x: trim(x)), lambda x: x <> '') AS ks FROM raw),
  kw AS (SELECT run_id, group_ord, list_filter(ks, lambda x, i: list_position(list_transform(ks, lambda y: lower(y)), lower(x)) = i) AS keywords
         FROM s WHERE len(ks) > 0),
  ids AS (SELECT *, CASE WHEN trim(regexp_replace(lower(keywords[1]), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'group'
            ELSE trim(regexp_replace(lower(keywords[1]), '[^a-z0-9]+', '-', 'g'), '-') END || '-' ||
            substr(sha256(array_to_string(list_sort(list_transform(keywords, lambda y: lower(y))), chr(10))), 1, 8) AS base_id FROM kw),
  g AS (SELECT *, row_number() OVER (PARTITION BY run_id, base_id ORDER BY group_ord) AS nth FROM ids)""".format(
    first="replace(p_name, ' ', ', ') || ' ,' || upper(p_name) || ' ,' || upper(split_part(p_name, ' ', 1)) || ' , ,' || p_type"
)


@query(
    "topic_groups",
    f"""WITH {SQL_GROUPS} SELECT run_id, CAST(group_ord AS INTEGER) AS group_ord,
    CASE WHEN nth = 1 THEN base_id ELSE base_id || '-' || nth END AS group_id,
    array_to_string(keywords, ', ') AS group_name, CAST(len(keywords) AS INTEGER) AS n_keywords,
    CAST(3 AS INTEGER) AS max_loops FROM g""",
)
def topic_groups(t):
    return Q.topic_groups(part_requests(t)).select(
        "run_id", "group_ord", "group_id", "group_name", F.size("keywords").alias("n_keywords"), "max_loops"
    )


@query(
    "group_id",
    f"WITH {SQL_GROUPS} SELECT base_id, count(*) AS n_groups FROM ids GROUP BY 1",
)
def group_ids(t):
    rows = part_requests(t).select(F.explode("topic_groups").alias("entry"))
    keyed = rows.select(split_list(F.col("entry")).alias("k")).where(F.size("k") > 0)
    return keyed.groupBy(Q.group_base_id(F.col("k")).alias("base_id")).agg(F.count("*").alias("n_groups"))


@query(
    "duplicate_group_ids",
    f"""WITH {SQL_GROUPS} SELECT run_id, base_id, count(*) AS n, max(base_id || '-' || nth) AS last_id
  FROM g GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_group_ids(t):
    groups = Q.topic_groups(part_requests(t)).withColumn("base_id", Q.group_base_id(F.col("keywords")))
    return (
        groups.groupBy("run_id", "base_id")
        .agg(F.count("*").alias("n"), F.max_by("group_id", "group_ord").alias("last_id"))
        .where(F.col("n") > 1)
    )


@query(
    "keyword_split",
    f"""WITH {SQL_GROUPS} SELECT run_id, CAST(group_ord AS INTEGER) AS group_ord, array_to_string(keywords, '|') AS keywords FROM kw""",
)
def keyword_split(t):
    rows = part_requests(t).select("run_id", F.posexplode("topic_groups").alias("group_ord", "entry"))
    return rows.select("run_id", "group_ord", split_list(F.col("entry")).alias("k")).where(
        F.size("k") > 0
    ).select("run_id", "group_ord", F.array_join("k", "|").alias("keywords"))


@query(
    "fallback_query",
    f"""WITH {SQL_GROUPS} SELECT run_id, CAST(group_ord AS INTEGER) AS group_ord,
    keywords[1] || ' ' || run_id || ' update' AS query FROM kw""",
)
def fallback_queries(t):
    return Q.topic_groups(part_requests(t)).select(
        "run_id", "group_ord",
        fallback_query(F.col("keywords"), F.col("group_name"), F.col("run_id")).alias("query"),
    )


# --- request checks: each order is a request whose fields break rules by its values


def order_requests(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    priority = F.col("o_orderpriority")
    jurisdiction = (
        F.when(priority == "5-LOW", F.lit("  ")).when(priority == "4-NOT SPECIFIED", F.substring(priority, 1, 1))
        .when(priority == "3-MEDIUM", F.repeat(priority, 13)).otherwise(priority)
    )
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        jurisdiction.alias("jurisdiction"),
        F.when(F.col("o_totalprice") > 100000, day).alias("start_date"),
        F.when(F.col("o_totalprice") < 400000, F.lit("1997-01-01").cast("date")).alias("end_date"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(status == "F", F.array(status, F.lit(" ")))
        .when(status == "P", F.array().cast("array<string>"))
        .otherwise(F.array(status)).alias("topic_groups"),
    )


SQL_ISSUES = """
  r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus AS st,
    CASE o_orderpriority WHEN '5-LOW' THEN '  ' WHEN '4-NOT SPECIFIED' THEN '4' WHEN '3-MEDIUM' THEN repeat(o_orderpriority, 13) ELSE o_orderpriority END AS j,
    CASE WHEN o_totalprice > 100000 THEN CAST(o_orderdate AS DATE) END AS s,
    CASE WHEN o_totalprice < 400000 THEN DATE '1997-01-01' END AS e, o_orderdate AS started FROM orders),
  i AS (SELECT *, list_filter([
      CASE WHEN e < s THEN ['EndDate', 'endDate must be on or after startDate.'] END,
      CASE WHEN trim(j) = '' THEN ['Jurisdiction', '''Jurisdiction'' must not be empty.'] END,
      CASE WHEN length(j) NOT BETWEEN 2 AND 100 THEN ['Jurisdiction', '''Jurisdiction'' must be between 2 and 100 characters.'] END,
      CASE WHEN st = 'P' THEN ['TopicGroups', 'At least one topic group must be selected.'] END,
      CASE WHEN st = 'F' THEN ['TopicGroups', '''Topic Groups'' must not be empty.'] END
    ], lambda x: x IS NOT NULL) AS issues FROM r)"""


@query(
    "request_quality",
    f"""WITH {SQL_ISSUES} SELECT run_id, len(issues) = 0 AS valid,
    array_to_string(list_transform(issues, lambda x: x[1] || ': ' || x[2]), '; ') AS issues FROM i""",
)
def request_quality(t):
    checked = Q.check_requests(order_requests(t))
    listed = F.transform("issues", lambda i: F.concat_ws(": ", i["property"], i["message"]))
    return checked.select(
        "run_id", (F.size("issues") == 0).alias("valid"), F.array_join(listed, "; ").alias("issues")
    )


@query(
    "rejected_requests",
    f"""WITH {SQL_ISSUES} SELECT run_id, CAST(len(issues) AS INTEGER) AS n_issues FROM i WHERE len(issues) > 0""",
)
def rejected_requests(t):
    """Requests that a scan refuses, with the number of their issues."""
    _, rejected = Q.split_requests(order_requests(t))
    return rejected.select("run_id", F.size("issues").alias("n_issues"))


@query(
    "validation_report",
    f"""WITH {SQL_ISSUES} SELECT x[1] AS property, x[2] AS message, count(*) AS n
  FROM (SELECT unnest(issues) AS x FROM i) GROUP BY 1, 2""",
)
def validation_report(t):
    return Q.issue_counts(Q.check_requests(order_requests(t)))


@query(
    "validation_errors_by_property",
    f"""WITH {SQL_ISSUES}, x AS (SELECT run_id, unnest(issues) AS x, unnest(range(len(issues))) AS pos FROM i)
  SELECT run_id, x[1] AS property, string_agg(x[2], ' / ' ORDER BY pos) AS messages FROM x GROUP BY 1, 2""",
)
def validation_errors_by_property(t):
    report = Q.issue_report(Q.check_requests(order_requests(t)))
    return report.select("run_id", F.explode("errors").alias("property", "m")).select(
        "run_id", "property", F.array_join("m", " / ").alias("messages")
    )


@query(
    "window_text",
    f"""WITH {SQL_ISSUES} SELECT run_id, strftime(coalesce(e, CAST(started AS DATE)), '%Y-%m-%d') AS window_end,
    CASE WHEN s IS NOT NULL THEN strftime(s, '%Y-%m-%d') || ' to ' ELSE 'on or before ' END
      || strftime(coalesce(e, CAST(started AS DATE)), '%Y-%m-%d') AS window_text FROM r""",
)
def window_texts(t):
    end = window_end(F.col("end_date"), F.col("started_at"))
    return order_requests(t).select(
        "run_id", iso(end).alias("window_end"), window_text(F.col("start_date"), end).alias("window_text")
    )


# --- dates: each order date written in the form its priority and status name


def written_dates(t: Tables, tail: str = "") -> DataFrame:
    d = F.to_date("o_orderdate")
    p = F.col("o_orderpriority")
    written = (
        F.when(p == "1-URGENT", F.date_format(d, "yyyy-MM-dd")).when(p == "2-HIGH", F.date_format(d, "d MMMM yyyy"))
        .when(p == "3-MEDIUM", F.date_format(d, "MMM d, yyyy")).when(p == "5-LOW", F.date_format(d, "MM/dd/yyyy"))
        .otherwise(F.date_format(d, "EEEE, dd MMM yyyy"))
    )
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", "o_orderstatus", d.alias("d"),
        F.when(status == "F", F.concat(F.lit("  "), written, F.lit(" "))).when(status == "P", F.date_format(d, "yyyy"))
        .otherwise(written).alias("written"),
    )


@query(
    "lenient_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def lenient_dates(t):
    return written_dates(t).select("o_orderkey", iso(lenient_date(F.col("written"))).alias("parsed"))


@query(
    "leading_date",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def leading_dates(t):
    """Dates followed by other text parse; dates behind other text, or alone as a year, do not."""
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", F.concat(F.lit("on "), F.trim("written"))).otherwise(
        F.concat("written", F.lit("\n  - see all updates since 1999"))
    )
    return written_dates(t).select("o_orderkey", iso(leading_date(raw)).alias("parsed"))


@query(
    "strict_iso_date",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS parsed FROM events""",
)
def strict_iso_dates(t):
    """The written local date counts whatever the offset; other forms are rejected."""
    ts, kind = F.col("ts"), F.col("event_type")
    written = (
        F.when(kind == "view", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "click", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .when(kind == "signup", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00")))
        .when(kind == "purchase", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .otherwise(F.date_format(ts, "dd.MM.yyyy"))
    )
    return t.events.select("event_id", iso(strict_iso_date(written)).alias("parsed"))


@query(
    "request_dates",
    """SELECT event_id, event_type NOT IN ('error', 'purchase') AS accepted,
    CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN strftime(ts, '%Y-%m-%d') WHEN 'signup' THEN strftime(ts, '%Y-%m-%d') END AS start_date FROM events""",
)
def request_dates(t):
    """Events as requests with written dates: views have none, errors and purchases malformed ones."""
    ts, kind = F.col("ts"), F.col("event_type")
    start = (
        F.when(kind == "click", F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == "signup", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"), F.lit("-11:00")))
        .when(kind == "error", F.date_format(ts, "dd/MM/yyyy")).when(kind == "purchase", F.lit(""))
    )
    raw = t.events.select("event_id", start.alias("start_date"), F.lit(None).cast("string").alias("end_date"))
    good, bad = Q.read_request_dates(raw)
    return good.select("event_id", F.lit(True).alias("accepted"), iso(F.col("start_date")).alias("start_date")).unionByName(
        bad.select("event_id", F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("start_date"))
    )
