"""Verdict, decision, routing and recall queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from farsight.functions import verdicts as W
from farsight.functions.dates import iso
from farsight.operators import learnings as L
from farsight.operators import metrics as M
from farsight.operators import records as R
from farsight.operators import verdicts as V
from farsight.plans.makers import BadOutput, predictor_scorer
from farsight.operators.ordinals import ordinal
from farsight.session import stage_dir, staged
from farsight.plans.makers import coverage_decisions, heuristic_verdict
from workload.registry import Tables, query

GROUP_DOC = ["group_id", "doc_index"]

# --- documents grouped by source, judged by their label ------------------------------


def source_docs(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("source").alias("group_id"), "doc_id")
    return ordinal(docs, ["group_id"], "doc_id", "doc_index", start=0)


def label_verdicts(t: Tables) -> DataFrame:
    verdict = F.when(F.col("quality") == 0, W.NOT_RELEVANT).when(F.col("toxic") == 1, W.BORDERLINE).otherwise(W.RELEVANT)
    none = F.lit(None).cast("date")
    return t.labels.select(
        "doc_id", verdict.alias("verdict"), F.lit("labelled").alias("rationale"),
        none.alias("publication_date"), none.alias("effective_date"), none.alias("applies_from"),
        none.alias("applies_to"), F.lit(W.HIGH).alias("date_confidence"),
    )


def filled(t: Tables) -> DataFrame:
    docs = source_docs(t)
    verdicts = docs.join(label_verdicts(t), "doc_id").drop("doc_id")
    return V.fill_verdicts(docs, verdicts, keys=GROUP_DOC)


SQL_VERDICT = "CASE WHEN quality = 0 THEN 'NotRelevant' WHEN toxic = 1 THEN 'Borderline' ELSE 'Relevant' END"
SQL_FILLED = f"""
  d AS (SELECT source AS group_id, doc_id,
          CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS doc_index FROM documents),
  f AS (SELECT d.*, coalesce({SQL_VERDICT.replace("quality = 0", "quality = 0").replace("ELSE 'Relevant'", "WHEN quality = 1 THEN 'Relevant'")}, 'Borderline') AS verdict,
          CASE WHEN quality IS NULL THEN '{W.OMITTED_RATIONALE}' ELSE 'labelled' END AS rationale,
          CASE WHEN quality IS NULL THEN 'Unknown' ELSE 'High' END AS date_confidence
        FROM d LEFT JOIN labels USING (doc_id))"""


@query("doc_index", f"WITH {SQL_FILLED} SELECT group_id, doc_id, doc_index FROM d")
def doc_index(t):
    return source_docs(t)


@query(
    "verdict_join_fill",
    f"WITH {SQL_FILLED} SELECT group_id, doc_id, doc_index, verdict, rationale, date_confidence FROM f",
)
def verdict_join_fill(t):
    return filled(t).select("group_id", "doc_id", "doc_index", "verdict", "rationale", "date_confidence")


@query(
    "failed_pass_fill",
    f"""WITH {SQL_FILLED} SELECT group_id, doc_index, 'Borderline' AS verdict,
    CASE WHEN group_id LIKE 'src1%' THEN '{W.FAILED_RATIONALE}' ELSE '{W.OMITTED_RATIONALE}' END AS rationale FROM f
    WHERE verdict = 'Borderline' AND date_confidence = 'Unknown' OR group_id LIKE 'src1%'""",
)
def failed_pass_fill(t):
    """Groups src1* got no usable answer: every document is Borderline with the failure text."""
    docs = source_docs(t)
    broken = F.col("group_id").startswith("src1")
    verdicts = docs.join(label_verdicts(t), "doc_id").drop("doc_id").where(~broken)
    failed = docs.where(broken).select("group_id").distinct()
    rows = V.fill_verdicts(docs, verdicts, failed, keys=GROUP_DOC)
    return rows.where(F.col("date_confidence") == W.UNKNOWN).select("group_id", "doc_index", "verdict", "rationale")


@query(
    "relevant_share",
    f"""WITH {SQL_FILLED} SELECT group_id, count(*) AS n_verdicts, count(*) FILTER (verdict = 'Relevant') AS n_relevant,
    count(*) FILTER (verdict = 'Relevant') / CAST(count(*) AS DOUBLE) AS relevant_share FROM f GROUP BY 1""",
)
def relevant_share(t):
    return V.relevant_share(filled(t), ["group_id"])


@query(
    "verdict_mix",
    f"""WITH {SQL_FILLED} SELECT group_id, count(*) FILTER (verdict = 'Relevant') AS relevant,
    count(*) FILTER (verdict = 'Borderline') AS borderline, count(*) FILTER (verdict = 'NotRelevant') AS not_relevant
  FROM f GROUP BY 1""",
)
def verdict_mix(t):
    return M.verdict_mix(filled(t), ["group_id"])


# --- decisions: per (user, day) of the call log, views are documents -----------------


def call_passes(t: Tables) -> DataFrame:
    """(run, group, pass) per (event day, user, hour) with shares and failed searches."""
    kind = F.col("event_type")
    return t.events.groupBy(
        F.date_format("ts", "yyyyMMdd").alias("run_id"), F.col("user_id").cast("string").alias("group_id"),
        (F.hour("ts") % 4 + 1).alias("pass"),
    ).agg(
        F.count_if(kind.isin("view", "click", "purchase")).alias("n_docs"),
        F.count_if((kind != "view") & kind.isin("view", "click", "purchase")).alias("n_relevant"),
        F.bool_or(kind == "error").alias("search_failed"),
        F.max(F.when(kind == "signup", "FINALIZE").otherwise("retry")).alias("word"),
    )


SQL_CALLS = """
  p AS (SELECT strftime(ts, '%Y%m%d') AS run_id, CAST(user_id AS VARCHAR) AS group_id,
          CAST(hour(ts) % 4 + 1 AS INTEGER) AS pass, count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS n_docs,
          count(*) FILTER (event_type IN ('click', 'purchase')) AS n_relevant,
          bool_or(event_type = 'error') AS search_failed,
          max(CASE WHEN event_type = 'signup' THEN 'Finalize' ELSE 'Retry' END) AS word
        FROM events GROUP BY 1, 2, 3)"""
# max('FINALIZE', 'retry') is 'retry' wherever both occur; the SQL's max('Finalize', 'Retry') agrees.


@query(
    "loop_decision",
    f"""WITH {SQL_CALLS}, q AS (SELECT *, CASE WHEN n_docs = 0 THEN 0 ELSE CAST(n_relevant AS DOUBLE) / n_docs END AS share FROM p),
  f AS (SELECT *, CASE WHEN pass >= 3 THEN 'Finalize' WHEN word = 'Finalize' AND share >= 0.8 THEN 'Retry' ELSE word END AS final FROM q)
  SELECT run_id, group_id, pass, final AS final_decision, final <> word AS decision_override,
    CASE WHEN pass >= 3 AND word = 'Retry' THEN 'maxLoops cap (3) reached.'
         WHEN pass < 3 AND word = 'Finalize' AND share >= 0.8
         THEN 'recall override: ' || CAST(CAST(round(share * 100) AS INTEGER) AS VARCHAR) || '% of items RELEVANT (>= 80%); searching again for more.'
    END AS override_reason FROM f""",
)
def loop_decision(t):
    passes = call_passes(t).select(
        "run_id", "group_id", "pass", F.lit(3).alias("max_loops"),
        W.parse_decision(F.col("word")).alias("llm_decision"),
        F.when(F.col("n_docs") > 0, F.col("n_relevant") / F.col("n_docs")).alias("relevant_share"),
    )
    return V.decide(passes).select(
        "run_id", "group_id", "pass", "final_decision", "decision_override", "override_reason"
    )


@query(
    "empty_pass_decision",
    f"""WITH {SQL_CALLS} SELECT run_id, group_id, pass, n_docs,
    CASE WHEN n_docs = 0 AND search_failed THEN 'Retry' WHEN n_docs = 0 THEN 'Finalize' WHEN word = 'Finalize' THEN word ELSE 'Retry' END AS llm_decision,
    CASE WHEN n_docs = 0 AND search_failed THEN 'No documents were retrieved this pass because the web search failed (timeout). This is an error state, not an empty result - retrying rather than finalizing on a broken search.'
         WHEN n_docs = 0 THEN '{W.EMPTY_THOUGHT}' WHEN word = 'Finalize' THEN 'answered' ELSE '{W.FAILED_THOUGHT}' END AS thought_process
  FROM p""",
)
def empty_pass_decision(t):
    """Only the passes that say FINALIZE have an answer; the others' answers are missing."""
    calls = call_passes(t)
    passes = calls.select(
        *V.PASS, "search_failed", F.when(F.col("search_failed"), "timeout").alias("search_failure_reason")
    )
    answers = calls.where(F.col("word") == "FINALIZE").select(
        *V.PASS, F.lit("answered").alias("thought_process"), F.lit(W.FINALIZE).alias("llm_decision")
    )
    counts = calls.where(F.col("n_docs") > 0).select(*V.PASS, "n_docs")
    return V.fill_decisions(passes, answers, counts).select(*V.PASS, "n_docs", "llm_decision", "thought_process")


@query(
    "degradable_failures",
    """SELECT outcome, count(*) AS n FROM (SELECT CASE
      WHEN event_type = 'error' AND value < 10 THEN 'fallback'
      WHEN event_type = 'error' THEN CASE WHEN status IN (0, 408, 429) OR status >= 500 THEN 'fallback' ELSE 'failed' END
      ELSE 'ok' END AS outcome
    FROM (SELECT *, CAST(floor(value * 10) AS INTEGER) AS status FROM events)) GROUP BY 1""",
)
def degradable_failures(t):
    """Errors as failed calls: malformed output below 10, else an HTTP status from the value."""
    failed = F.col("event_type") == "error"
    status = F.when(failed, F.floor(F.col("value") * 10).cast("int"))
    degradable = W.is_degradable(status, failed & (F.col("value") < 10))
    outcome = F.when(degradable.isNull(), "ok").when(degradable, "fallback").otherwise("failed")
    return t.events.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


# --- parsing --------------------------------------------------------------------------

WORDS = {"1-URGENT": " relevant ", "2-HIGH": "Not Relevant", "3-MEDIUM": "NOT_RELEVANT", "5-LOW": "maybe"}


@query(
    "verdict_words",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Relevant' WHEN '2-HIGH' THEN 'NotRelevant'
      WHEN '3-MEDIUM' THEN 'NotRelevant' ELSE 'Borderline' END AS verdict,
    CASE o_orderstatus WHEN 'F' THEN 'Finalize' WHEN 'P' THEN 'Finalize' ELSE 'Retry' END AS decision,
    CASE o_orderpriority WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' ELSE 'Unknown' END AS confidence
  FROM orders""",
)
def verdict_words(t):
    p = F.col("o_orderpriority")
    word = F.lit(None).cast("string")
    for key, value in WORDS.items():
        word = F.when(p == key, F.lit(value)).otherwise(word)
    decision = F.when(F.col("o_orderstatus") == "F", " stop").when(F.col("o_orderstatus") == "P", "finalise")
    return t.orders.select(
        "o_orderkey", W.parse_verdict(word).alias("verdict"), W.parse_decision(decision).alias("decision"),
        W.parse_confidence(F.lower(F.split_part(p, F.lit("-"), F.lit(2)))).alias("confidence"),
    )


def order_answers(t: Tables) -> DataFrame:
    """One answer per order over two documents: its verdict twice, an index out of range.

    Open orders' answers are not JSON and pending ones have no item list. Of the others those of
    every seventh order have a field of another type. Good answers come in four forms: plain, with
    unknown members that are named as fields are, with names in other case, and with numbers in strings.
    """
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    verdict = F.when(F.col("o_totalprice") > 200000, "relevant").otherwise("not relevant")
    forms = F.array(*[
        F.format_string(form, F.col("o_orderkey"), verdict, date)
        for form in (
            '{"thoughtProcess":" note %d ","decision":"finalize","items":['
            '{"index":1,"verdict":"%s","rationale":" r ","publicationDate":"%s","dateConfidence":"high"},'
            '{"index":1,"verdict":"RELEVANT"},{"index":7,"verdict":"RELEVANT"}]}',
            '{"meta":{"index":"a","items":[3],"decision":0},"thoughtProcess":" note %d ","decision":"finalize","items":['
            '{"index":1,"verdict":"%s","rationale":" r ","publicationDate":"%s","dateConfidence":"high","source":{"verdict":[],"index":{}}},'
            '{"index":7,"verdict":"RELEVANT","Indexes":true}]}',
            '{"ThoughtProcess":" note %d ","Decision":"finalize","ITEMS":['
            '{"Index":1,"VERDICT":"%s","Rationale":" r ","publicationdate":"%s","DateConfidence":"high"},{"INDEX":1,"verdict":"RELEVANT"}]}',
            '{"thoughtProcess":" note %d ","decision":"finalize","items":['
            '{"index":"1","verdict":"%s","rationale":" r ","publicationDate":"%s","dateConfidence":"high"},{"index":"-7","verdict":"RELEVANT"}]}',
        )
    ])
    good = F.get(forms, F.pmod("o_orderkey", F.lit(4)).cast("int"))
    status = F.col("o_orderstatus")
    mistyped = F.array(*[F.lit(x) for x in (
        '{"items":[{"index":"abc","verdict":"NOT_RELEVANT"}]}', '{"items":[{"index":1,"verdict":7}]}', '{"items":{"index":1}}',
        '{"decision":["FINALIZE"],"items":[]}', '{"items":[{"index":1.5,"verdict":"RELEVANT"}]}',
    )])
    bad = F.get(mistyped, F.pmod("o_orderkey", F.lit(5)).cast("int"))
    payload = (
        F.when(status == "O", "not json").when(status == "P", '{"decision":"FINALIZE"}')
        .when(F.pmod("o_orderkey", F.lit(7)) == 0, bad).otherwise(good)
    )
    return t.spread("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("group_id"),
        F.lit(1).alias("pass"), payload.alias("payload"),
    )


def order_pairs(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").cast("string").alias("group_id"),
        F.lit(1).alias("pass"), F.explode(F.array(F.lit(0), F.lit(1))).alias("doc_index"),
    )


@query(
    "verdict_json_rows",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS run_id, CAST(o_orderkey AS VARCHAR) AS group_id, CAST(1 AS INTEGER) AS pass,
    CAST(i AS INTEGER) AS doc_index,
    CASE WHEN good AND i = 1 THEN CASE WHEN o_totalprice > 200000 THEN 'Relevant' ELSE 'NotRelevant' END ELSE 'Borderline' END AS verdict,
    CASE WHEN NOT good THEN '{W.FAILED_RATIONALE}' WHEN i = 0 THEN '{W.OMITTED_RATIONALE}' ELSE 'r' END AS rationale,
    CASE WHEN good AND i = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS publication_date,
    CASE WHEN good AND i = 1 THEN 'High' ELSE 'Unknown' END AS date_confidence
  FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AS good FROM orders), range(2) r(i)""",
)
def verdict_json_rows(t):
    parsed = staged(V.parse_verdicts(order_answers(t)), stage_dir(t.spark, "answers"))
    verdicts = V.first_verdicts(V.verdict_rows(parsed))
    rows = V.fill_verdicts(order_pairs(t), verdicts, parsed.where("failed").select(*V.PASS))
    return rows.select(
        *V.DOC, "verdict", "rationale", iso(F.col("publication_date")).alias("publication_date"), "date_confidence"
    )


@query(
    "verdict_json_decisions",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS group_id, NOT good AS failed,
    CASE WHEN good THEN 'Finalize' ELSE 'Retry' END AS llm_decision,
    CASE WHEN good THEN 'note ' || o_orderkey ELSE '{W.FAILED_THOUGHT}' END AS thought_process
  FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AS good FROM orders)""",
)
def verdict_json_decisions(t):
    return V.parse_verdicts(order_answers(t)).select("group_id", "failed", "llm_decision", "thought_process")


@query(
    "first_verdict",
    """SELECT group_id, doc_index, verdict FROM (SELECT CAST(o_custkey AS VARCHAR) AS group_id,
      CAST(o_orderkey // 8 AS INTEGER) AS doc_index, o_orderstatus AS verdict,
      row_number() OVER (PARTITION BY o_custkey, o_orderkey // 8 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def first_verdict(t):
    rows = t.orders.select(
        F.col("o_custkey").cast("string").alias("group_id"),
        F.floor(F.col("o_orderkey") / 8).cast("int").alias("doc_index"),
        F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("item_pos"),
    )
    return V.first_verdicts(rows, GROUP_DOC).drop("item_pos")


# --- routing of orders: dated items with a window -------------------------------------

LOWER, UPPER = "1996-01-01", "1997-12-31"
CONFIDENCE = {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Medium", "5-LOW": "Low"}


def order_items(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    confidence = F.lit("Unknown")
    for key, value in CONFIDENCE.items():
        confidence = F.when(F.col("o_orderpriority") == key, value).otherwise(confidence)
    price = F.col("o_totalprice")
    items = t.orders.select(
        F.col("o_custkey").alias("group_id"), "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", W.RELEVANT).when(F.col("o_orderstatus") == "P", W.BORDERLINE)
        .otherwise(W.NOT_RELEVANT).alias("verdict"),
        F.when(price > 150000, day).alias("publication_date"),
        F.when(price < 300000, F.date_add(day, 400)).alias("effective_date"),
        F.when(price < 100000, F.date_sub(day, 400)).alias("applies_from"),
        confidence.alias("date_confidence"),
        F.lit(LOWER).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        F.lit(f"{UPPER} 23:30:00").cast("timestamp").alias("started_at"),
    )
    return V.route_items(items)


SQL_ROUTED = f"""
  i AS (SELECT o_custkey AS group_id, o_orderkey,
      CASE o_orderstatus WHEN 'F' THEN 'Relevant' WHEN 'P' THEN 'Borderline' ELSE 'NotRelevant' END AS verdict,
      CASE WHEN o_totalprice > 150000 THEN CAST(o_orderdate AS DATE) END AS pub,
      CASE WHEN o_totalprice < 300000 THEN CAST(o_orderdate AS DATE) + 400 END AS eff,
      CASE WHEN o_totalprice < 100000 THEN CAST(o_orderdate AS DATE) - 400 END AS app,
      o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS sure FROM orders),
  r AS (SELECT *, verdict <> 'NotRelevant' AND sure AND (coalesce(pub > DATE '{UPPER}', false)
          OR coalesce(coalesce(pub, eff, app) < DATE '{LOWER}', false)) AS out_of_window FROM i),
  routed AS (SELECT *, CASE WHEN verdict = 'NotRelevant' OR out_of_window THEN 'discarded' ELSE 'vetted' END AS route FROM r)"""


@query(
    "date_window_route",
    f"WITH {SQL_ROUTED} SELECT group_id, o_orderkey, verdict, route, out_of_window FROM routed",
)
def date_window_route(t):
    return order_items(t).select("group_id", "o_orderkey", "verdict", "route", "out_of_window")


@query(
    "route_counters",
    f"""WITH {SQL_ROUTED} SELECT group_id, count(*) FILTER (route = 'vetted') AS carried,
    count(*) FILTER (route = 'vetted' AND verdict = 'Borderline') AS borderline,
    count(*) FILTER (route = 'discarded') AS dropped, count(*) FILTER (out_of_window) AS out_of_window
  FROM routed GROUP BY 1""",
)
def route_counters(t):
    return V.route_counts(order_items(t), ["group_id"])


@query(
    "earliest_dates",
    f"""WITH {SQL_ROUTED} SELECT group_id, strftime(min(pub), '%Y-%m-%d') AS announcement_date,
    strftime(min(eff), '%Y-%m-%d') AS effective_date_of_change FROM routed WHERE route = 'vetted' GROUP BY 1""",
)
def earliest_dates(t):
    return R.earliest_dates(order_items(t).where(F.col("route") == "vetted"), ["group_id"])


# --- steer notes: facets are a part's words --------------------------------------------


def part_notes(t: Tables) -> DataFrame:
    missing = F.when(F.col("p_size") > 25, F.concat_ws(", ", "p_type", "p_brand")).otherwise("none")
    weak = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("facets "), F.regexp_replace("p_name", " ", ", "), F.lit(" are represented but the evidence is secondary")))
        .when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" is out-of-date")))
        .otherwise("none")
    )
    note = F.concat(F.lit("Missing facets: "), missing, F.lit(" - never retrieved. Weak evidence: "), weak, F.lit("."))
    return t.part.select("p_partkey", note.alias("thought_process"))


SQL_STEER = """
  s AS (SELECT p_partkey, unnest(CASE WHEN p_size > 25 THEN [p_type, p_brand] ELSE [] END) AS facet, 'MissingFacet' AS reason FROM part
    UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')), 'LowAuthority' FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT p_partkey, p_name, 'Stale' FROM part WHERE p_size % 3 = 1)"""


@query("steer_rows", f"WITH {SQL_STEER} SELECT p_partkey, facet, reason FROM s")
def steer_rows(t):
    return V.steer_rows(part_notes(t), ["p_partkey"]).drop("facet_pos")


@query("steer_counts", f"WITH {SQL_STEER} SELECT reason, count(*) AS n FROM s GROUP BY 1")
def steer_counts(t):
    return V.steer_rows(part_notes(t), ["p_partkey"]).groupBy("reason").agg(F.count("*").alias("n"))


# --- recall: the heuristic against the labels -------------------------------------------

TERMS = ["tion", "nder"]


def predicted(t: Tables) -> DataFrame:
    verdict = heuristic_verdict(
        F.col("source"), F.col("text"), F.array(*[F.lit(x) for x in TERMS]), ["src1", "src2"]
    )
    return t.spread("documents", "doc_id", "source", "lang", "text").select("doc_id", "source", "lang", verdict.alias("predicted"))


SQL_PREDICTED = """
  p AS (SELECT doc_id, source, lang, CASE WHEN NOT (contains(lower(text), 'tion') OR contains(lower(text), 'nder')) THEN 'NotRelevant'
      WHEN contains(source, 'src1') OR contains(source, 'src2') THEN 'Relevant' ELSE 'Borderline' END AS predicted FROM documents)"""


@query("heuristic_scorer", f"WITH {SQL_PREDICTED} SELECT source, predicted, count(*) AS n FROM p GROUP BY 1, 2")
def heuristic_scorer(t):
    return predicted(t).groupBy("source", "predicted").agg(F.count("*").alias("n"))


def sql_recall(rows: str, keys: str = "") -> str:
    return f"""SELECT {keys} count(*) AS total, count(*) FILTER (expected <> 'NotRelevant') AS carried_expected,
    count(*) FILTER (expected <> 'NotRelevant' AND predicted <> 'NotRelevant') AS carried_recalled,
    count(*) FILTER (expected = 'Relevant') AS relevant_expected,
    count(*) FILTER (expected = 'Relevant' AND predicted = 'Relevant') AS relevant_recalled,
    coalesce(count(*) FILTER (expected <> 'NotRelevant' AND predicted <> 'NotRelevant') / CAST(nullif(count(*) FILTER (expected <> 'NotRelevant'), 0) AS DOUBLE), 1.0) AS carried_recall,
    coalesce(count(*) FILTER (expected = 'Relevant' AND predicted = 'Relevant') / CAST(nullif(count(*) FILTER (expected = 'Relevant'), 0) AS DOUBLE), 1.0) AS relevant_recall
  FROM {rows}"""


@query(
    "recall_report",
    f"WITH {SQL_PREDICTED}, j AS (SELECT p.*, {SQL_VERDICT} AS expected FROM p JOIN labels USING (doc_id)) "
    + sql_recall("j", "lang,") + " GROUP BY lang",
)
def recall_report(t):
    expected = label_verdicts(t).select("doc_id", F.col("verdict").alias("expected"))
    return M.recall_report(predicted(t).join(expected, "doc_id"), ["lang"])


# --- reviews: labels correct the heuristic; toxic documents carry reason codes ----------


def reviews(t: Tables) -> DataFrame:
    return t.labels.select(
        "doc_id",
        F.when(F.col("quality") == 0, W.NOT_RELEVANT).alias("corrected_verdict"),
        F.lit("checked").alias("note"),
        F.when(F.col("toxic") == 1, F.array(F.lit("duplicate"), F.lit("not-a-code"), F.lit("duplicate")))
        .when(F.col("quality") == 0, F.array(F.lit("out-of-scope-topic"), F.lit("duplicate"))).alias("reason_codes"),
    )


def reviewed(t: Tables) -> DataFrame:
    return L.apply_reviews(predicted(t).withColumnRenamed("predicted", "verdict"), reviews(t), ["doc_id"])


@query(
    "review_recall",
    f"""WITH {SQL_PREDICTED}, j AS (SELECT p.*, CASE WHEN quality = 0 THEN 'NotRelevant' ELSE predicted END AS expected
    FROM p LEFT JOIN labels USING (doc_id)) """ + sql_recall("j"),
)
def review_recall(t):
    return M.recall_report(reviewed(t))


@query(
    "review_reason_codes",
    """SELECT reason_code, count(*) AS n FROM (
      SELECT unnest(CASE WHEN toxic = 1 THEN ['duplicate'] WHEN quality = 0 THEN ['out-of-scope-topic', 'duplicate'] ELSE [] END) AS reason_code
      FROM labels SEMI JOIN documents USING (doc_id)) GROUP BY 1""",
)
def review_reason_codes(t):
    return L.reason_counts(reviewed(t))


@query(
    "coverage_decisions",
    f"""WITH {SQL_FILLED} SELECT group_id, CASE WHEN count(*) FILTER (verdict <> 'NotRelevant') > 0 THEN 'Finalize' ELSE 'Retry' END AS llm_decision
  FROM (SELECT doc_id AS group_id, verdict FROM f) GROUP BY 1""",
)
def coverage(t):
    """Each document as a pass of its own: it wants to go on only when nothing was carried."""
    rows = filled(t).select(
        F.lit("r").alias("run_id"), F.col("doc_id").alias("group_id"), F.lit(1).alias("pass"), "verdict"
    )
    return coverage_decisions(rows).select("group_id", "llm_decision")


def length_verdicts(docs: pd.DataFrame) -> pd.DataFrame:
    """A predictor over batches that refuses some texts and answers others badly."""
    if docs["text"].str.contains("secret|token", regex=True).any():
        raise ValueError("refused")
    if docs["text"].str.contains("###", regex=False).any():
        raise BadOutput("no answer")
    long = docs["text"].str.len() > 1000
    return pd.DataFrame({"verdict": long.map({True: "Relevant", False: "Borderline"}), "rationale": docs["url"]})


@query(
    "predicted_verdicts",
    """SELECT source AS run_id, lang AS group_id, CAST(doc_id AS INTEGER) AS doc_index,
    CASE WHEN NOT (refused OR bad) THEN CASE WHEN length(text) > 1000 THEN 'Relevant' ELSE 'Borderline' END END AS verdict,
    CASE WHEN NOT (refused OR bad) THEN 'doc ' || doc_id END AS rationale, bad AND NOT refused AS fallback,
    CASE WHEN refused THEN 'refused' END AS error
  FROM (SELECT *, regexp_matches(text, 'secret|token') AS refused, contains(text, '###') AS bad FROM documents)""",
)
def predicted_verdicts(t):
    """A batch predictor over all documents; rows that fail do so alone."""
    docs = t.documents.select(
        F.col("source").alias("run_id"), F.col("lang").alias("group_id"), F.lit(1).alias("pass"), F.col("doc_id").cast("int").alias("doc_index"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("url"), "text",
    )
    return predictor_scorer(length_verdicts)(docs).select("run_id", "group_id", "doc_index", "verdict", "rationale", "fallback", "error")
