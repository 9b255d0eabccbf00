"""Input-table queries: budgets, context blocks, evaluation, query, label and record inputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farsight.functions import verdicts as W
from farsight.functions.text import (
    DOCUMENT_CHARS, document_clip, head_clip, text_budget,
)
from farsight.operators import inputs as I
from farsight.operators import labels as L
from farsight.operators.ordinals import PART_ROWS
from farsight.session import stage_dir, staged
from farsight.sources.vocabulary import vocabulary_terms
from workload.labels import SQL_PRIORS, SQL_VOCABULARY, customer_priors, part_vocabulary
from workload.registry import Tables, query
from workload.verdicts import SQL_FILLED, filled

# --- documents as carried items of their source ------------------------------------------


def items(t: Tables) -> DataFrame:
    """Judged documents as carried items with text, some without text or notes."""
    docs = t.documents.select("doc_id", "text", "lang")
    no_date = F.lit(None).cast("date")
    return filled(t).join(docs, "doc_id").select(
        F.lit("run").alias("run_id"), "group_id", F.col("doc_id").cast("string").alias("id"), "doc_id", "doc_index",
        F.array(F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).alias("source_urls"),
        F.lit("example.org").alias("domain"), "verdict", F.col("rationale").alias("eval_rationale"), "date_confidence",
        F.when(F.col("lang") == "fr", F.lit("2025-06-15").cast("date")).alias("publication_date"),
        F.when(F.col("lang") != "es", F.lit("2026-04-06").cast("date")).alias("effective_date"),
        no_date.alias("applies_from"), no_date.alias("applies_to"),
        F.when(F.col("lang") != "de", F.col("text")).alias("full_text"),
        F.col("lang").alias("group_name"), F.lit("UK").alias("jurisdiction"),
    )


SQL_DATES = "nullif(concat_ws(', ', CASE WHEN lang = 'fr' THEN 'published 2025-06-15' END, CASE WHEN lang <> 'es' THEN 'effective 2026-04-06' END), '')"


def _sql_block(index: str, budget: str) -> str:
    return f"""concat_ws(chr(10), 'Update ' || {index} || ':', '  Source URL: https://example.org/' || doc_id,
      '  Relevance notes: ' || rationale, '  Dates: ' || {SQL_DATES},
      '  Full text: ' || CASE WHEN lang = 'de' OR {_SQL_BLANK} THEN '{I.NO_FULL_TEXT}' ELSE substr(text, 1, {budget}) END, '')"""


_SQL_BLANK = r"NOT regexp_matches(text, '[^\s\x0B\x{85}\p{Z}]')"
SQL_ITEMS = f"{SQL_FILLED}, it AS (SELECT f.*, text, lang FROM f JOIN documents USING (doc_id))"


@query("text_budget", "SELECT source, CAST(greatest(2000, 48000 // count(*)) AS INTEGER) AS budget FROM documents GROUP BY 1")
def text_budgets(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).select(
        "source", text_budget(F.col("n")).alias("budget")
    )


@query(
    "head_clip",
    r"""SELECT doc_id, CASE WHEN length(x) <= 2000 THEN x ELSE substr(x, 1, 2000) || chr(10) || '[...truncated...]' END AS clipped,
    substr(text, 1, 1200) AS field FROM (SELECT *, trim(text, E' \t\n\r') AS x FROM documents)""",
)
def head_clips(t):
    return t.documents.select(
        "doc_id", document_clip(F.col("text"), 2000).alias("clipped"), head_clip(F.col("text"), 1200).alias("field")
    )


@query(
    "context_block",
    f"""WITH {SQL_ITEMS} SELECT doc_id, '{I.BLOCK_HEADER}' || chr(10) || {_sql_block("1", "48000")} AS updates_block FROM it""",
)
def context_block(t):
    return I.item_blocks(items(t)).select("doc_id", "updates_block")


@query(
    "group_context_blocks",
    f"""WITH {SQL_ITEMS}, n AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM it),
  b AS (SELECT group_id, doc_index, CASE WHEN doc_index = 0 THEN '{I.BLOCK_HEADER}' || chr(10) ELSE '' END
          || {_sql_block("(doc_index + 1)", "greatest(2000, 48000 // n)")} AS block FROM n)
  SELECT group_id, CAST(doc_index // {PART_ROWS} AS INTEGER) AS part, string_agg(block, chr(10) ORDER BY doc_index) AS text FROM b GROUP BY 1, 2""",
)
def group_context_blocks(t):
    rows = staged(items(t), stage_dir(t.spark, "items"))
    return I.group_blocks(rows, ["group_id"], "doc_index")


@query(
    "group_context_whole",
    f"""WITH {SQL_ITEMS}, n AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM it),
  b AS (SELECT group_id, doc_index, CASE WHEN doc_index = 0 THEN '{I.BLOCK_HEADER}' || chr(10) ELSE '' END
          || {_sql_block("(doc_index + 1)", "greatest(2000, 48000 // n)")} AS block FROM n)
  SELECT group_id, sha256(string_agg(block, chr(10) ORDER BY doc_index)) AS text_sha256 FROM b GROUP BY 1""",
)
def group_context_whole(t):
    """The digest of the parts of each group's block, of seven items each, read in order as one text.

    A digest reads its text from front to back, so a group is hashed by one task, but part by part: no row
    or buffer holds more than a batch of parts.
    """
    rows = staged(items(t), stage_dir(t.spark, "items"))
    parts = I.group_blocks(rows, ["group_id"], "doc_index", rows=7)
    ordered = parts.select("group_id", "part", "text").repartition("group_id").sortWithinPartitions("group_id", "part")
    return ordered.mapInArrow(digest_parts, "group_id string, text_sha256 string")


def digest_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group_id, SHA-256 of its texts joined by line breaks) of rows (group_id, part, text) in that order."""
    key = digest = None
    started = False  # rows have been seen, as a null is a group too
    for batch in batches:
        done = []
        for group, text in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.large_binary())):
            if not started or group != key:
                if started:
                    done.append((key, digest and digest.hexdigest()))
                started, key, digest = True, group, None
            if not text.is_valid:
                continue
            if digest is None:
                digest = hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(text.as_buffer())
        if done:
            yield _digest_rows(done)
    if started:
        yield _digest_rows([(key, digest and digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["group_id", "text_sha256"])


# --- passes: a document's pass is its position in the source, one of three -----------------


def pass_items(t: Tables) -> DataFrame:
    """Items found on pass 1..3 of their source (by the length of the document's text)."""
    found = F.when(F.length("full_text") > 3000, 3).when(F.length("full_text") > 1000, 2).otherwise(1)
    return items(t).withColumn("found_on_pass", found)


def source_passes(t: Tables) -> DataFrame:
    """Three passes per source with their query, note and group columns."""
    return t.documents.select("source").distinct().select(
        F.lit("run").alias("run_id"), F.col("source").alias("group_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("pass"),
    ).select(
        "*", F.concat(F.lit("Theme "), "group_id").alias("group_name"), F.array(F.lit("alpha"), F.col("group_id")).alias("keywords"),
        F.lit(3).alias("max_loops"), F.lit("UK").alias("jurisdiction"), F.lit(None).cast("date").alias("start_date"),
        F.lit("2026-06-30").cast("date").alias("end_date"), F.lit("2026-07-01").cast("timestamp").alias("started_at"),
        F.concat(F.lit("query "), F.col("pass").cast("string")).alias("query"),
        F.concat(F.lit(" note "), F.col("pass").cast("string")).alias("thought_process"),
        F.lit(W.RETRY).alias("final_decision"),
    )


SQL_PASS_ITEMS = f"""{SQL_ITEMS},
  pi AS (SELECT *, CASE WHEN lang <> 'de' AND length(text) > 3000 THEN 3 WHEN lang <> 'de' AND length(text) > 1000 THEN 2 ELSE 1 END AS found FROM it),
  ps AS (SELECT DISTINCT source AS group_id, p FROM documents, (VALUES (1), (2), (3)) v(p)),
  vl AS (SELECT ps.group_id, p, found, doc_index, '- [' || verdict || '] https://example.org/' || doc_id || ' (found pass ' || found || '; dates pub='
      || CASE WHEN lang = 'fr' THEN '2025-06-15' ELSE '?' END || ' eff=' || CASE WHEN lang <> 'es' THEN '2026-04-06' ELSE '?' END
      || ' applies=?->? conf=' || date_confidence || ')' || chr(10) || '    why: ' || rationale AS line
    FROM ps JOIN pi ON pi.group_id = ps.group_id AND found < p WHERE verdict <> 'NotRelevant')"""


@query(
    "prior_context",
    f"""WITH {SQL_PASS_ITEMS} SELECT group_id, CAST(p AS INTEGER) AS pass, CAST(found AS INTEGER) AS found_on_pass, doc_index, line FROM vl""",
)
def prior_context(t):
    vetted = pass_items(t).where(F.col("verdict") != W.NOT_RELEVANT)
    return I.prior_vetted_lines(vetted, source_passes(t)).drop("run_id")


@query(
    "eval_input",
    f"""WITH {SQL_PASS_ITEMS},
  head AS (SELECT group_id, p, 0 AS section, 0 AS part, 'Topic group: Theme ' || group_id || chr(10) || 'Jurisdiction: UK' || chr(10)
      || 'Date range: on or before 2026-06-30' || chr(10) || 'Pass: ' || p || ' of up to 3' || chr(10)
      || 'Keyword / synonym OR-list defining the theme:' || chr(10) || '- alpha' || chr(10) || '- ' || group_id AS text FROM ps),
  vn AS (SELECT *, row_number() OVER (PARTITION BY group_id, p ORDER BY found, doc_index) - 1 AS o FROM vl),
  vt AS (SELECT ps.group_id, ps.p, 1 AS section, -1 AS part, chr(10) || 'Previously vetted results carried from earlier passes (' || count(o)
      || ') - context only, already counted toward coverage; do NOT re-evaluate or assign these a verdict:'
      || CASE WHEN count(o) = 0 THEN chr(10) || '{I.NO_VETTED}' ELSE '' END FROM ps LEFT JOIN vn USING (group_id, p) GROUP BY 1, 2),
  vp AS (SELECT group_id, p, 1, o // {PART_ROWS}, string_agg(line, chr(10) ORDER BY o) FROM vn GROUP BY 1, 2, 4),
  atitle AS (SELECT group_id, p, 2, -1, chr(10) || 'Previous search attempts (' || (p - 1) || '):' || CASE WHEN p = 1 THEN chr(10) || '{I.NO_ATTEMPTS}' ELSE '' END FROM ps),
  ap AS (SELECT group_id, p, 2, 0, string_agg('<attempt ' || q || '> query: query ' || q || ' | decision: Retry' || chr(10) || '    notes: note ' || q, chr(10) ORDER BY q)
    FROM ps JOIN (VALUES (1), (2)) v(q) ON q < p GROUP BY 1, 2),
  dt AS (SELECT group_id, found, 3, -1, chr(10) || 'Documents to evaluate THIS pass (' || count(*) || '). These are the ONLY documents to classify - return exactly one verdict per index. Do NOT emit verdicts for the previously-vetted results above:'
    FROM pi GROUP BY 1, 2),
  dp AS (SELECT group_id, found, 3, doc_index // {PART_ROWS}, string_agg(chr(10) || '=== Document index ' || doc_index || ' ===' || chr(10)
      || 'URL: https://example.org/' || doc_id || chr(10) || 'Domain: example.org' || chr(10)
      || CASE WHEN lang = 'de' THEN '{I.UNVERIFIED_NOTE}' || chr(10) ELSE '' END || 'Full text:' || chr(10)
      || CASE WHEN lang = 'de' OR {_SQL_BLANK} THEN '(no text available)' WHEN length(trim(text, E' \\t\\n\\r')) > {DOCUMENT_CHARS}
         THEN substr(trim(text, E' \\t\\n\\r'), 1, {DOCUMENT_CHARS}) || chr(10) || '[...truncated...]' ELSE trim(text, E' \\t\\n\\r') END, chr(10) ORDER BY doc_index)
    FROM pi GROUP BY 1, 2, 4)
  SELECT group_id, CAST(p AS INTEGER) AS pass, CAST(section AS INTEGER) AS section, CAST(part AS INTEGER) AS part, text FROM (
    SELECT * FROM head UNION ALL SELECT * FROM vt UNION ALL SELECT * FROM vp UNION ALL SELECT * FROM atitle
    UNION ALL SELECT * FROM ap UNION ALL SELECT * FROM dt UNION ALL SELECT * FROM dp)""",
)
def eval_input(t):
    rows = staged(pass_items(t), stage_dir(t.spark, "items"))
    docs = rows.select(
        "run_id", "group_id", F.col("found_on_pass").alias("pass"), "doc_index", F.col("source_urls")[0].alias("url"),
        "domain", F.col("full_text").isNull().alias("unverified"), F.col("full_text").alias("cleaned_text"),
    )
    passes = staged(source_passes(t), stage_dir(t.spark, "passes"))
    reviews = passes.select(*I.PASS, "query", "thought_process", "final_decision")
    return I.eval_input(passes, docs, rows.where(F.col("verdict") != W.NOT_RELEVANT), reviews).drop("run_id")


@query(
    "query_input",
    f"""WITH ps AS (SELECT DISTINCT source AS group_id, p FROM documents, (VALUES (1), (2), (3)) v(p)),
  tried AS (SELECT group_id, p, string_agg('- query ' || q, chr(10) ORDER BY q) AS qs, string_agg('-  note ' || q, chr(10) ORDER BY q) AS ns
    FROM ps JOIN (VALUES (1), (2)) v(q) ON q < p GROUP BY 1, 2)
  SELECT ps.group_id, CAST(ps.p AS INTEGER) AS pass, concat_ws(chr(10), 'Topic group: Theme ' || ps.group_id, 'Jurisdiction: UK', 'Pass: ' || ps.p || ' of up to 3',
    'Keyword / synonym OR-list:', '- alpha', '- ' || ps.group_id,
    'Queries already tried (do not repeat; cover the same theme from an angle that fills a gap):', coalesce(qs, '{I.NO_QUERIES}'),
    CASE WHEN ns IS NOT NULL THEN 'Reviewer notes from earlier passes (what was found and what is still missing - steer toward the gaps):' || chr(10) || ns END,
    '{I.QUERY_CLOSING}') AS text FROM ps LEFT JOIN tried ON ps.group_id = tried.group_id AND ps.p = tried.p""",
)
def query_input(t):
    passes = source_passes(t)
    return I.query_input(passes, passes.select(*I.PASS, "query", "thought_process")).drop("run_id")


# --- label and record inputs ---------------------------------------------------------------

_SQL_BLOCK1 = f"'{I.BLOCK_HEADER}' || chr(10) || {_sql_block('1', '48000')}"


@query(
    "label_input",
    f"""WITH {SQL_ITEMS}, {SQL_VOCABULARY}, al AS (SELECT string_agg('- ' || name, chr(10) ORDER BY name) AS approved FROM terms WHERE doc_type = 'ImpactAreas')
  SELECT doc_id, approved AS approved_list, concat_ws(chr(10), 'Topic group: ' || lang, 'Jurisdiction: UK', '', {_SQL_BLOCK1}, '{I.AREA_CLOSING}') AS text FROM it, al""",
)
def label_input(t):
    terms = vocabulary_terms(part_vocabulary(t), "ImpactAreas")
    return I.label_input(I.item_blocks(items(t)), terms, "impact_area").select("doc_id", "approved_list", "text")


@query(
    "tag_input",
    f"""WITH {SQL_ITEMS} SELECT doc_id, concat_ws(chr(10), 'Topic group: ' || lang, 'Jurisdiction: UK', '', {_SQL_BLOCK1}, '{I.TAGS_CLOSING}') AS text FROM it""",
)
def tag_input(t):
    """The tag prompt of every item; the list that goes before it is ``approved_tags``."""
    terms = vocabulary_terms(part_vocabulary(t), "tags")
    return I.label_prompts(I.item_blocks(items(t)), terms, "tags").select("doc_id", "text")


@query(
    "approved_tags",
    f"""WITH {SQL_VOCABULARY}, n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS nth FROM terms WHERE doc_type = 'tags')
  SELECT CAST(nth // 64 AS INTEGER) AS part, string_agg('- ' || name, chr(10) ORDER BY nth) AS text FROM n GROUP BY 1""",
)
def approved_tags(t):
    return I.approved_parts(vocabulary_terms(part_vocabulary(t), "tags"), 64)


@query(
    "record_input",
    f"""WITH {SQL_ITEMS}, {SQL_PRIORS},
  e AS (SELECT *, row_number() OVER (PARTITION BY jk ORDER BY file_pos) AS rk FROM pr),
  x AS (SELECT jk, string_agg(concat_ws(chr(10), 'Example ' || rk || ':', '  Title: ' || title_of_update, '  Impact area: ' || impact_area,
      '  Tags: ' || replace(tags, '|', ', '), '  Company View: ' || company_view, ''), chr(10) ORDER BY rk) AS body FROM e WHERE rk <= 5 GROUP BY 1)
  SELECT doc_id, concat_ws(chr(10), 'Topic group: ' || lang, 'Jurisdiction: ' || jn, CASE WHEN lang = 'en' THEN 'Impact area (assigned for this group): Rates' END,
    'Tags (assigned for this group): ' || lang || ', x', '', {_SQL_BLOCK1},
    CASE WHEN body IS NULL THEN '=== Prior Company View records for this jurisdiction ===' || chr(10) || '(none available - write in a professional advisory style)'
      ELSE '=== Prior Company View records for ' || jn || ' (house-style examples; do NOT copy their facts) ===' || chr(10) || body END,
    '{I.RECORD_CLOSING}') AS text
  FROM (SELECT *, CASE WHEN lang = 'es' THEN 'Nowhere' ELSE 'nation ' || substr(group_id, 4) END AS jn FROM it) i LEFT JOIN x ON x.jk = i.jn""",
)
def record_input(t):
    """Jurisdiction is the nation numbered like the source; Spanish documents have none."""
    nation = F.when(F.col("group_name") == "es", "Nowhere").otherwise(F.concat(F.lit("nation "), F.substring("group_id", 4, 9)))
    labelled = I.item_blocks(items(t)).withColumns({
        "jurisdiction": nation, "impact_area": F.when(F.col("group_name") == "en", "Rates"),
        "tags": F.array("group_name", F.lit("x")),
    })
    return I.record_input(L.attach_exemplars(labelled, customer_priors(t))).select("doc_id", "text")
