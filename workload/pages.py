"""Page cleaning, date harvest, admission and charset queries; the whole scan."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from farsight.functions.html import decode_body, normalize_label
from farsight.plans.makers import heuristic_scorer, predictor_scorer
from farsight.plans.scan import DOC, GROUP, PASS, finalize, page_corpus, run_scan, scan_results
from farsight.session import local_table, stage_dir, staged
from farsight.sources.pages import admit, clean_html
from farsight.sources.vocabulary import vocabulary_rows
from workload.registry import SQL_PAGE_RUN, THEMES, Tables, page_run, query, sql_url_key

# Text of the article of a test page; entities without a semicolon stay as they are.
SQL_TEXT = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(
    regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))"""


@query("html_text", f"SELECT page_id, {SQL_TEXT} AS cleaned_text FROM pages")
def html_text(t):
    return clean_html(t.spread("pages", "page_id", "html")).select("page_id", "cleaned_text")


def dated_pages(t: Tables) -> DataFrame:
    """Orders as pages whose dates stand in meta, time and definition-list elements."""
    d = F.col("o_orderdate")
    html = F.concat(
        F.lit('<html><head><meta name="viewport" content="width=1024"><meta property="x:published-at" content="'),
        F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit('+01:00"></head><body><header><nav>Menu 2020-01-01</nav><dl><dt>From:</dt><dd>Clerk &amp; Co 12</dd>'),
        F.lit("<dt>Published:</dt><dd>"), F.date_format(d, "d MMMM yyyy"),
        F.lit("</dd>\n<dt>Updated :</dt> <dd>"), F.date_format(F.date_add(d, 40), "MMMM d, yyyy"),
        F.lit(' - <a href="/u">See all</a></dd><dd>'), F.date_format(F.date_add(d, 40), "yyyy-MM-dd"),
        F.lit('</dd></dl></header><time datetime=" ">'), F.date_format(F.date_add(d, 80), "EEE, d MMM yyyy"),
        F.lit('</time><time datetime="'), F.date_format(F.date_add(d, 80), "yyyy-MM-dd"),
        F.lit('">soon</time><main><p>Order &pound;'), F.col("o_orderkey").cast("string"), F.lit("</p>\n <form>x</form><p>of "),
        F.col("o_orderstatus"), F.lit("</p></main></body></html>"),
    )
    return t.spread("orders", "o_orderkey", "o_orderdate", "o_orderstatus").select("o_orderkey", html.alias("html"))


@query(
    "page_dates",
    """SELECT o_orderkey, 'x:published-at=' || strftime(o_orderdate, '%Y-%m-%d') || '|date=' || strftime(o_orderdate + INTERVAL 80 DAY, '%Y-%m-%d')
    || '|Published=' || strftime(o_orderdate, '%Y-%m-%d') || '|Updated=' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS dates,
    'Dates found on page:' || chr(10) || '- x:published-at: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10)
    || '- date: ' || strftime(o_orderdate + INTERVAL 80 DAY, '%Y-%m-%d') || chr(10) || '- Published: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10)
    || '- Updated: ' || strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') || chr(10) || chr(10) || 'Order £' || o_orderkey || ' of ' || o_orderstatus AS cleaned_text
  FROM orders""",
)
def page_dates(t):
    """Repeats of a label and date are dropped; the page text comes from main only."""
    cleaned = clean_html(dated_pages(t))
    pairs = F.transform("dates", lambda d: F.concat_ws("=", d["label"], d["date"]))
    return cleaned.select("o_orderkey", F.array_join(pairs, "|").alias("dates"), "cleaned_text")


@query(
    "label_normalize",
    """SELECT p_partkey, p_name AS label FROM part""",
)
def label_normalize(t):
    written = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " \n "), F.lit("  ::"))
    return t.part.select("p_partkey", normalize_label(written).alias("label"))


# --- admission: a page's language decides what its fetch went like ------------------------

LIMIT = 6000


def fetched_pages(t: Tables) -> DataFrame:
    run = page_run()
    size = F.octet_length("html")
    return t.pages.where(~F.col("url").contains("cheap-pills")).select(
        "url", F.when(run == "es", 404).otherwise(200).alias("status"),
        F.when(run == "de", "application/json").otherwise("Text/HTML; charset=\"utf-8\"").alias("content_type"),
        F.when(F.col("url").startswith("http:"), size).alias("content_length"),
        F.col("html").cast("binary").alias("body"),
    )


def admission_hits(t: Tables) -> DataFrame:
    """Every page asked for twice, once by a relative address."""
    urls = F.array(F.col("url"), F.regexp_replace("url", "^https?://[^/]+", ""))
    return t.pages.select("page_id", F.explode(urls).alias("url"))


@query(
    "page_admission",
    f"""WITH p AS (SELECT *, {SQL_PAGE_RUN} AS run, {SQL_TEXT} AS text FROM pages),
  r AS (SELECT page_id, url, text, CASE WHEN contains(url, 'cheap-pills') THEN 'not_fetched' WHEN run = 'es' THEN 'status' WHEN run = 'de' THEN 'content_type'
      WHEN starts_with(url, 'http:') AND strlen(html) > {LIMIT} THEN 'declared_size' WHEN strlen(html) > {LIMIT} THEN 'actual_size'
      WHEN text = '' THEN 'blank_text' END AS why FROM p)
  SELECT page_id, url, why AS fetch_reason, why IS NOT NULL AS unverified, CASE WHEN why IS NULL THEN text END AS cleaned_text FROM r
  UNION ALL SELECT page_id, regexp_replace(url, '^https?://[^/]+', ''), 'not_http', true, NULL FROM pages""",
)
def page_admission(t):
    return admit(admission_hits(t), fetched_pages(t), LIMIT).select(
        "page_id", "url", "fetch_reason", "unverified", "cleaned_text"
    )


@query("charset_decode", "SELECT doc_id, text FROM documents")
def charset_decode(t):
    """Texts written in the charset their language stands for read back unchanged."""
    lang = F.col("lang")
    wide = F.when(lang == "de", F.encode("text", "UTF-16LE")).when(lang == "fr", F.encode("text", "UTF-32"))
    body = F.coalesce(wide, F.encode("text", "UTF-8"))
    kind = (
        F.when(lang == "de", "text/html; charset=utf-16").when(lang == "fr", 'text/html; Charset="UTF-32BE"; x=y')
        .when(lang == "es", "text/html; charset=klingon").otherwise("text/html")
    )
    return t.documents.select("doc_id", body.alias("body"), kind.alias("kind")).select(
        "doc_id", decode_body(F.col("body"), F.col("kind")).alias("text")
    )


# --- the whole scan --------------------------------------------------------------------------


def scan_requests(t: Tables) -> DataFrame:
    """One run per nation with the theme groups; no end date, so the start day bounds it."""
    groups = F.array(*[F.lit(", ".join(ks)) for _, _, ks in THEMES], F.lit("qqqq, zzzz"))
    return t.nation.select(
        F.col("n_name").alias("run_id"), F.col("n_name").alias("jurisdiction"), F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"), F.lit("2026-07-01 09:00:00").cast("timestamp").alias("started_at"),
        groups.alias("topic_groups"),
    )


def sql_scan_views(broken: str = "false", dead: str = "false") -> str:
    """The scan in SQL: one block of views per pass, as many as a group may take.

    Groups that are ``broken`` have a failing search; the ``dead`` ones' scorer fails, which ends them.
    """
    words = r"string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+')"
    groups = [ks for _, _, ks in THEMES] + [["qqqq", "zzzz"]]
    listed = ", ".join(f"({i}, {ks!r}, '{', '.join(ks)}')" for i, ks in enumerate(groups))
    views = [
        f"txt AS MATERIALIZED (SELECT url, {sql_url_key('url')} AS key, {SQL_TEXT} AS text FROM pages)",
        f"w AS MATERIALIZED (SELECT url, key, unnest({words.format('text')}) AS term FROM txt)",
        f"grp AS (SELECT n_name AS run_id, ord, ks, name FROM nation, (VALUES {listed}) g(ord, ks, name))",
    ]
    for p in (1, 2, 3):
        active = "grp" if p == 1 else f"(SELECT grp.* FROM grp JOIN dec{p - 1} USING (run_id, ord) WHERE final = 'Retry' AND NOT ({dead}))"
        seen = " UNION ALL ".join(f"SELECT run_id, ord, key FROM raw{q}" for q in range(1, p)) or "SELECT run_id, ord, '' AS key FROM grp WHERE false"
        query_text = f"ks[({p} - 1) % len(ks) + 1] || ' ' || run_id || ' update'"
        views += [
            f"act{p} AS {active if p > 1 else '(SELECT * FROM grp)'}",
            f"q{p} AS (SELECT DISTINCT run_id, ord, unnest({words.format(query_text)}) AS term FROM act{p})",
            f"s{p} AS (SELECT run_id, ord, url, key, count(DISTINCT term) AS m, count(*) AS n FROM w JOIN q{p} USING (term) WHERE term <> '' GROUP BY ALL)",
            f"raw{p} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, ord ORDER BY m DESC, n DESC, url) AS rank FROM s{p}) WHERE rank <= 10)",
            f"seen{p} AS ({seen})",
            f"""kept{p} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY ord, rank) AS rn FROM raw{p}
              WHERE (run_id, key) NOT IN (SELECT (run_id, key) FROM seen{p})) WHERE rn = 1)""",
            f"""v{p} AS (SELECT {p} AS p, k.run_id, k.ord, rank, k.url, CASE WHEN NOT list_bool_or(list_transform(ks, lambda x: contains(lower(text), x))) THEN 'NotRelevant'
              WHEN contains(lower(k.url), '.com') OR contains(lower(k.url), '.net') THEN 'Relevant' ELSE 'Borderline' END AS verdict
              FROM kept{p} k JOIN txt USING (url) JOIN grp g ON g.run_id = k.run_id AND g.ord = k.ord)""",
            f"""dec{p} AS MATERIALIZED (SELECT run_id, ord, CASE WHEN {p} = 3 THEN 'Finalize' WHEN count(verdict) = 0 THEN CASE WHEN {broken} THEN 'Retry' ELSE 'Finalize' END
              WHEN count(*) FILTER (verdict <> 'NotRelevant') = 0 THEN 'Retry'
              WHEN count(*) FILTER (verdict = 'Relevant') >= 0.8 * count(verdict) THEN 'Retry' ELSE 'Finalize' END AS final
              FROM act{p} LEFT JOIN v{p} USING (run_id, ord) GROUP BY 1, 2)""",
        ]
    found = " UNION ALL ".join(f"SELECT * FROM v{p}" for p in (1, 2, 3))
    passes = " UNION ALL ".join(f"SELECT run_id, ord FROM act{p}" for p in (1, 2, 3))
    return f"""WITH {", ".join(views)}, items AS (SELECT * FROM ({found}) WHERE verdict <> 'NotRelevant' AND NOT ({dead})),
  loops AS (SELECT run_id, ord, count(*) AS n FROM ({passes}) GROUP BY 1, 2)"""


def sql_scan() -> str:
    return f"""{sql_scan_views()}
  SELECT run_id, CAST(ord AS INTEGER) AS group_ord, ks[1] || '-' || substr(sha256(array_to_string(list_sort(ks), chr(10))), 1, 8) AS group_id,
    name AS group_name, 'Completed' AS status, CAST(any_value(loops.n) AS INTEGER) AS loop_count, CAST(count(url) AS INTEGER) AS n_items,
    string_agg(url, ' | ' ORDER BY p, rank) AS urls
  FROM grp JOIN loops USING (run_id, ord) LEFT JOIN items USING (run_id, ord) GROUP BY run_id, ord, ks, name"""


@query("full_scan", sql_scan())
def full_scan(t):
    """Requests of every nation over all pages: passes, labels, records, nested results.

    The last group's words occur nowhere, so it ends empty.
    """
    root = stage_dir(t.spark, "scan")
    corpus = staged(page_corpus(t.spread("pages", "url", "html")), f"{root}/corpus")
    requests = scan_requests(t)
    scan = run_scan(requests, corpus, root, scorer=heuristic_scorer([".com", ".net"]))
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    vocabulary = vocabulary_rows(words, "tags").unionByName(vocabulary_rows(t.part.select(F.col("p_type").alias("name")), "ImpactAreas"))
    results, records = finalize(scan, vocabulary)
    nested = scan_results(results, records, requests)
    return nested.select(
        "run_id", "group_ord", "group_id", "group_name", "status", "loop_count",
        F.coalesce(F.size("items"), F.lit(0)).alias("n_items"),
        F.array_join(F.transform("items", lambda i: i["source_urls"][0]), " | ").alias("urls"),
    )


# Terms of the vocabulary, and where the text of an item holds one, word by word.
TAG_TERMS, AREA_TERMS = ["the", "Und", "DE", "of the"], ["la", "And", "der"]


def label_vocabulary(t: Tables) -> DataFrame:
    """The listed terms beside those of the parts, few of which occur on pages."""
    listed = lambda terms, kind: vocabulary_rows(local_table(t.spark, [(x,) for x in terms], "name string"), kind)
    parts = vocabulary_rows(t.part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct(), "tags")
    return listed(TAG_TERMS, "tags").unionByName(parts).unionByName(listed(AREA_TERMS, "ImpactAreas"))


def dated_scorer():
    """The heuristic verdicts with dates that come from the text's length."""
    score = heuristic_scorer([".com", ".net"])

    def run(docs: DataFrame) -> DataFrame:
        days = docs.select(*DOC, F.date_add(F.lit("2025-01-01").cast("date"), F.length("cleaned_text") % 300).alias("day"))
        dated = score(docs).drop("publication_date", "effective_date").join(days, DOC)
        return dated.withColumns({"publication_date": F.col("day"), "effective_date": F.date_add("day", 30)}).drop("day")

    return run


def domain_records(items: DataFrame) -> DataFrame:
    """Record maker: judged fields from the item's site; a blank one becomes null."""
    return items.select(
        *GROUP, "id", F.concat(F.lit(" Page of "), "domain").alias("title_of_update"), F.col("verdict").alias("summary_of_update"),
        F.lit("  ").alias("company_view"), F.when(F.col("verdict") == "Relevant", "High").alias("level_of_authority"),
        F.lit("New").alias("status_of_change"), F.col("domain").alias("regulator"),
    )


_SQL_WORDED = r"(' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ')"
_SQL_AREA = "(SELECT arg_min(a, {{'p': position(' ' || lower(a) || ' ' IN words), 'a': a}}) FROM (VALUES {}) v(a) WHERE contains(words, ' ' || lower(a) || ' '))".format(
    ", ".join(f"('{a}')" for a in AREA_TERMS))


@query(
    "full_scan_records",
    f"""{sql_scan_views()},
  vocab AS (SELECT name FROM (VALUES {", ".join(f"('{x}')" for x in TAG_TERMS)}) v(name)
    UNION SELECT unnest(string_split(p_name, ' ')) FROM part),
  body AS (SELECT i.*, {_SQL_WORDED} AS words, len(text) AS chars, regexp_extract(url, '^https?://([^/]+)', 1) AS site FROM items i JOIN txt USING (url)),
  tags AS (SELECT run_id, ord, url, string_agg(name, '|' ORDER BY position(' ' || lower(name) || ' ' IN words), name) AS tags
    FROM body JOIN (SELECT min(name) AS name FROM vocab GROUP BY lower(name)) ON contains(words, ' ' || lower(name) || ' ') GROUP BY ALL)
  SELECT b.run_id, CAST(b.ord AS INTEGER) AS group_ord, CAST(p AS INTEGER) AS found_on_pass, b.url, b.run_id AS jurisdiction, {_SQL_AREA} AS impact_area, coalesce(tags, '') AS tags,
    'Page of ' || site AS title_of_update, verdict AS summary_of_update, NULL::VARCHAR AS company_view, CASE WHEN verdict = 'Relevant' THEN 'High' END AS level_of_authority,
    'New' AS status_of_change, strftime(DATE '2025-01-01' + (chars % 300)::INTEGER, '%Y-%m-%d') AS announcement_date,
    strftime(DATE '2025-01-31' + (chars % 300)::INTEGER, '%Y-%m-%d') AS effective_date_of_change, b.url AS supporting_reference, site AS regulator,
    'Read on pass ' || p AS what_it_does
  FROM body b LEFT JOIN tags USING (run_id, ord, url)""",
)
def full_scan_records(t):
    """Every column of the records of a whole scan: labels that occur in the texts, dates, judged fields and what it does."""
    root = stage_dir(t.spark, "scan")
    corpus = staged(page_corpus(t.spread("pages", "url", "html")), f"{root}/corpus")
    scan = run_scan(scan_requests(t), corpus, root, scorer=dated_scorer())
    does = F.concat(F.lit("Read on pass "), F.col("found_on_pass").cast("string"))
    _, records = finalize(scan, label_vocabulary(t), record_maker=domain_records, what_it_does=does)
    return records.join(scan.groups.select(*GROUP, "group_ord"), GROUP).select(
        "run_id", "group_ord", "found_on_pass", F.element_at("source_urls", 1).alias("url"), "jurisdiction", "impact_area",
        F.array_join("tags", "|").alias("tags"), "title_of_update", "summary_of_update", "company_view", "level_of_authority",
        "status_of_change", "announcement_date", "effective_date_of_change", "supporting_reference", "regulator", "what_it_does",
    )


# --- failures inside a scan --------------------------------------------------------------------

REFUSED = THEMES[1][2]  # the group whose documents the predictor refuses


def refusing_predictor(docs: pd.DataFrame) -> pd.DataFrame:
    """The heuristic verdicts; documents of one group raise, which nothing expects."""
    if (docs["group_name"] == ", ".join(REFUSED)).any():
        raise ValueError("refused")
    texts, sites = docs["cleaned_text"].fillna("").str.lower(), docs["url"].str.lower().str.contains(r"\.com|\.net")
    mentions = [any(k.lower() in text for k in keywords) for text, keywords in zip(texts, docs["keywords"])]
    return pd.DataFrame({
        "verdict": ["NotRelevant" if not m else "Relevant" if s else "Borderline" for m, s in zip(mentions, sites)],
        "date_confidence": ["Unknown"] * len(docs),
    })


def failing_searches(queries: DataFrame) -> DataFrame:
    """The search of the words that occur nowhere times out in some runs."""
    return queries.where((F.col("group_ord") == 3) & F.col("run_id").rlike("[0-4]$")).select(*PASS, F.lit("timeout").alias("reason"))


def failing_records(items: DataFrame) -> DataFrame:
    """Record answers; those of one group in some runs have a status that does not fall back, others one that does."""
    status = F.when((F.col("group_name") == ", ".join(THEMES[2][2])) & F.col("run_id").rlike("[0-2]$"), 400).when(F.col("run_id").rlike("[7-9]$"), 503)
    return domain_records(items).join(items.select(*GROUP, "id", status.alias("error_status")), [*GROUP, "id"])


def invented_areas(items: DataFrame) -> DataFrame:
    """Area maker: a listed term in another spelling, or one off the vocabulary."""
    return items.select(*GROUP, "id", F.when(F.col("verdict") == "Relevant", "  aND ").otherwise("Invented").alias("impact_area_value"))


def invented_tags(items: DataFrame) -> DataFrame:
    """Tag maker: repeats, other spellings and answers off the vocabulary."""
    return items.select(*GROUP, "id", F.array(F.lit(" OF THE"), F.lit("made up"), F.lit("of the"), F.lit("und")).alias("tag_values"))


@query(
    "full_scan_failures",
    f"""{sql_scan_views("ord = 3 AND regexp_matches(run_id, '[0-4]$')", "ord = 1")},
  faulted AS (SELECT run_id, ord, ord = 1 OR ord = 2 AND regexp_matches(run_id, '[0-2]$') AND count(url) > 0 AS f FROM grp LEFT JOIN items USING (run_id, ord) GROUP BY 1, 2),
  kept AS (SELECT items.* FROM items JOIN faulted USING (run_id, ord) WHERE NOT f)
  SELECT run_id, CAST(ord AS INTEGER) AS group_ord,
    CASE WHEN any_value(f) OR ord = 3 AND regexp_matches(run_id, '[0-4]$') AND count(url) = 0 THEN 'Failed' ELSE 'Completed' END AS status,
    CAST(any_value(loops.n) AS INTEGER) AS loop_count, CAST(count(url) AS INTEGER) AS n_items,
    CAST(count(*) FILTER (verdict = 'Relevant') AS INTEGER) AS n_and, CAST(count(*) FILTER (NOT regexp_matches(run_id, '[7-9]$') AND url IS NOT NULL) AS INTEGER) AS n_judged,
    CASE WHEN count(url) > 0 THEN 'of the|Und' END AS tags
  FROM grp JOIN loops USING (run_id, ord) JOIN faulted USING (run_id, ord) LEFT JOIN kept USING (run_id, ord) GROUP BY run_id, ord""",
)
def full_scan_failures(t):
    """A scan with a refusing predictor, failing searches and failing record answers: each fails its own groups only.

    Labels come from makers, whose answers off the vocabulary are dropped.
    """
    root = stage_dir(t.spark, "scan")
    corpus = staged(page_corpus(t.spread("pages", "url", "html")), f"{root}/corpus")
    scan = run_scan(scan_requests(t), corpus, root, scorer=predictor_scorer(refusing_predictor), search_failures=failing_searches)
    results, records = finalize(
        scan, label_vocabulary(t), record_maker=failing_records, area_maker=invented_areas, tag_maker=invented_tags)
    counts = records.groupBy(*GROUP).agg(
        F.count("*").cast("int").alias("n_items"), F.count_if(F.col("impact_area") == "And").cast("int").alias("n_and"),
        F.count("title_of_update").cast("int").alias("n_judged"), F.max(F.array_join("tags", "|")).alias("tags"))
    return results.join(counts, GROUP, "left").fillna(0, ["n_items", "n_and", "n_judged"]).select(
        "run_id", "group_ord", "status", "loop_count", "n_items", "n_and", "n_judged", "tags")
