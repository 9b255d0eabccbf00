"""URL, allowlist, domain-rule, dedupe and search queries over ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.urls import is_absolute_http, normalize_host, stable_id, url_host, url_key
from farsight.operators import hits as X
from farsight.session import local_table
from farsight.sources.citations import citations, parse_answers
from farsight.sources.corpus import search, tokens
from workload.registry import (
    SQL_PAGE_RUN, SQL_THEMES, THEMES, Tables, page_run, query, sql_host, sql_is_http,
    sql_norm_host, sql_stable_id, sql_url_key, theme_keywords,
)

# Written forms of a page URL: as is, other scheme/case/slash/fragment, tracked, invalid.
FORMS = {
    "plain": F.col,
    "upper": lambda u: F.upper(u),
    "padded": lambda u: F.concat(F.lit("  "), F.col(u), F.lit(" ")),
    "tracked": lambda u: F.concat(
        F.split_part(u, F.lit("#"), F.lit(1)),
        F.when(F.col(u).contains("?"), F.lit("&")).otherwise(F.lit("?")),
        F.lit("utm_source=x&b=2&a=1&gclid=7#top"),
    ),
    "mail": lambda u: F.concat(F.lit("mailto:"), F.col(u)),
    "ftp": lambda u: F.regexp_replace(u, "^https?", "ftp"),
    "relative": lambda u: F.regexp_replace(u, "^https?://[^/]+", ""),
}
SQL_FORMS = """(
  SELECT page_id, form, CASE form
    WHEN 'plain' THEN url WHEN 'upper' THEN upper(url) WHEN 'padded' THEN '  ' || url || ' '
    WHEN 'tracked' THEN split_part(url, '#', 1)
      || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x&b=2&a=1&gclid=7#top'
    WHEN 'mail' THEN 'mailto:' || url
    WHEN 'ftp' THEN regexp_replace(url, '^https?', 'ftp')
    ELSE regexp_replace(url, '^https?://[^/]+', '') END AS url
  FROM pages, (VALUES ('plain'), ('upper'), ('padded'), ('tracked'), ('mail'), ('ftp'), ('relative')) f(form))"""


def url_forms(t: Tables) -> DataFrame:
    forms = F.array(*[
        F.struct(F.lit(n).alias("form"), f("url").alias("url")) for n, f in FORMS.items()
    ])
    return t.pages.select("page_id", F.explode(forms).alias("f")).select("page_id", "f.form", "f.url")


@query("url_canonical_key", f"SELECT page_id, form, {sql_url_key('url')} AS url_key FROM {SQL_FORMS}")
def url_canonical_key(t):
    return url_forms(t).select("page_id", "form", url_key(F.col("url")).alias("url_key"))


@query("stable_id", f"SELECT page_id, form, {sql_stable_id('url')} AS id FROM {SQL_FORMS}")
def stable_ids(t):
    return url_forms(t).select("page_id", "form", stable_id(F.col("url")).alias("id"))


@query("http_filter", f"SELECT page_id, form, url FROM {SQL_FORMS} WHERE {sql_is_http('url')}")
def http_filter(t):
    return url_forms(t).where(is_absolute_http(F.col("url")))


@query(
    "host_normalize",
    f"SELECT {sql_norm_host('url')} AS host, count(*) AS n_pages FROM pages GROUP BY 1",
)
def host_normalize(t):
    return t.pages.groupBy(normalize_host(url_host(F.col("url"))).alias("host")).agg(
        F.count("*").alias("n_pages")
    )


# --- allowlist: the English run lists its .net hosts as URLs, the French one .com hosts bare


def page_hits(t: Tables) -> DataFrame:
    return t.pages.select(page_run().alias("run_id"), "page_id", "url")


def page_allowlist(t: Tables) -> DataFrame:
    hosts = t.pages.select(page_run().alias("run_id"), url_host(F.col("url")).alias("h")).distinct()
    entry = F.when(
        (F.col("run_id") == "en") & F.col("h").endswith(".net"), F.concat(F.lit("https://"), "h", F.lit("/x"))
    ).when((F.col("run_id") == "fr") & F.col("h").endswith(".com"), F.concat(F.lit(" "), "h", F.lit("/")))
    # The German run has only blank entries, so it filters nothing.
    return hosts.select("run_id", F.when(F.col("run_id") == "de", F.lit("  ")).otherwise(entry).alias("entry"))


SQL_MARKED = f"""
  h AS (SELECT {SQL_PAGE_RUN} AS run_id, page_id, url, {sql_host('url')} AS raw_host,
               {sql_norm_host('url')} AS host FROM pages),
  a AS (SELECT DISTINCT run_id, host FROM h
        WHERE (run_id = 'en' AND raw_host LIKE '%.net') OR (run_id = 'fr' AND raw_host LIKE '%.com')),
  m AS (SELECT h.*, run_id NOT IN (SELECT run_id FROM a)
               OR (run_id, host) IN (SELECT (run_id, host) FROM a) AS allowed FROM h)"""


@query("allowlist_semi", f"WITH {SQL_MARKED} SELECT run_id, page_id, url FROM m WHERE allowed")
def allowlist_semi(t):
    return X.allowed(page_hits(t), page_allowlist(t)).select("run_id", "page_id", "url")


@query(
    "off_allowlist_counts",
    f"""WITH {SQL_MARKED},
  k AS (SELECT run_id, page_id, row_number() OVER (PARTITION BY run_id ORDER BY page_id) rn
        FROM (SELECT run_id, lower(url) u, min(page_id) page_id FROM m WHERE allowed GROUP BY 1, 2))
  SELECT run_id, count(*) AS off_allowlist FROM m
  WHERE NOT allowed AND page_id < coalesce((SELECT page_id FROM k WHERE rn = 10 AND k.run_id = m.run_id), 1e18)
  GROUP BY 1""",
)
def off_allowlist_counts(t):
    return X.off_allowlist_counts(page_hits(t), ["run_id"], page_allowlist(t), position="page_id")


@query(
    "search_rank_topk",
    f"""WITH {SQL_MARKED},
  d AS (SELECT run_id, lower(url) u, min(page_id) page_id FROM m WHERE allowed GROUP BY 1, 2),
  r AS (SELECT run_id, page_id, row_number() OVER (PARTITION BY run_id ORDER BY page_id) AS rank FROM d)
  SELECT run_id, r.page_id, r.rank, {sql_host('url')} AS domain
  FROM r JOIN pages USING (page_id) WHERE rank <= 10""",
)
def search_rank_topk(t):
    return X.rank_citations(page_hits(t), ["run_id"], page_allowlist(t), position="page_id").select(
        "run_id", "page_id", "rank", "domain"
    )


# --- domain rules: one per host, its kind given by the host's first label


def page_rules(t: Tables) -> DataFrame:
    h = url_host(F.col("url"))
    hosts = t.pages.select(h.alias("h")).distinct()
    blog, www, mobile = (F.col("h").startswith(p) for p in ("blog.", "www.", "m."))
    return hosts.select(
        F.when(blog, "blocked").otherwise("allowed").alias("list"),
        F.when(blog, F.concat("h", F.lit("/en"))).otherwise(F.concat(F.lit("https://"), "h")).alias("domain"),
        F.when(F.col("h").endswith(".org"), F.lit(None)).otherwise(~mobile).alias("include_sub_pages"),
        F.when(www, "Elevated").when(mobile, " demoted ").when(F.length("h") % 5 == 0, "high").alias("boost_level"),
    )


SQL_RULES = f"""
  hosts AS (SELECT DISTINCT {sql_host('url')} AS h FROM pages),
  rules AS (SELECT CASE WHEN h LIKE 'blog.%' THEN 'blocked' ELSE 'allowed' END AS list,
    h LIKE 'blog.%' AS blocked, CASE WHEN h LIKE '%.org' THEN NULL ELSE h NOT LIKE 'm.%' END AS sub,
    CASE WHEN h LIKE 'www.%' THEN 'elevated' WHEN h LIKE 'm.%' THEN 'demoted'
         WHEN length(h) % 5 = 0 THEN 'high' END AS boost,
    CASE WHEN h LIKE 'blog.%' THEN h || '/en' ELSE regexp_replace(h, '^www\\.', '') END AS prefix FROM hosts),
  issues AS (SELECT list, unnest(list_filter([
      CASE WHEN sub IS NULL THEN 'include_sub_pages must be set to true or false' END,
      CASE WHEN boost = 'high' THEN 'invalid boost_level; allowed: Default, Elevated, Demoted' END,
      CASE WHEN boost IS NOT NULL AND NOT sub THEN 'boost_level is set but include_sub_pages is false' END
    ], lambda x: x IS NOT NULL)) AS issue FROM rules)"""


@query(
    "domain_rule_issues",
    f"WITH {SQL_RULES} SELECT list, issue, count(*) AS n FROM issues GROUP BY 1, 2",
)
def domain_rule_issues(t):
    return (
        X.domain_rule_issues(page_rules(t)).select("list", F.explode("issues").alias("issue"))
        .groupBy("list", "issue").agg(F.count("*").alias("n"))
    )


@query(
    "domain_rules",
    f"""WITH {SQL_RULES},
  ok AS (SELECT * FROM rules WHERE sub IS NOT NULL AND coalesce(boost, '') <> 'high'
         AND NOT (boost IS NOT NULL AND NOT sub)),
  p AS (SELECT page_id, rtrim({sql_url_key('url')}, '/') AS k FROM pages),
  j AS (SELECT page_id, blocked, boost FROM p JOIN ok
        ON k = prefix OR (sub AND (starts_with(k, prefix || '/') OR starts_with(k, prefix || '?'))))
  SELECT page_id, max(CASE WHEN boost = 'elevated' THEN 1 ELSE 0 END) AS boost FROM j
  GROUP BY page_id HAVING NOT bool_or(blocked)""",
)
def domain_rules(t):
    return X.apply_domain_rules(t.pages.select("page_id", "url"), page_rules(t), "page_id").select(
        "page_id", "boost"
    )


# --- dedupe: a page is a hit of every (group, pass) whose term it holds


def theme_hits(t: Tables) -> DataFrame:
    words = t.spread("pages", "page_id", "url", "html").select(
        page_run().alias("run_id"), F.col("page_id").cast("int").alias("rank"), "url",
        F.array_distinct(tokens(F.col("html"))).alias("terms"),
    ).select("run_id", "rank", "url", F.explode("terms").alias("term"))
    return words.join(theme_keywords(t.spark), "term").select(
        "run_id", "group_id", "group_ord", "pass", "rank", "url"
    )


SQL_HITS = f"""
  w AS (SELECT page_id, url, {SQL_PAGE_RUN} AS run_id,
          unnest(list_distinct(string_split_regex(lower(html), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM pages),
  hits AS (SELECT run_id, group_id, group_ord, pass, page_id AS rank, url, {sql_url_key('url')} AS url_key
           FROM w JOIN {SQL_THEMES} v USING (term))"""
SQL_KEPT = f"""{SQL_HITS},
  g AS (SELECT *, row_number() OVER (PARTITION BY run_id, group_id, url_key ORDER BY pass, rank) AS gn
        FROM hits WHERE url_key IS NOT NULL),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (
             PARTITION BY run_id, url_key ORDER BY pass, group_ord, rank) AS rn FROM g WHERE gn = 1) WHERE rn = 1)"""


@query(
    "prefilter_dedupe",
    f"""WITH {SQL_KEPT} SELECT run_id, group_id, CAST(group_ord AS INTEGER) AS group_ord,
  CAST(pass AS INTEGER) AS pass, CAST(rank AS INTEGER) AS rank, url, url_key FROM kept""",
)
def prefilter_dedupe(t):
    return X.prefilter(theme_hits(t)).select(
        "run_id", "group_id", "group_ord", "pass", "rank", "url", "url_key"
    )


def spoiled_hits(t: Tables) -> DataFrame:
    """Theme hits whose pass-3 URLs are written as mail addresses (invalid)."""
    bad = F.when(F.col("pass") == 3, F.concat(F.lit("mailto:"), "url")).otherwise(F.col("url"))
    return theme_hits(t).withColumn("url", bad)


@query(
    "prefilter_counters",
    f"""WITH {SQL_HITS.replace('hits AS', 'raw AS')},
  hits AS (SELECT * REPLACE (CASE WHEN pass = 3 THEN NULL ELSE url_key END AS url_key) FROM raw),
  g AS (SELECT *, row_number() OVER (PARTITION BY run_id, group_id, url_key ORDER BY pass, rank) AS gn FROM hits),
  k AS (SELECT *, row_number() OVER (PARTITION BY run_id, url_key ORDER BY pass, group_ord, rank) AS rn
        FROM g WHERE gn = 1 AND url_key IS NOT NULL)
  SELECT g.run_id, g.group_id, CAST(g.pass AS INTEGER) AS pass, count(*) AS n_in,
    count(*) FILTER (k.rn = 1) AS kept, count(*) FILTER (g.url_key IS NULL) AS invalid,
    count(*) FILTER (g.url_key IS NOT NULL AND g.gn > 1) AS dupe_group,
    count(*) FILTER (k.rn > 1) AS dupe_cross_group
  FROM g LEFT JOIN k USING (run_id, group_id, pass, rank) GROUP BY 1, 2, 3""",
)
def prefilter_counters(t):
    return X.prefilter_counts(spoiled_hits(t))


@query(
    "seen_key_anti",
    f"""WITH {SQL_HITS},
  seen AS (SELECT DISTINCT run_id, url_key FROM hits WHERE pass = 1),
  rest AS (SELECT * FROM hits WHERE pass > 1 AND url_key IS NOT NULL
           AND (run_id, url_key) NOT IN (SELECT (run_id, url_key) FROM seen)),
  kept AS (SELECT *, row_number() OVER (PARTITION BY run_id, url_key ORDER BY pass, group_ord, rank) rn FROM rest)
  SELECT run_id, group_id, CAST(pass AS INTEGER) AS pass, url_key FROM kept WHERE rn = 1""",
)
def seen_key_anti(t):
    hits = theme_hits(t)
    seen = X.new_group_keys(hits.where(F.col("pass") == 1))
    later = hits.where(F.col("pass") > 1)
    return X.prefilter(later, seen, seen).select("run_id", "group_id", "pass", "url_key")


@query(
    "seen_key_union",
    f"""WITH {SQL_HITS} SELECT run_id, group_id, url_key, CAST(min(pass) AS INTEGER) AS pass
  FROM hits WHERE url_key IS NOT NULL GROUP BY 1, 2, 3""",
)
def seen_key_union(t):
    """Keys accumulated pass by pass equal the first pass each group met them in."""
    hits = theme_hits(t)
    keys = X.new_group_keys(hits.where(F.col("pass") == 1))
    for number in (2, 3):
        fresh = X.new_group_keys(hits.where(F.col("pass") == number), keys)
        keys = keys.unionByName(fresh)
    return keys


# --- search -----------------------------------------------------------------------


def theme_queries(t: Tables) -> DataFrame:
    rows = [(g, " ".join(ks)) for g, _, ks in THEMES]
    return local_table(t.spark, rows, "group_id string, query string")


SQL_QUERY_TERMS = "(SELECT DISTINCT group_id, term FROM " + SQL_THEMES + ")"


@query(
    "corpus_search",
    f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents),
  s AS (SELECT group_id, doc_id, count(DISTINCT term) AS matched_terms, count(*) AS matches
        FROM w JOIN {SQL_QUERY_TERMS} q USING (term) GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY matched_terms DESC, matches DESC, doc_id) AS rank FROM s)
  SELECT group_id, doc_id, matched_terms, matches, rank FROM r WHERE rank <= 10""",
)
def corpus_search(t):
    docs = t.spread("documents", "doc_id", "text", "lang")
    return search(docs, "doc_id", "text", theme_queries(t), ["group_id"], near=F.col("lang")).drop("boost")


@query(
    "boosted_search",
    f"""WITH {SQL_RULES},
  ok AS (SELECT * FROM rules WHERE sub AND coalesce(boost, '') <> 'high'),
  p AS (SELECT page_id, rtrim({sql_url_key('url')}, '/') AS k FROM pages),
  j AS (SELECT page_id, blocked, boost FROM p JOIN ok
        ON k = prefix OR starts_with(k, prefix || '/') OR starts_with(k, prefix || '?')),
  b AS (SELECT page_id, max(CASE WHEN boost = 'elevated' THEN 1 ELSE 0 END) AS boost FROM j
        GROUP BY page_id HAVING NOT bool_or(blocked)),
  w AS (SELECT page_id, unnest(string_split_regex(lower(html), '[^\\p{{L}}\\p{{N}}]+')) AS term
        FROM pages WHERE page_id IN (SELECT page_id FROM b)),
  s AS (SELECT group_id, page_id, count(DISTINCT term) AS matched_terms, count(*) AS matches
        FROM w JOIN {SQL_QUERY_TERMS} q USING (term) GROUP BY 1, 2),
  r AS (SELECT s.*, boost, row_number() OVER (PARTITION BY group_id
          ORDER BY boost DESC, matched_terms DESC, matches DESC, page_id) AS rank FROM s JOIN b USING (page_id))
  SELECT group_id, page_id AS doc_id, boost, matched_terms, matches, rank FROM r WHERE rank <= 10""",
)
def boosted_search(t):
    """Search over the pages the domain rules let through, boosted pages first."""
    ruled = X.apply_domain_rules(t.spread("pages", "page_id", "url", "html"), page_rules(t), "page_id")
    boost = ruled.select(F.col("page_id").alias("doc_id"), "boost")
    return search(ruled, "page_id", "html", theme_queries(t), ["group_id"], boost=boost, near=page_run())


# --- citations: the links of a page as the annotations of one answer ---------------


@query(
    "citation_flatten",
    r"""SELECT page_id, CAST(0 AS INTEGER) AS message_pos, CAST(c AS INTEGER) AS content_pos,
    CAST(pos - 1 AS INTEGER) AS annotation_pos, url || links[pos] AS url, links[pos] AS title
  FROM (SELECT page_id, url, c, regexp_extract_all(html, CASE c WHEN 0 THEN 'href="([^"]*)"' ELSE '<title>([^<]*)</title>' END, 1) AS links
        FROM pages, (VALUES (0), (1)) v(c)) x, range(1, len(links) + 1) r(pos)""",
)
def citation_flatten(t):
    def annotations(pattern):
        return F.transform(
            F.regexp_extract_all("html", F.lit(pattern), 1),
            lambda link: F.struct(F.concat("url", link).alias("url"), link.alias("title")),
        )

    contents = F.array(
        F.struct(annotations(r'href="([^"]*)"').alias("annotations")),
        F.struct(annotations("<title>([^<]*)</title>").alias("annotations")),
        # An annotation without a URL is no citation.
        F.struct(F.array(F.struct(F.lit(None).cast("string").alias("url"), F.lit("x").alias("title"))).alias("annotations")),
    )
    answers = t.pages.select("page_id", F.to_json(F.array(F.struct(contents.alias("contents")))).alias("payload"))
    return citations(parse_answers(answers), ["page_id"])
