"""Vocabulary, label, exemplar and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farsight.functions.dates import dates_line
from farsight.functions.text import split_list
from farsight.functions.urls import url_host
from farsight.operators import labels as L
from farsight.operators import records as R
from farsight.operators import verdicts as V
from farsight.plans.makers import phrase_labels, split_failures
from farsight.sources.corpus import tokens
from farsight.sources import priors as P
from farsight.session import stage_dir
from farsight.sources.vocabulary import (
    IMPACT_AREA_TYPE, TAG_TYPE, read_vocabulary, seed_vocabulary, vocabulary_rows, vocabulary_terms,
)
from workload.registry import ORACLES, Tables, query, sql_host, sql_stable_id
from workload.verdicts import SQL_ROUTED, order_items

# --- vocabulary: part names and types, in several spellings ----------------------------


def part_vocabulary(t: Tables) -> DataFrame:
    """Types (as impact areas) and names (as tags), padded or blank in places."""
    size = F.col("p_size")
    spelled = lambda c: (
        F.when(size % 5 == 0, F.upper(c)).when(size % 5 == 1, F.concat(F.lit("  "), c, F.lit("\t")))
        .when(size % 5 == 2, F.lit(" ")).otherwise(F.initcap(c))
    )
    areas = t.part.select(spelled(F.col("p_type")).alias("name"))
    tags = t.part.select(spelled(F.col("p_name")).alias("name"))
    return vocabulary_rows(areas, "ImpactAreas").unionByName(vocabulary_rows(tags, "tags"))


def _sql_spelled(c: str) -> str:
    title = f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return (
        f"CASE p_size % 5 WHEN 0 THEN upper({c}) WHEN 1 THEN '  ' || {c} || chr(9) WHEN 2 THEN ' ' ELSE {title} END"
    )


SQL_VOCABULARY = f"""
  v AS (SELECT 'ImpactAreas' AS doc_type, {_sql_spelled('p_type')} AS name FROM part
        UNION ALL SELECT 'tags', {_sql_spelled('p_name')} FROM part),
  terms AS (SELECT doc_type, lower(trim(name, ' ' || chr(9))) AS key, trim(min(name), ' ' || chr(9)) AS name
            FROM v WHERE trim(name, ' ' || chr(9)) <> '' GROUP BY 1, 2)"""


@query("vocabulary_terms", f"WITH {SQL_VOCABULARY} SELECT doc_type, key, name FROM terms")
def terms(t):
    vocabulary = part_vocabulary(t)
    return (
        vocabulary_terms(vocabulary, "ImpactAreas").withColumn("doc_type", F.lit("ImpactAreas"))
        .unionByName(vocabulary_terms(vocabulary, "tags").withColumn("doc_type", F.lit("tags")))
    )


@query(
    "vocabulary_ids",
    f"""WITH {SQL_VOCABULARY} SELECT DISTINCT doc_type, sha256(doc_type || '|' || lower(trim(name, ' ' || chr(9)))) AS id FROM v""",
)
def vocabulary_ids(t):
    """Ids depend on type and folded name only, so seeding twice makes no new document."""
    vocabulary = part_vocabulary(t)
    return vocabulary.unionByName(vocabulary).select("doc_type", "id").distinct()


# --- labels: lines judged by part attributes --------------------------------------------


@query(
    "single_label",
    f"""WITH {SQL_VOCABULARY} SELECT p_partkey, terms.name AS impact_area FROM part LEFT JOIN terms
    ON doc_type = 'ImpactAreas' AND key = CASE WHEN p_size = 7 THEN 'off list' WHEN p_size = 8 THEN '' ELSE lower(p_type) END""",
)
def single_label(t):
    value = F.when(F.col("p_size") == 7, "off list").when(F.col("p_size") == 8, "  ").otherwise(
        F.concat(F.lit(" "), F.lower("p_type"), F.lit("\n"))
    )
    items = t.part.select("p_partkey", value.alias("value"))
    return L.single_label(items, vocabulary_terms(part_vocabulary(t), "ImpactAreas"), "value").drop("value")


@query(
    "multi_label",
    f"""WITH {SQL_VOCABULARY},
  x AS (SELECT p_partkey, unnest([p_name, 'invented', upper(p_name), p_type]) AS v, unnest([0, 1, 2, 3]) AS pos FROM part),
  m AS (SELECT p_partkey, terms.name, min(pos) AS pos FROM x JOIN terms ON doc_type = 'tags' AND key = lower(v) GROUP BY 1, 2)
  SELECT p_partkey, coalesce(string_agg(m.name, '|' ORDER BY pos), '') AS tags FROM part LEFT JOIN m USING (p_partkey) GROUP BY 1""",
)
def multi_label(t):
    values = F.array(
        F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit("invented"), F.upper("p_name"), F.col("p_type")
    )
    items = t.part.select("p_partkey", values.alias("values"))
    labelled = L.multi_label(items, vocabulary_terms(part_vocabulary(t), "tags"), ["p_partkey"], "values")
    return labelled.select("p_partkey", F.array_join("tags", "|").alias("tags"))


@query(
    "label_json",
    f"""WITH {SQL_VOCABULARY},
  m AS (SELECT p_partkey, terms.name FROM part JOIN terms ON doc_type = 'tags' AND key = lower(p_name) WHERE p_size <> 9)
  SELECT p_partkey, CASE WHEN p_size <> 9 THEN a.name END AS impact_area, coalesce(m.name, '') AS tags
  FROM part LEFT JOIN terms a ON a.doc_type = 'ImpactAreas' AND a.key = lower(p_type) LEFT JOIN m USING (p_partkey)""",
)
def label_json(t):
    """Label answers parsed, checked against the vocabularies and merged onto the items."""
    vocabulary = part_vocabulary(t)
    answers = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") == 9, "no json").otherwise(
            F.when(F.col("p_size") % 3 == 0, F.to_json(F.struct(F.upper("p_type").alias("ImpactArea"), F.lit("why").alias("RATIONALE"))))
            .when(F.col("p_size") % 3 == 1, F.to_json(F.struct(F.upper("p_type").alias("impactArea"), F.struct(F.lit(1).alias("impactArea")).alias("meta"))))
            .otherwise(F.to_json(F.struct(F.upper("p_type").alias("impactArea"), F.lit("why").alias("rationale"))))
        ).alias("area"),
        F.when(F.col("p_size") == 9, "{}").otherwise(
            F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.array("p_name", F.lit("invented")).alias("TAGS"), F.struct(F.lit(7).alias("tags")).alias("seen"))))
            .otherwise(F.to_json(F.struct(F.array("p_name", F.lit("invented")).alias("tags"))))
        ).alias("tag"),
    )
    parsed = R.parse_labels(answers, "area", "tag")
    areas = L.single_label(parsed, vocabulary_terms(vocabulary, "ImpactAreas"), "impact_area_value")
    tags = L.multi_label(parsed, vocabulary_terms(vocabulary, "tags"), ["p_partkey"], "tag_values")
    merged = L.merge_labels(t.part.select("p_partkey"), areas, tags, ["p_partkey"])
    return merged.select("p_partkey", "impact_area", F.array_join("tags", "|").alias("tags"))


SQL_WORDS = r"array_to_string(list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ')"


@query(
    "phrase_labels",
    f"""WITH q AS (SELECT DISTINCT item_id, ' ' || {SQL_WORDS.format(c="text")} || ' ' AS phrase FROM benchmark),
  d AS (SELECT doc_id, ' ' || {SQL_WORDS.format(c='text')} || ' ' AS words FROM documents)
  SELECT doc_id, item_id, CAST(position(phrase IN words) AS INTEGER) AS at FROM d JOIN q ON contains(words, phrase)""",
)
def phrase_label(t):
    """Whole benchmark passages as phrases, found in whole documents."""
    terms_ = t.benchmark.select(F.col("text").alias("name"), "item_id")
    return phrase_labels(t.spread("documents", "doc_id", "text"), ["doc_id"], "text", terms_).select("doc_id", "item_id", "at")


@query(
    "phrase_sentences",
    f"""WITH s AS (SELECT item_id, unnest(string_split(text, '.')) AS name FROM benchmark),
  q AS (SELECT DISTINCT item_id, {SQL_WORDS.format(c="name")} AS phrase FROM s),
  d AS (SELECT doc_id, ' ' || {SQL_WORDS.format(c='text')} || ' ' AS words FROM documents),
  f AS (SELECT doc_id, item_id, position(' ' || phrase || ' ' IN words) AS place FROM d JOIN q ON phrase <> '' AND contains(words, ' ' || phrase || ' '))
  SELECT doc_id, item_id, count(*) AS n, CAST(min(place) AS INTEGER) AS first_at FROM f GROUP BY 1, 2""",
)
def phrase_sentences(t):
    """How many of a passage's distinct sentences, of one word and up, stand in a document, and where the first one is."""
    names = t.benchmark.select("item_id", F.explode(F.split("text", "[.]")).alias("name"))
    phrases = names.select("item_id", F.array_join(tokens(F.col("name")), " ").alias("name")).distinct()
    found = phrase_labels(t.spread("documents", "doc_id", "text"), ["doc_id"], "text", phrases)
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


# --- prior records: customers as records of their nation ---------------------------------


def customer_priors(t: Tables) -> DataFrame:
    """Header-named rows as the CSV scan gives them; some lack a view, jurisdictions vary in case."""
    key = F.col("c_custkey")
    nation = F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))
    raw = t.customer.select(
        F.when(F.col("c_acctbal") > 5000, F.upper(nation)).otherwise(F.concat(nation, F.lit("  "))).alias("Jurisdiction"),
        F.col("c_mktsegment").alias("Impact Area"),
        F.concat_ws(" , ", "c_mktsegment", F.lower("c_mktsegment"), F.lit(""), "c_name").alias("Tags"),
        F.col("c_name").alias("Title of Update"),
        F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.concat(F.lit("View of\n"), "c_name")).alias("Company View"),
        key.alias("file_pos"),
    )
    return P.prior_records(raw)


SQL_PRIORS = """
  pr AS (SELECT c_custkey AS file_pos, CASE WHEN c_acctbal > 5000 THEN 'NATION ' || c_nationkey ELSE 'Nation ' || c_nationkey END AS jurisdiction,
      'nation ' || c_nationkey AS jk, c_mktsegment AS impact_area, c_mktsegment || '|' || c_name AS tags,
      c_name AS title_of_update, 'View of' || chr(10) || c_name AS company_view FROM customer WHERE NOT c_acctbal < 0)"""


@query(
    "prior_records",
    f"WITH {SQL_PRIORS} SELECT file_pos, jurisdiction, impact_area, tags, title_of_update, company_view, CAST(NULL AS VARCHAR) AS regulator FROM pr",
)
def prior_records(t):
    return customer_priors(t).select(
        "file_pos", "jurisdiction", "impact_area", F.array_join("tags", "|").alias("tags"),
        "title_of_update", "company_view", "regulator",
    )


@query("prior_counts", f"WITH {SQL_PRIORS} SELECT jk AS jurisdiction, count(*) AS n_records FROM pr GROUP BY ROLLUP (jk)")
def prior_counts(t):
    return P.prior_counts(customer_priors(t))


@query(
    "exemplars_topk",
    f"""WITH {SQL_PRIORS}, e AS (SELECT *, row_number() OVER (PARTITION BY jk ORDER BY file_pos) AS exemplar_rank FROM pr)
  SELECT n_nationkey, CAST(exemplar_rank AS INTEGER) AS exemplar_rank, title_of_update FROM nation
  JOIN e ON jk = 'nation ' || n_nationkey WHERE exemplar_rank <= 5""",
)
def exemplars_topk(t):
    groups = t.nation.select("n_nationkey", F.concat(F.lit(" NATION "), F.col("n_nationkey").cast("string")).alias("jurisdiction"))
    attached = L.attach_exemplars(groups, customer_priors(t))
    return attached.select("n_nationkey", F.explode("exemplars").alias("e")).select(
        "n_nationkey", "e.exemplar_rank", "e.title_of_update"
    )


@query(
    "csv_export",
    f"""WITH {SQL_PRIORS} SELECT trim(jurisdiction) AS "Jurisdiction", impact_area AS "Impact Area",
    replace(tags, '|', ', ') AS "Tags", title_of_update AS "Title of Update", CAST(NULL AS VARCHAR) AS "Summary of Update",
    company_view AS "Company View", CAST(NULL AS VARCHAR) AS "Level of Authority", CAST(NULL AS VARCHAR) AS "Status of Change",
    CAST(NULL AS VARCHAR) AS "Announcement date", CAST(NULL AS VARCHAR) AS "Effective Date of Change",
    CAST(NULL AS VARCHAR) AS "Supporting reference", CAST(NULL AS VARCHAR) AS "Regulator" FROM pr""",
)
def csv_export(t):
    return P.export_columns(customer_priors(t))


@query("csv_round_trip", ORACLES["csv_export"])
def csv_round_trip(t):
    """The export written as CSV files, read back as prior records and exported again."""
    path = stage_dir(t.spark, "priors-csv")
    P.write_csv(customer_priors(t), path)
    return P.export_columns(P.read_priors(t.spark, path))


@query(
    "vocabulary_seeded_twice",
    """SELECT 'ImpactAreas' AS doc_type, lower(p_type) AS key, p_type AS name FROM part GROUP BY p_type
  UNION ALL SELECT 'tags', lower(w), w FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)""",
)
def vocabulary_seeded_twice(t):
    """Areas and tags of the parts, written twice and read back by type."""
    areas = vocabulary_rows(t.part.select(F.col("p_type").alias("name")), IMPACT_AREA_TYPE)
    tags = vocabulary_rows(t.part.select(F.explode(F.split("p_name", " ")).alias("name")), TAG_TYPE)
    path = stage_dir(t.spark, "vocabulary")
    for _ in range(2):
        seed_vocabulary(areas.unionByName(tags), path)
    read = [read_vocabulary(t.spark, path, kind).select(F.lit(kind).alias("doc_type"), "key", "name") for kind in (IMPACT_AREA_TYPE, TAG_TYPE)]
    return read[0].unionByName(read[1])


@query(
    "tag_split",
    """SELECT c_custkey, c_mktsegment || '|' || c_name AS tags FROM customer""",
)
def tag_split(t):
    written = F.concat_ws(" , ", "c_mktsegment", F.lower("c_mktsegment"), F.lit(" "), "c_name", F.upper("c_name"))
    return t.customer.select("c_custkey", F.array_join(split_list(written), "|").alias("tags"))


# --- records -----------------------------------------------------------------------------


@query("enriched_records", "SELECT o_orderkey, lower(o_orderpriority) AS what_it_does FROM orders")
def enriched_records(t):
    return R.enrich(t.orders, F.lower("o_orderpriority")).select("o_orderkey", "what_it_does")


@query(
    "record_failures",
    """WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, o_orderpriority AS group_id, o_orderkey,
    CASE o_orderkey % 5 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 400 END AS status, o_orderkey % 15 = 3 AS bad FROM orders)
  SELECT run_id, group_id, CAST(count(*) FILTER (status IS NULL AND NOT bad) AS BIGINT) AS usable,
    'status ' || min(status) FILTER (status IN (400, 404) AND NOT bad) AS error FROM a GROUP BY 1, 2""",
)
def record_failures(t):
    """Record answers of each group that can be used, and the status that fails the group."""
    status = F.expr("CASE o_orderkey % 5 WHEN 1 THEN 404 WHEN 2 THEN 503 WHEN 3 THEN 400 END")
    answers = t.orders.select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("group_id"),
        status.alias("error_status"), (F.col("o_orderkey") % 15 == 3).alias("bad_output"),
    )
    usable, failed = split_failures(answers)
    counts = usable.groupBy("run_id", "group_id").agg(F.count("*").alias("usable"))
    groups = answers.select("run_id", "group_id").distinct()
    return groups.join(counts, ["run_id", "group_id"], "left").join(failed, ["run_id", "group_id"], "left").fillna(0, ["usable"])


def judged_orders(t: Tables) -> DataFrame:
    """Routed orders as result items with a page URL."""
    host = F.concat(F.lit("https://www.site"), (F.col("group_id")).cast("string"), F.lit(".example.org/"))
    return order_items(t).select(
        F.lit("run").alias("run_id"), F.col("group_id").cast("string").alias("group_id"), F.lit(2).alias("pass"),
        F.col("o_orderkey").cast("int").alias("doc_index"),
        F.concat(host, F.col("verdict"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("url"),
        "verdict", F.lit("because").alias("rationale"), F.lit(False).alias("unverified"),
        "publication_date", "effective_date", "applies_from", F.lit(None).cast("date").alias("applies_to"),
        "date_confidence", "route", "out_of_window",
    ).withColumn("domain", url_host(F.col("url")))


SQL_ITEM_URL = "'https://www.site' || group_id || '.example.org/' || verdict || '/' || o_orderkey"


@query(
    "result_items",
    f"""WITH {SQL_ROUTED}, u AS (SELECT *, {SQL_ITEM_URL} AS url FROM routed)
  SELECT CAST(group_id AS VARCHAR) AS group_id, {sql_stable_id('url')} AS id, CAST(1 AS INTEGER) AS version,
    CAST(2 AS INTEGER) AS found_on_pass, url AS source_url, {sql_host('url')} AS domain, verdict, route, 'Unknown' AS level_of_authority FROM u""",
)
def result_items(t):
    return V.result_items(judged_orders(t)).select(
        "group_id", "id", "version", "found_on_pass", F.col("source_urls")[0].alias("source_url"), "domain",
        "verdict", "route", "level_of_authority",
    )


@query(
    "base_records",
    f"""WITH {SQL_ROUTED} SELECT CAST(o_orderkey AS INTEGER) AS doc_index, 'UK' AS jurisdiction,
    CASE WHEN verdict = 'Relevant' THEN 'Rates' END AS impact_area, strftime(pub, '%Y-%m-%d') AS announcement_date,
    strftime(eff, '%Y-%m-%d') AS effective_date_of_change, {SQL_ITEM_URL} AS supporting_reference,
    CASE WHEN verdict = 'Relevant' THEN 'T ' || o_orderkey END AS title_of_update
  FROM routed WHERE route = 'vetted'""",
)
def base_records(t):
    """Base records with judged fields laid over the relevant ones' (a blank title is null)."""
    items = V.result_items(judged_orders(t)).where(F.col("route") == "vetted").withColumns({
        "jurisdiction": F.lit("UK"), "tags": F.array(F.lit("x")),
        "impact_area": F.when(F.col("verdict") == "Relevant", " Rates ").otherwise("  "),
    })
    base = R.base_records(items.drop("level_of_authority"))
    title = F.when(F.col("verdict") == "Relevant", F.concat(F.lit(" T "), F.col("doc_index").cast("string"))).otherwise(" ")
    payload = F.to_json(F.struct(title.alias("titleOfUpdate"), F.lit("v").alias("companyView")))
    judged = R.parse_records(base.select("group_id", "doc_index", payload.alias("payload")))
    records = R.overlay(base, judged, ["group_id", "doc_index"])
    return records.select(
        "doc_index", "jurisdiction", "impact_area", "announcement_date", "effective_date_of_change",
        "supporting_reference", "title_of_update",
    )


@query(
    "source_references",
    r"""WITH x AS (SELECT lang, doc_id, unnest([' ', 'http://' || source || '/A', 'HTTP://' || source || '/a', 'http://x/' || lang]) AS url, unnest([0, 1, 2, 3]) AS i FROM documents),
  f AS (SELECT lang, lower(url) AS k, arg_min(url, doc_id * 4 + i) AS url, min(doc_id * 4 + i) AS o FROM x WHERE url <> ' ' GROUP BY 1, 2),
  p AS (SELECT lang, url, o, CAST(o // 4 // 1024 AS INTEGER) AS part FROM f)
  SELECT lang, part, string_agg(url, ' | ' ORDER BY o) AS supporting_reference FROM p GROUP BY 1, 2""",
)
def source_references(t):
    """Distinct references of each language's documents, first spelling and order kept."""
    host = F.col("source")
    urls = F.array(
        F.lit(" "), F.concat(F.lit("http://"), host, F.lit("/A")), F.concat(F.lit("HTTP://"), host, F.lit("/a")),
        F.concat(F.lit("http://x/"), F.col("lang")),
    )
    rows = t.documents.select("lang", "doc_id", urls.alias("source_urls"))
    return R.join_references(R.source_references(rows, ["lang"], "doc_id"), ["lang"])


@query(
    "dates_line",
    f"""WITH {SQL_ROUTED} SELECT o_orderkey, nullif(concat_ws(', ', 'published ' || strftime(pub, '%Y-%m-%d'),
    'effective ' || strftime(eff, '%Y-%m-%d'), 'applies from ' || strftime(app, '%Y-%m-%d')), '') AS dates FROM routed""",
)
def dates_lines(t):
    return order_items(t).select(
        "o_orderkey",
        dates_line(F.col("publication_date"), F.col("effective_date"), F.col("applies_from"), F.lit(None).cast("date")).alias("dates"),
    )


@query(
    "record_overlay",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'base' WHEN p_size > 20 THEN p_name END AS title_of_update,
    CASE WHEN p_size > 40 THEN 'kept' ELSE p_type END AS regulator FROM part""",
)
def record_overlay(t):
    """Answers replace judged fields (blank becomes null); parts above 40 have none and keep theirs."""
    base = t.part.select("p_partkey", F.lit("base").alias("title_of_update"), F.lit("kept").alias("regulator"))
    answers = t.part.where(F.col("p_size") <= 40).select(
        "p_partkey",
        F.to_json(F.struct(
            F.when(F.col("p_size") > 20, F.concat(F.lit("\t"), "p_name")).otherwise(" ").alias("titleOfUpdate"),
            F.concat("p_type", F.lit(" ")).alias("regulator"),
        )).alias("payload"),
    )
    return R.overlay(base, R.parse_records(answers), ["p_partkey"]).select("p_partkey", "title_of_update", "regulator")
