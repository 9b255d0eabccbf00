import datetime as dt

from pyspark.sql import functions as F

from farsight.operators import labels as L
from farsight.operators import metrics as M
from farsight.operators import records as R
from farsight.plans.makers import heuristic_verdict, phrase_labels, theme_terms
from farsight.sources import priors as P
from farsight.sources import vocabulary as C

CSV = '''Jurisdiction,Impact Area,Tags,Title of Update,Summary of Update,Company View,Level of Authority,Status of Change,Announcement date,Effective Date of Change,Supporting reference,Regulator
Where it applies,Area,List,Title,Summary,,Level,Status,When,When,Link,Who
United Kingdom, Rates ,"NIC, PAYE , nic",One,"A summary, with commas","First line
second ""quoted"" line",Legislation,New,1 May,6 April 2026,https://x,HMRC
united kingdom,Rates,,Two,s,View two,,,,,,
 ,Rates,,Three,s,View three,,,,,,
France,Rates,,Four,s, View four ,,,,,,
'''


def test_prior_csv(spark, tmp_path):
    path = tmp_path / "priors.csv"
    path.write_text(CSV)
    priors = P.read_priors(spark, str(path))
    rows = priors.orderBy("file_pos").collect()
    assert [r.title_of_update for r in rows] == ["One", "Two", "Four"]
    assert rows[0].tags == ["NIC", "PAYE"] and rows[0].company_view == 'First line\nsecond "quoted" line' and rows[0].impact_area == "Rates"
    assert rows[2].company_view == "View four"
    groups = spark.createDataFrame([("g1", " UNITED KINGDOM"), ("g2", "Spain")], "g string, jurisdiction string")
    got = {r.g: (r.n_exemplars, r.exemplars) for r in L.attach_exemplars(groups, priors, k=1).collect()}
    assert got["g2"] == (0, None) and got["g1"][0] == 1 and got["g1"][1][0].title_of_update == "One"
    assert {r.jurisdiction: r.n_records for r in P.prior_counts(priors).collect()} == {"united kingdom": 2, "france": 1, None: 3}

    out = str(tmp_path / "out")
    P.write_csv(priors, out)
    again = P.read_priors(spark, out).drop("file_pos").collect()
    assert sorted(again) == sorted(priors.drop("file_pos").collect())


def test_missing_csv_and_columns(spark, tmp_path):
    assert P.read_priors(spark, None).count() == 0
    assert P.read_priors(spark, str(tmp_path / "none.csv")).count() == 0
    path = tmp_path / "short.csv"
    path.write_text("Company View,Jurisdiction\nv,UK\n")
    row = P.read_priors(spark, str(path)).head()
    assert (row.jurisdiction, row.company_view, row.regulator, row.tags) == ("UK", "v", None, [])


def test_vocabulary_seed_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "vocab")
    C.seed_vocabulary(C.builtin_vocabulary(spark), path)
    C.seed_vocabulary(C.builtin_vocabulary(spark), path)
    assert spark.read.parquet(path).count() == 41
    tags = C.read_vocabulary(spark, path, C.TAG_TYPE)
    plan = tags._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(doc_type" in plan
    assert tags.count() == 30 and C.read_vocabulary(spark, path, C.IMPACT_AREA_TYPE).count() == 11


def test_labels_use_canonical_spelling(spark):
    names = [("Harbour Dues",), (" Tide Tables ",), ("harbour dues\t",), ("\n",), (None,)]
    terms = C.vocabulary_terms(C.vocabulary_rows(spark.createDataFrame(names, "name string"), "tags"), "tags")
    rows = [(1, ["TIDE tables", "no such term", " harbour dues", "Harbour Dues"], "\tHARBOUR DUES "), (2, [], "y"), (3, None, None)]
    items = spark.createDataFrame(rows, "id int, v array<string>, one string")
    multi = {r.id: r.tags for r in L.multi_label(items, terms, ["id"], "v").collect()}
    assert multi == {1: ["Tide Tables", "Harbour Dues"], 2: [], 3: []}
    assert {r.id: r.impact_area for r in L.single_label(items, terms, "one").collect()} == {1: "Harbour Dues", 2: None, 3: None}
    empty = terms.limit(0)
    assert {r.impact_area for r in L.single_label(items, empty, "one").collect()} == {None}
    assert {tuple(r.tags) for r in L.multi_label(items, empty, ["id"], "v").collect()} == {()}


def test_phrase_labels(spark):
    texts = spark.createDataFrame([(1, "Changes to NATIONAL  insurance, and IR35."), (2, "nationalist insurance")], "id int, t string")
    terms = spark.createDataFrame([("National Insurance",), ("IR35",), ("Insurance",)], "name string")
    got = [(r.id, r.name) for r in phrase_labels(texts, ["id"], "t", terms).orderBy("id", "at").collect()]
    assert got == [(1, "National Insurance"), (1, "Insurance"), (1, "IR35"), (2, "Insurance")]


def test_records(spark):
    items = spark.createDataFrame([(1, "UK", " Rates ", ["t"], ["https://a", "", "HTTPS://A", "https://b"], dt.date(2025, 6, 15), None), (2, "UK", " ", [], [], None, dt.date(2026, 4, 6))],
                                  "id int, jurisdiction string, impact_area string, tags array<string>, source_urls array<string>, publication_date date, effective_date date")
    base = R.base_records(items)
    judged = R.parse_records(spark.createDataFrame([(1, '{"titleOfUpdate":" T ","regulator":"  "}'), (2, "broken")], "id int, payload string"))
    rows = {r.id: r for r in R.overlay(base, judged, ["id"]).collect()}
    assert (rows[1].impact_area, rows[1].supporting_reference, rows[1].announcement_date, rows[1].effective_date_of_change) == ("Rates", "https://a | https://b", "2025-06-15", None)
    assert (rows[1].title_of_update, rows[1].regulator) == ("T", None)
    assert (rows[2].impact_area, rows[2].supporting_reference, rows[2].effective_date_of_change, rows[2].title_of_update) == (None, None, "2026-04-06", None)
    assert R.overlay(base, None, ["id"]).where("company_view is not null").count() == 0
    assert {r.what_it_does for r in R.enrich(items).collect()} == {None}
    assert {r.what_it_does for r in R.enrich(items, F.upper("jurisdiction")).collect()} == {"UK"}


# Own items: class by class, which site and whether the text names the theme.
TIDES = ["tide gauge", "harbour"]
ITEMS = [
    ("https://port.gov.uk/notices/41", "A new TIDE GAUGE stands at the pier.", "Relevant"),
    ("https://charts.gov.uk/north", "The harbour is closed at night.", "Relevant"),
    ("https://sailing-diary.example/june", "We left the harbour at dawn.", "Borderline"),
    ("https://gauges.example/shop", "One tide gauge left in stock", "Borderline"),
    ("https://port.gov.uk/jobs", "We look for two clerks.", "NotRelevant"),
    ("https://bakery.example", "Rye bread on Mondays.", "NotRelevant"),
    ("https://empty.gov.uk", None, "NotRelevant"),
]


def test_heuristic_recalls_every_carried_item(spark):
    items = spark.createDataFrame(ITEMS, "url string, cleaned_text string, expected string")
    terms = F.array(*[F.lit(t) for t in TIDES])
    predicted = items.withColumn("predicted", heuristic_verdict(F.col("url"), F.col("cleaned_text"), terms))
    assert predicted.where("predicted != expected").count() == 0
    report = M.recall_report(predicted).head()
    assert (report.total, report.carried_expected, report.carried_recall, report.relevant_recall) == (7, 4, 1.0, 1.0)
    half = predicted.withColumn("predicted", F.when(F.col("url").contains("example"), "NotRelevant").otherwise(F.col("predicted")))
    report = M.recall_report(half).head()
    assert (report.carried_recall, report.relevant_recall) == (0.5, 1.0)
    nothing = M.recall_report(items.withColumn("predicted", F.lit("NotRelevant"))).head()
    assert (nothing.carried_recall, nothing.relevant_recall) == (0.0, 0.0)
    none = M.recall_report(items.where("expected = 'NotRelevant'").withColumn("predicted", F.lit("Relevant"))).head()
    assert (none.carried_recall, none.relevant_recall) == (1.0, 1.0)


def test_a_theme_stands_for_itself_or_its_listed_terms(spark):
    df = spark.createDataFrame([("Tides",), ("boats",)], "theme string")
    got = [r.t for r in df.select(theme_terms(F.col("theme"), {"tides": TIDES}).alias("t")).collect()]
    assert got == [TIDES, ["boats"]]


def test_mistyped_label_and_record_answers_are_unreadable(spark):
    rows = [(1, '{"impactArea":7}', '{"tags":"IR35"}', '{"titleOfUpdate":5}'), (2, '{"impactArea":"A"}', '{"tags":["IR35"]}', '{"titleOfUpdate":"T","regulator":null}'),
            (3, '{"impactArea":["A"]}', '{"tags":[1]}', '["T"]')]
    answers = spark.createDataFrame(rows, "id int, area string, tag string, payload string")
    got = {r.id: (r.impact_area_value, r.tag_values) for r in R.parse_labels(answers, "area", "tag").collect()}
    assert got == {1: (None, []), 2: ("A", ["IR35"]), 3: (None, [])}
    assert [(r.id, r.title_of_update) for r in R.parse_records(answers.select("id", "payload")).collect()] == [(2, "T")]
