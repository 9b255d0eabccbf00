from pyspark.sql import functions as F

from farsight.operators import hits as X
from farsight.schemas import ALLOWLIST, DOMAIN_RULES, HITS
from farsight.sources.citations import citations, parse_answers


def hits(spark, rows):
    """rows: run, group, group_ord, pass, rank, url"""
    return spark.createDataFrame([(*r, None, None, "q") for r in rows], HITS)


def brute_force(rows):
    """Sequential reading of the dedupe rules; returns kept rows and outcome counts."""
    from collections import Counter

    def key(url):
        if not url.startswith("http"):
            return None
        return url.split("://")[1].removeprefix("www.").rstrip("/").lower()

    group_seen, run_seen, kept, counts = set(), set(), [], Counter()
    for row in sorted(rows, key=lambda r: (r[3], r[2], r[4])):
        run, group, _, number, _, url = row
        k, where = key(url), (run, group, number)
        counts[where, "n_in"] += 1
        if k is None:
            counts[where, "invalid"] += 1
        elif (run, group, k) in group_seen:
            counts[where, "dupe_group"] += 1
        else:
            group_seen.add((run, group, k))
            if (run, k) in run_seen:
                counts[where, "dupe_cross_group"] += 1
            else:
                run_seen.add((run, k))
                counts[where, "kept"] += 1
                kept.append(row)
    return kept, counts


ROWS = [
    ("r1", "g1", 0, 1, 1, "https://gov.uk/a"), ("r1", "g1", 0, 1, 2, "https://www.gov.uk/a/"), ("r1", "g1", 0, 1, 3, "mailto:x@y"),
    ("r1", "g1", 0, 2, 1, "https://gov.uk/a"), ("r1", "g1", 0, 2, 2, "https://gov.uk/b"), ("r1", "g2", 1, 1, 1, "https://gov.uk/a"),
    ("r1", "g2", 1, 1, 2, "https://gov.uk/b"), ("r1", "g2", 1, 2, 1, "https://gov.uk/a"), ("r2", "g1", 0, 1, 1, "https://gov.uk/a"),
]


def test_prefilter_equals_sequential_reading(spark):
    # one key holds most rows
    rows = ROWS + [("r3", f"g{i % 5}", i % 5, 1 + i // 50, i, "https://hot.example/x" if i % 3 else f"https://h{i % 7}.example/") for i in range(150)]
    kept, counts = brute_force(rows)
    table = hits(spark, rows).repartition(7)
    got = X.prefilter(table).select("run_id", "group_id", "group_ord", "pass", "rank", "url").collect()
    assert sorted(map(tuple, got)) == sorted(kept)
    for r in X.prefilter_counts(table).collect():
        where = (r.run_id, r.group_id, r["pass"])
        for name in ("n_in", "kept", "invalid", "dupe_group", "dupe_cross_group"):
            assert r[name] == counts[where, name], (where, name)


def test_prefilter_again_keeps_nothing_new(spark):
    table = hits(spark, ROWS)
    seen = X.new_group_keys(table)
    assert X.prefilter(table, seen, seen).count() == 0
    assert X.seen_keys(seen, seen).count() == seen.count()


def test_counts_with_earlier_keys(spark):
    _, counts = brute_force(ROWS)
    table = hits(spark, ROWS)
    seen = X.new_group_keys(table.where("pass = 1"))
    for r in X.prefilter_counts(table.where("pass = 2"), seen, seen).collect():
        where = (r.run_id, r.group_id, 2)
        assert [r[n] for n in ("n_in", "kept", "dupe_group", "dupe_cross_group")] == [counts[where, n] for n in ("n_in", "kept", "dupe_group", "dupe_cross_group")]


def test_a_key_lost_to_another_group_counts_as_seen(spark):
    keys = {(r.group_id, r.url_key) for r in X.new_group_keys(hits(spark, ROWS)).where("run_id = 'r1'").collect()}
    assert ("g2", "gov.uk/a") in keys


def test_allowlist(spark):
    table = hits(spark, [("r1", "g", 0, 1, 1, "https://www.gov.uk/a"), ("r1", "g", 0, 1, 2, "https://evil.example.com/b"),
                         ("r1", "g", 0, 1, 3, "https://sub.gov.uk/a"), ("r2", "g", 0, 1, 1, "https://evil.example.com/b"),
                         ("r3", "g", 0, 1, 1, "https://gov.uk/hm-revenue-customs/x")])
    entries = spark.createDataFrame([("r1", "www.gov.uk"), ("r1", " "), ("r3", "gov.uk/hm-revenue-customs")], ALLOWLIST)
    got = [(r.run_id, r.url) for r in X.allowed(table, entries).collect()]
    assert sorted(got) == [("r1", "https://www.gov.uk/a"), ("r2", "https://evil.example.com/b")]


def test_ranks_and_off_list_counter(spark):
    urls = ["https://a.uk/1", "https://b.com/x", "HTTPS://A.uk/1", "ftp://a.uk/2", "https://a.uk/2", "https://c.com/y", "https://a.uk/3", "https://d.com/z"]
    table = spark.createDataFrame([("r", i, u) for i, u in enumerate(urls)], "run_id string, pos int, url string")
    entries = spark.createDataFrame([("r", "a.uk")], ALLOWLIST)
    ranked = X.rank_citations(table, ["run_id"], entries, k=2).orderBy("rank").collect()
    assert [(r.rank, r.url, r.domain) for r in ranked] == [(1, "https://a.uk/1", "a.uk"), (2, "https://a.uk/2", "a.uk")]
    # reading stops at the second hit, so only b.com was counted
    assert X.off_allowlist_counts(table, ["run_id"], entries, k=2).head().off_allowlist == 1
    assert X.off_allowlist_counts(table, ["run_id"], entries, k=10).head().off_allowlist == 3


def test_domain_rules(spark):
    rules = spark.createDataFrame(
        [("allowed", "https://www.gov.uk", True, "Elevated"), ("allowed", "supremecourt.uk/cases", False, None), ("allowed", "x.uk/a", True, "demoted"),
         ("blocked", "gov.uk/search", True, None), ("allowed", " ", True, None), ("allowed", "y.uk", None, None), ("allowed", "y.uk", True, "Huge"),
         ("allowed", "y.uk", False, "Elevated")], DOMAIN_RULES)
    issues = X.domain_rule_issues(rules).where(F.size("issues") > 0)
    assert issues.count() == 4
    urls = ["https://gov.uk/tax", "https://gov.uk/search?q=1", "https://gov.uk/search/all", "https://gov.uk/searching", "https://supremecourt.uk/cases/",
            "https://supremecourt.uk/cases/1", "https://x.uk/a/b", "https://x.uk/ab", "https://y.uk/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = {r.url: r.boost for r in X.apply_domain_rules(pages, rules, "id").collect()}
    assert got == {"https://gov.uk/tax": 1, "https://gov.uk/searching": 1, "https://supremecourt.uk/cases/": 0, "https://x.uk/a/b": -1}
    only_blocked = rules.where("list = 'blocked'")
    assert X.apply_domain_rules(pages, only_blocked, "id").count() == len(urls) - 2


def test_citations_need_a_url(spark):
    payload = '[{"contents":[{"annotations":[{"url":"https://a","title":"A"},{"title":"none"}]},{"annotations":[{"url":"https://b"}]}]}]'
    got = citations(parse_answers(spark.createDataFrame([(1, payload), (2, "[]"), (3, "broken")], "id int, payload string")), ["id"]).collect()
    assert [(r.id, r.content_pos, r.annotation_pos, r.url, r.title) for r in got] == [(1, 0, 0, "https://a", "A"), (1, 1, 0, "https://b", None)]
