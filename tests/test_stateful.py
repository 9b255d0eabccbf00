"""Streams with state: the final table equals the batch form, and state goes when it may."""

import datetime as dt
import random

from farsight.streaming import stateful as S
from tests.test_streaming import T0, drain, stream_of

HITS = "run_id string, group_id string, group_ord int, pass int, rank int, url string"


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_late_lesser_hits_correct_the_first(spark, tmp_path):
    rocks(spark)
    rng = random.Random(1)
    rows = [("r", f"g{k % 3}", k % 3, rng.randint(1, 3), rng.randint(1, 9), f"https://www.x.uk/{rng.randint(0, 5)}/") for k in range(60)] + [("r", "g", 0, 1, 1, "mailto:x")]
    streamed = S.first_hits(stream_of(spark, tmp_path, "h", [rows[:20], rows[20:40], rows[40:]], HITS))
    last = {}
    for r in sorted(drain(spark, streamed, "first_hits", "update", tmp_path), key=lambda r: r.version):
        last[r.url_key] = (r["pass"], r.group_ord, r["rank"], r.group_id, r.url)
    want = {r.url_key: (r["pass"], r.group_ord, r["rank"], r.group_id, r.url) for r in S.first_hits(spark.createDataFrame(rows, HITS)).collect()}
    assert last == want and len(want) == 6


def test_a_run_end_finishes_a_key(spark, tmp_path):
    rocks(spark)
    rows = [("r", "g", 0, 2, 1, "https://x.uk/a"), ("r", "g", 0, 1, 1, "https://x.uk/b")]
    hits = stream_of(spark, tmp_path, "h2", [rows[:1], rows[1:]], HITS)
    ends = stream_of(spark, tmp_path, "e2", [[], [("r", "x.uk/a")]], "run_id string, url_key string")
    got = drain(spark, S.first_hits(hits, ends), "ended_hits", "update", tmp_path)
    assert {(r.url_key, r.final) for r in got} >= {("x.uk/a", True), ("x.uk/b", False)}


def calls_of(n, seed):
    rng = random.Random(seed)
    at, out = 0.0, []
    for _ in range(n):
        at += rng.choice([0, 1, 4, 40])
        out.append((f"k{rng.randint(0, 1)}", T0 + dt.timedelta(seconds=at), rng.random() < 0.6))
    return out


def plain(calls, min_calls):
    out = []
    for key, ts, _ in calls:
        seen = [f for k, t, f in calls if k == key and ts - dt.timedelta(seconds=30) <= t <= ts]
        out.append((key, ts, len(seen), sum(seen), len(seen) >= min_calls and sum(seen) >= len(seen) / 2))
    return sorted(out)


def test_every_call_sees_the_thirty_seconds_before_it(spark):
    calls = calls_of(200, 2)
    got = S.rolling_failures(spark.createDataFrame(calls, "key string, ts timestamp, failed boolean"), ["key"], min_calls=4, slice_seconds=60).collect()
    assert sorted((r.key, r.ts, r.calls, r.failures, r.open) for r in got) == plain(calls, 4)


def test_the_stream_of_ordered_calls_equals_the_batch_form(spark, tmp_path):
    rocks(spark)
    calls = sorted(calls_of(60, 3), key=lambda c: c[1])
    cuts = [k for k in range(1, 60) if calls[k][1] != calls[k - 1][1]]
    a, b = cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]
    stream = stream_of(spark, tmp_path, "c", [calls[:a], calls[a:b], calls[b:]], "key string, ts timestamp, failed boolean")
    got = drain(spark, S.rolling_failure_stream(stream, "key", min_calls=4), "rolling", "update", tmp_path)
    zero = dt.datetime(1970, 1, 1)
    assert sorted((r.key, zero + dt.timedelta(microseconds=r.us), r.calls, r.failures, r.open) for r in got) == plain(calls, 4)


def test_a_first_hit_works_on_rows():
    """No frame is built per key: the processor takes and gives rows."""
    from pyspark.sql import Row

    class Held:
        value = None

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    one = S.FirstHit()
    one.best = Held()
    hit = lambda n, url: Row(nth_pass=n, group_ord=0, rank=1, group_id="g", url=url)
    asked = [[hit(2, "b"), hit(3, "a")], [hit(2, "c")], [hit(1, "d"), hit(2, "a")], [hit(9, None)]]
    got = [[(r.nth_pass, r.url, r.version, r.final) for r in one.handleInputRows(("r", "k"), iter(rows), None)] for rows in asked]
    assert got == [[(2, "b", 1, False)], [], [(1, "d", 2, False)], [(1, "d", 2, True)]] and one.best.value is None
