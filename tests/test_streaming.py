import datetime as dt

from pyspark.sql import functions as F

from farsight.streaming import streams as T


def stream_of(spark, tmp_path, name, batches, schema):
    """A file stream that delivers each batch as one micro-batch."""
    path = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, df, name, mode, tmp_path):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


T0 = dt.datetime(2026, 1, 1)


def test_dedupe_stream_equals_batch_keys(spark, tmp_path):
    rows = [("r", f"https://www.x.uk/{i % 5}/?utm_a={i}", T0 + dt.timedelta(seconds=i)) for i in range(30)] + [("r", "mailto:x", T0)]
    schema = "run_id string, url string, ts timestamp"
    streamed = T.dedupe_hits(stream_of(spark, tmp_path, "hits", [rows[:15], rows[15:]], schema))
    got = drain(spark, streamed, "deduped", "append", tmp_path)
    want = T.dedupe_hits(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.url_key for r in got) == sorted(r.url_key for r in want) == [f"x.uk/{i}" for i in range(5)]


def test_keys_are_remembered_for_the_whole_run(spark, tmp_path):
    rows = [("r", "https://x.uk/1", T0), ("r", "https://x.uk/2", T0 + dt.timedelta(days=9)), ("r", "https://x.uk/1/", T0 + dt.timedelta(days=9))]
    schema = "run_id string, url string, ts timestamp"
    streamed = T.dedupe_hits(stream_of(spark, tmp_path, "hits", [[r] for r in rows] + [[("r", "https://x.uk/3", T0)]], schema))
    assert sorted(r.url_key for r in drain(spark, streamed, "run_keys", "append", tmp_path)) == ["x.uk/1", "x.uk/2", "x.uk/3"]


def test_windows_roll(spark):
    calls = [(T0 + dt.timedelta(seconds=s), s >= 20) for s in range(0, 40, 2)]
    rolled = T.failure_windows(spark.createDataFrame(calls, "ts timestamp, failed boolean"), [], slide="10 seconds")
    got = {(r.window_start - T0).total_seconds(): (r.calls, r.failures, r.open) for r in rolled.collect()}
    assert got == {-20: (5, 0, False), -10: (10, 0, False), 0: (15, 5, False), 10: (15, 10, True), 20: (10, 10, True), 30: (5, 5, False)}


def test_failure_windows_open_at_the_ratio(spark, tmp_path):
    calls = [(T0 + dt.timedelta(seconds=s), s % 2 == 0) for s in range(20)] + [(T0 + dt.timedelta(seconds=30 + s), s == 0) for s in range(12)]
    late = [(T0 + dt.timedelta(hours=1), False)]
    schema = "ts timestamp, failed boolean"
    batch = {r.window_start: (r.calls, r.failures, r.open) for r in T.failure_windows(spark.createDataFrame(calls, schema), []).collect()}
    assert batch == {T0: (20, 10, True), T0 + dt.timedelta(seconds=30): (12, 1, False)}
    streamed = T.failure_windows(stream_of(spark, tmp_path, "calls", [calls, late, late], schema), [])
    got = {r.window_start: (r.calls, r.failures, r.open) for r in drain(spark, streamed, "failures", "append", tmp_path)}
    assert got == batch
    few = T.failure_windows(spark.createDataFrame(calls[:4], schema), [], min_calls=T.MIN_CALLS["search"]).head()
    assert (few.failures, few.open) == (2, False)


def test_routing_stream(spark, tmp_path):
    rows = [("Relevant", dt.date(2025, 6, 1), T0), ("Borderline", dt.date(2030, 1, 1), T0), ("NotRelevant", None, T0), ("Borderline", None, T0), ("Relevant", None, T0 + dt.timedelta(days=9))]
    schema = "verdict string, publication_date date, ts timestamp"
    none = F.lit(None).cast("date")

    def routed(df):
        full = df.withColumns(dict(effective_date=none, applies_from=none, date_confidence=F.lit("High"), lower=none, upper=F.lit("2025-12-31").cast("date")))
        return T.route_windows(T.route_stream(full))

    streamed = routed(stream_of(spark, tmp_path, "v", [rows, rows[-1:], rows[-1:]], schema))
    got = drain(spark, streamed, "routed", "append", tmp_path)
    assert [(r.window_start, r.carried, r.borderline, r.dropped) for r in got] == [(T0, 2, 1, 2)]
    batch = {r.window_start: r.carried for r in routed(spark.createDataFrame(rows, schema)).collect()}
    assert batch == {T0: 2, T0 + dt.timedelta(days=9): 1}
