"""Streams with state of their own: first hit by rank with corrections, and the circuit state of every call.

Each is a ``StatefulProcessor`` for ``transformWithState``; its batch form is a window over a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from farsight.functions.urls import url_key
from farsight.streaming.streams import FAILURE_RATIO, MIN_CALLS

# Seconds before a call that its circuit state looks at (fixed value).
ROLLING_SECONDS = 30
# Seconds of a slice of time.
SLICE_SECONDS = 3600

# ``pass`` is a word of Python and cannot name a field there.
FIRST = "run_id string, url_key string, nth_pass int, group_ord int, rank int, group_id string, url string, version int, final boolean"
HIT = Row(*[f.split()[0] for f in FIRST.split(", ")])
HIT_STATE = "nth_pass int, group_ord int, rank int, group_id string, url string, version int"


class FirstHit(StatefulProcessor):
    """Keeps the least hit of a key by (pass, group order, rank) and gives it out again when a lesser one comes late.

    A row without a URL ends its run for the key: the state goes and the last hit comes out as final. It works on
    rows, as a key has few of them in a batch and a frame for each key costs far more than its rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", HIT_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.best.get()
        known = None if kept is None else tuple(kept)
        least, ended = known, False
        for row in rows:
            hit = (row["nth_pass"], row["group_ord"], row["rank"], row["group_id"], row["url"])
            if hit[4] is None:
                ended = True
            elif least is None or hit < least[:5]:
                least = (*hit, 0)
        changed = least is not None and (known is None or least[:5] != known[:5])
        version = (known[5] if known else 0) + changed
        if ended:
            self.best.clear()
        elif changed:
            self.best.update((*least[:5], version))
        if least is not None and (changed or ended):
            yield HIT(*key, *least[:5], version, ended)

    def close(self) -> None:
        pass


def first_hits(hits: DataFrame, run_ends: DataFrame | None = None) -> DataFrame:
    """The first hit of each (run, canonical key) by (pass, group order, rank), whatever order hits arrive in.

    On a stream every change comes out as a row of a higher ``version``: the table of a key's highest versions equals
    the batch form. ``run_ends`` (run_id, url_key) are rows that end a key's state. A static table gives the batch form.
    """
    keyed = hits.select("run_id", url_key(F.col("url")).alias("url_key"), "pass", "group_ord", "rank", "group_id", "url").where(F.col("url_key").isNotNull())
    if not hits.isStreaming:
        order = Window.partitionBy("run_id", "url_key").orderBy("pass", "group_ord", "rank", "group_id", "url")
        return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    keyed = keyed.withColumnRenamed("pass", "nth_pass")
    if run_ends is not None:
        blank = {c: F.lit(None).cast(keyed.schema[c].dataType) for c in ("nth_pass", "group_ord", "rank", "group_id", "url")}
        keyed = keyed.unionByName(run_ends.select("run_id", "url_key").withColumns(blank))
    return keyed.groupBy("run_id", "url_key").transformWithState(FirstHit(), FIRST, "Update", "None").withColumnRenamed("nth_pass", "pass")


def rolling_failures(
    calls: DataFrame, keys: list[str], ts: str = "ts", seconds: int = ROLLING_SECONDS, min_calls: int = MIN_CALLS["chat"],
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """For every call the calls and failures of its key in the ``seconds`` up to and with it, and whether the circuit is open.

    A range frame over the time; calls of one instant see each other. A key's calls are dealt over slices of time, each
    with the calls just before it, so that no key goes through one task.
    """
    width, reach = max(slice_seconds, seconds) * 1_000_000, seconds * 1_000_000
    timed = calls.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    own = F.floor(F.col("_us") / width)
    reached = F.when(F.floor((F.col("_us") + reach) / width) > own, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = timed.withColumn("_slice", F.explode(reached)).withColumn("_own", F.col("_slice") == own)
    frame = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(-reach, 0)
    counted = dealt.withColumn("calls", F.count("*").over(frame)).withColumn("failures", F.count_if("failed").over(frame)).where("_own")
    opened = (F.col("calls") >= min_calls) & (F.col("failures") >= F.col("calls") * F.lit(FAILURE_RATIO))
    return counted.withColumn("open", opened).drop("_us", "_slice", "_own")


class RollingFailures(StatefulProcessor):
    """Calls of the last seconds by key; a timer per call takes it out once the watermark has passed its window."""

    def __init__(self, seconds: int, min_calls: int, columns: list[str]) -> None:
        self.seconds, self.min_calls, self.columns = seconds, min_calls, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Time in microseconds -> calls and failures of that instant.
        self.instants = handle.getMapState("instants", "us long", "calls long, failures long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked: list[int] = []
        for frame in rows:
            for us, failed in zip(frame["us"], frame["failed"]):
                known = self.instants.getValue((int(us),)) if self.instants.containsKey((int(us),)) else (0, 0)
                self.instants.updateValue((int(us),), (known[0] + 1, known[1] + bool(failed)))
                self.handle.registerTimer(int(us) // 1000 + self.seconds * 1000 + 1)
                asked.append(int(us))
        held = sorted((k[0], *v) for k, v in self.instants.iterator())
        out = []
        for us in asked:
            seen = [(n, f) for at, n, f in held if us - self.seconds * 1_000_000 <= at <= us]
            calls, failures = sum(n for n, _ in seen), sum(f for _, f in seen)
            out.append((*key, us, calls, failures, calls >= self.min_calls and failures >= calls * FAILURE_RATIO))
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = (expiredTimerInfo.getExpiryTimeInMs() - self.seconds * 1000) * 1000
        for at in [k[0] for k in self.instants.keys()]:
            if at < before:
                self.instants.removeKey((at,))
        yield pd.DataFrame(columns=self.columns)

    def close(self) -> None:
        pass


def rolling_failure_stream(
    calls: DataFrame, key: str, ts: str = "ts", seconds: int = ROLLING_SECONDS, min_calls: int = MIN_CALLS["chat"], delay: str = "1 minute",
) -> DataFrame:
    """(key, us, calls, failures, open) of every call of a stream when it arrives; ``us`` is its time in microseconds.

    Equal to the batch form where a key's calls arrive in the order of their time.
    """
    kind = calls.schema[key].dataType.simpleString()
    timed = calls.select(key, F.col(ts).cast("timestamp").alias("ts"), "failed").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    schema = f"{key} {kind}, us long, calls long, failures long, open boolean"
    names = [f.split()[0] for f in schema.split(", ")]
    return timed.groupBy(key).transformWithStateInPandas(RollingFailures(seconds, min_calls, names), schema, "Update", "EventTime")
