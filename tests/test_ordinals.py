"""Row numbers, as-of values and text parts do not depend on slicing, order or partitions."""

import random

from pyspark.sql import functions as F

from farsight.operators.numbering import numbered
from farsight.operators.ordinals import first_per, last_before, ordinal, text_parts, top_per


def rows(n=400):
    rng = random.Random(7)
    # group 0 holds a third of the rows
    return [(0 if i % 3 == 0 else rng.randrange(1, 9), i, rng.choice([None, f"v{i}"])) for i in range(n)]


def test_ordinal_is_row_number_for_any_slice_size(spark):
    data = rows()
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "g int, o int, v string").repartition(5)
    want = {}
    for g in range(9):
        for n, (o, _) in enumerate(sorted((o, v) for gg, o, v in data if gg == g), 1):
            want[g, o] = n
    for size in (1, 7, 64, 100000):
        got = {(r.g, r.o): r.n for r in ordinal(df, ["g"], "o", "n", slice_size=size).collect()}
        assert got == want
    assert {r.n for r in ordinal(df, ["g"], "o", "n", start=0).where("o < 3").collect()} >= {0}


def test_rows_are_never_broadcast_whatever_is_read_of_them(spark, tmp_path):
    spark.range(50).select(F.col("id").cast("string").alias("g"), F.array(F.lit("x"), F.lit("y")).alias("v")).write.parquet(f"{tmp_path}/t")
    exploded = spark.read.parquet(f"{tmp_path}/t").select("g", F.posexplode("v").alias("o", "v"))
    for out in (ordinal(exploded, ["g"], "o", "n").select("g", "v"), last_before(exploded, ["g"], "o", "v", "w").select("g", "v")):
        assert out.count() == 100
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_last_before_crosses_slices(spark):
    data = sorted(rows(), key=lambda r: r[1])
    want, last = {}, {}
    for g, o, v in data:
        want[g, o] = last.get(g)
        last[g] = v or last.get(g)
    df = spark.createDataFrame(data, "g int, o int, v string").repartition(3)
    for size in (3, 50, 100000):
        got = {(r.g, r.o): r.label for r in last_before(df, ["g"], "o", "v", "label", slice_size=size).collect()}
        assert got == want


def test_text_parts_join_to_the_whole_text(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("o"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("t")).repartition(6)
    parts = text_parts(df, ["k"], "o", "t", rows=64).orderBy("part").collect()
    assert len(parts) == 16
    assert "\n".join(p.text for p in parts) == "\n".join(f"line {i}" for i in range(1000))


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(10000).select((F.col("id") % 2).alias("k"), "id")
    for limited in (first_per(df, ["k"], "id"), top_per(df, ["k"], 3, "id")):
        plan = limited._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_positions_by_range_partitions(spark):
    rows = [("hot" if k % 3 else None, (k * 7919) % 1000 if k % 11 else None, k) for k in range(3000)] + [("one", 5, -1)]
    out = numbered(spark.createDataFrame(rows, "g string, o long, k long"), ["g"], ["o", "k"], start=1).collect()
    low = lambda v: (v is not None, v or 0)
    for g in ("hot", None, "one"):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (low(r[1]), r[2]))
        assert {r.k: r.position for r in out if r.g == g} == {r[2]: n for n, r in enumerate(mine, 1)}
    assert numbered(spark.createDataFrame([], "g string, o long"), ["g"], ["o"]).count() == 0
