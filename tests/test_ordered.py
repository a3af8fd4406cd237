"""Bucketed windows equal plain windows (metamorphic over bucket widths)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runledger.operators import ordered


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", "c"]), i * 3 + rnd.randint(0, 2), rnd.randint(0, 9)) for i in range(800)]
    return spark.createDataFrame(rows, "k string, s long, v long").repartition(4)


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_running_sums_match_window(spark, data, width):
    w = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.k, r.s): r.x for r in data.select("k", "s", F.sum("v").over(w).alias("x")).collect()}
    got = ordered.running_sums(data, ["k"], ["s"], ordered.bucket_of("s", width), {"x": F.col("v")}, hot=True, hot_rows=50)
    assert {(r.k, r.s): r.x for r in got.collect()} == want
    plain = ordered.running_sums(data, ["k"], ["s"], ordered.bucket_of("s", width), {"x": F.col("v")})
    assert {(r.k, r.s): r.x for r in plain.collect()} == want
    excl = ordered.running_sums(data, ["k"], ["s"], ordered.bucket_of("s", width), {"x": F.col("v")}, inclusive=False, hot_rows=50)
    assert {(r.k, r.s): r.x + r.v for r in excl.collect()} == want


@pytest.mark.parametrize("width", [1, 13, 10_000])
@pytest.mark.parametrize("direction", ["lag", "lead"])
def test_shift_match_window(spark, data, width, direction):
    w = Window.partitionBy("k").orderBy("s")
    f = F.lag if direction == "lag" else F.lead
    want = {(r.k, r.s): r.p for r in data.select("k", "s", f("v").over(w).alias("p")).collect()}
    got = ordered.shifted(data, ["k"], ["s"], ordered.bucket_of("s", width), ["v"], "p_", direction, hot_rows=50)
    assert {(r.k, r.s): r.p_v for r in got.collect()} == want


def test_same_result_for_any_partitioning(spark, data):
    a = ordered.running_sums(data.repartition(1), ["k"], ["s"], ordered.bucket_of("s", 50), {"x": F.col("v")}, hot_rows=50)
    b = ordered.running_sums(data.repartition(9, "v"), ["k"], ["s"], ordered.bucket_of("s", 50), {"x": F.col("v")}, hot_rows=50)
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_global_running_sums_match_window(spark, data, parts):
    w = Window.orderBy("s", "k").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.k, r.s): r.x for r in data.select("k", "s", F.sum("v").over(w).alias("x")).collect()}
    got = ordered.global_running_sums(data, ["s", "k"], {"x": F.col("v")}, partitions=parts)
    assert {(r.k, r.s): r.x for r in got.collect()} == want


def test_bucket_levels_with_tiny_fanout(spark, data, monkeypatch):
    monkeypatch.setattr(ordered, "BORDER_FANOUT", 3)
    w = Window.partitionBy("k").orderBy("s")
    want_sum = {(r.k, r.s): r.x for r in data.select("k", "s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x")).collect()}
    want_lag = {(r.k, r.s): r.p for r in data.select("k", "s", F.lag("v").over(w).alias("p")).collect()}
    for levels in (0, 1, 3):
        got = ordered.running_sums(data, ["k"], ["s"], ordered.bucket_of("s", 5), {"x": F.col("v")}, levels=levels, hot_rows=20)
        assert {(r.k, r.s): r.x for r in got.collect()} == want_sum
        sh = ordered.shifted(data, ["k"], ["s"], ordered.bucket_of("s", 5), ["v"], "p_", levels=levels, hot_rows=20)
        assert {(r.k, r.s): r.p_v for r in sh.collect()} == want_lag


def test_null_keys_and_only_hot_keys_are_cut(spark):
    rows = [(None, i, 1) for i in range(40)] + [("a", i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    got = ordered.running_sums(df, ["k"], ["s"], ordered.bucket_of("s", 4), {"x": F.col("v")}, hot_rows=10).collect()
    assert sorted((str(r.k), r.s, r.x) for r in got) == sorted((str(k), s, s + 1) for k, s, _ in rows)
    cut = ordered._bucketed(df, ["k"], ["s"], ordered.bucket_of("s", 4), 10).collect()
    assert all((r["_bucket"] is None) == (r["k"] == "a") for r in cut)


def test_cold_keys_cost_one_exchange(spark, data):
    df = ordered.running_sums(data, ["k"], ["s"], ordered.bucket_of("s", 4), {"x": F.col("v"), "y": F.lit(1)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_a_key_is_cut_by_rows_not_by_the_clock(spark, monkeypatch):
    """All rows of the hot key lie within one hour, most of them in one second."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
    rows = [("hot", 1_700_000_000 + (i if i < 100 else 100), i, 1) for i in range(900)] + [("b", i, i, 1) for i in range(9)] + [(None, 5, 1, 7)]
    df = spark.createDataFrame(rows, "k string, t long, s long, v long").repartition(5)
    cut = ordered._bucketed(df, ["k"], ["t", "s"], None, 50).groupBy("k", "_bucket").count().collect()
    sizes = [r["count"] for r in cut if r.k == "hot"]
    assert sum(sizes) == 900 and len(sizes) >= 8 and max(sizes) < 300
    assert all(r._bucket is None for r in cut if r.k != "hot")
    w = Window.partitionBy("k").orderBy("t", "s")
    want = df.select("k", "s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("x"), F.lag("s").over(w).alias("p"))
    want = sorted(map(str, want.collect()))
    got = ordered.running_sums(df, ["k"], ["t", "s"], None, {"x": F.col("v")}, levels=0, hot_rows=50)
    got = ordered.shifted(got, ["k"], ["t", "s"], None, ["s"], "p_", levels=0, hot_rows=50)
    assert sorted(map(str, got.select("k", "s", "x", F.col("p_s").alias("p")).collect())) == want
