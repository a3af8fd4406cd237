"""Bench maths (percentiles, last found, gate) and lease audit scenarios."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from runledger.operators import aggregate as A
from runledger.operators import lease as LE
from runledger.operators import ordered
from runledger.operators import runstats as RS
from runledger.sources.ndjson import read_log


def _runs(spark, lats, errs=None):
    errs = errs or [False] * len(lats)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(float(x), e, t0 + dt.timedelta(seconds=i)) for i, (x, e) in enumerate(zip(lats, errs))]
    return spark.createDataFrame(rows, "latency_ms double, err boolean, ts timestamp_ntz").withColumn("g", F.lit("x"))


def test_percentile_rule(spark):
    r = RS.latency_percentiles(_runs(spark, range(1, 11)), ["g"], (0.0, 0.5, 1.0)).collect()[0]
    assert (r.p0, r.p50, r.p100) == (1.0, 5.5, 10.0)


def test_empty_stats_are_zero(spark):
    s = RS.run_summary(_runs(spark, [3.0, 4.0], [True, True])).collect()[0]
    assert (s.successes, s.failures, s.p50_ms, s.max_ms, s.mean_ms) == (0, 2, 0.0, 0.0, 0.0)


def test_gate(spark):
    schema = "successes long, failures long, jobs_per_sec double, p50_ms double, p95_ms double, p99_ms double"
    run = spark.createDataFrame([(90, 3, 41.5, 7.0, 33.0, 61.0)], schema)

    def checks(*limits):
        return sorted((r.check, r.value, r.limit) for r in RS.regress_gate(run, RS.Baseline(*limits)).collect())

    assert checks(41.5, 7, 33, 61, 3) == []  # a limit that is met exactly holds
    assert checks(42, 6, 33, 60, 3) == [("jobs_per_sec", 41.5, 42.0), ("p50_ms", 7.0, 6.0), ("p99_ms", 61.0, 60.0)]
    assert checks(0, 0, -1, 0, 2) == [("failures", 3.0, 2.0)]  # a limit of 0 or less is off, but failures always count


def test_last_found(spark):
    top = 2**64 - 1
    rows = [("a", 1, "checkpoint", 8), ("a", 2, "completed", top), ("a", 3, "failed", 5), ("b", 4, "checkpoint", 11), ("b", 5, "checkpoint", None), ("c", 6, "started", 3)]
    df = spark.createDataFrame([(j, s, t, None if f is None else Decimal(f)) for j, s, t, f in rows], "job_id string, seq long, type string, found decimal(20,0)")
    assert {r.job_id: int(r.last_found) for r in A.last_found(df).collect()} == {"a": top, "b": 11, "c": 0}


def test_one_huge_latency_does_not_fill_a_bucket(spark):
    rows = [("w", float(i % 5000) + i / 1e6) for i in range(20_000)] + [("w", 1e9), ("x", 3.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "w string, v double").repartition(4)
    want = {r.w: r.p for r in df.groupBy("w").agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.99), F.lit(1.0))).alias("p")).collect()}
    for hot in (False, True):
        got = {r.w: [r._q0, r._q1, r._q2] for r in RS.rank_percentiles(df, ["w"], "v", (0.5, 0.99, 1.0), hot=hot, hot_rows=1000).collect()}
        assert {k: [round(x, 6) for x in v] for k, v in got.items()} == {k: [round(x, 6) for x in v] for k, v in want.items()}


def test_strict_int64_drops_big_checkpoints(spark):
    lines = [
        '{"type":"checkpoint","job_id":"a","found":18446744073709551615}',
        '{"type":"checkpoint","job_id":"a","found":5}',
        '{"type":"completed","job_id":"a","found":18446744073709551615}',
        "   ",
        '{"type":"chec',
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "seq long, value string")
    assert read_log(df).count() == 3
    strict = read_log(df, strict_int64=True).collect()
    assert [(r.type, int(r.found)) for r in strict] == [("checkpoint", 5), ("completed", 2**64 - 1)]


def _touches(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [("k", h, t0 + dt.timedelta(seconds=s)) for h, s in rows]
    return spark.createDataFrame(data, "lease_key string, holder string, ts timestamp_ntz")


def test_failover_scenario(spark):
    # A acquires (TTL 30) and refreshes, then is silent for 40 s; B takes over.
    t = _touches(spark, [("A", 0), ("A", 10), ("A", 20), ("B", 55), ("B", 65)])
    holds = LE.lease_holds(t, 30).orderBy("from_ts").collect()
    assert [(h.holder, h.touches) for h in holds] == [("A", 3), ("B", 2)]
    gap = LE.failover_gap(LE.lease_holds(t, 30), 30, 5).collect()[0]
    assert (gap.holder, gap.next_holder, gap.gap_s, gap.within_sla) == ("A", "B", 35.0, True)
    assert LE.lease_overlap(LE.lease_holds(t, 30)).count() == 0


def test_touch_exactly_at_ttl_extends(spark):
    t = _touches(spark, [("A", 0), ("A", 30), ("A", 61)])
    holds = sorted((h.from_ts, h.touches) for h in LE.lease_holds(t, 30).collect())
    assert [n for _, n in holds] == [2, 1]


def test_overlap_and_starts(spark):
    t = _touches(spark, [("A", 0), ("B", 10), ("A", 100)])
    holds = LE.lease_holds(t, 30)
    ov = LE.lease_overlap(holds).collect()
    assert [(r.holder, r.n_active) for r in ov] == [("B", 2)]
    t0 = dt.datetime(2024, 1, 1)
    starts = spark.createDataFrame(
        [(1, "k", "A", t0 + dt.timedelta(seconds=5)), (2, "k", "B", t0 + dt.timedelta(seconds=80)), (3, "k", "A", t0 + dt.timedelta(seconds=130))],
        "seq long, lease_key string, starter string, ts timestamp_ntz",
    )
    got = {r.seq: (r.n_covering, r.own_hold, r.violation) for r in LE.start_by_holder(starts, holds).collect()}
    assert got == {1: (1, True, False), 2: (0, False, True), 3: (1, True, False)}


def test_starts_of_a_hot_key_with_small_holders(spark, monkeypatch):
    from conftest import SF_CHECK
    from runledger.plans import q_runs

    want = sorted(map(tuple, q_runs.start_by_holder(spark, SF_CHECK).collect()))
    monkeypatch.setattr(ordered, "HOT_ROWS", 1500)  # 2,000 touches a key, at most a few dozen a holder
    monkeypatch.setattr(ordered, "RANGE_ROWS", 700)
    written, pinned = [], ordered.pinned
    monkeypatch.setattr(ordered, "pinned", lambda df: written.append(df) or pinned(df))
    holds, hot, hot_own = q_runs._holds(spark, SF_CHECK)
    assert hot and not hot_own and not written  # no holder of a key is cut
    assert sorted(map(tuple, q_runs.start_by_holder(spark, SF_CHECK).collect())) == want
    assert len(written) == 2  # the sweep's rows and their ranges


def _held(ops, ttl):
    """The lock itself, step by step: (holder, from, last, until, touches) of every hold of one key."""
    holds, who, until = [], None, None
    for holder, t, op in ops:
        free = until is None or t > until
        if op == "acquire" and free:
            holds.append([holder, t, t, t + ttl, 0])
            who = holder
        elif free or who != holder:
            continue
        until = t + ttl
        holds[-1][2:] = [t, until, holds[-1][4] + 1]
        if op == "release":
            holds[-1][3], until = t, None
    return [tuple(h) for h in holds]


def _ops_frame(spark, rows, keys=None):
    t0 = dt.datetime(2024, 1, 1)
    keys = keys or ["k"] * len(rows)
    data = [(k, h, t0 + dt.timedelta(seconds=s), i, op) for i, (k, (h, s, op)) in enumerate(zip(keys, rows))]
    return spark.createDataFrame(data, "lease_key string, holder string, ts timestamp_ntz, seq long, op string").repartition(3)


def _lock_rows(holds):
    at = lambda x: int((x - dt.datetime(2024, 1, 1)).total_seconds())
    rows = [(h.lease_key, at(h.from_ts), h.holder, h.hold_no, at(h.last_touch), at(h.until_ts), h.touches) for h in holds.collect()]
    return sorted(rows, key=lambda r: (str(r[0]), *r[1:4]))


def _lock_walk(rows, keys, ttl):
    out = []
    for k in set(keys):
        seen = {}
        for holder, first, last, until, touches in _held([r for r, x in zip(rows, keys) if x == k], ttl):
            seen[holder] = seen.get(holder, 0) + 1
            out.append((k, first, holder, seen[holder], last, until, touches))
    return sorted(out, key=lambda r: (str(r[0]), *r[1:4]))


@pytest.mark.parametrize(("holders", "hot"), [("A", None), ("ABCDEFGH", None), ("ABC", 40)])
def test_lock_rules_equal_the_lock(spark, hot, holders, monkeypatch):
    if hot:
        monkeypatch.setattr(ordered, "HOT_ROWS", 300)
    rnd = random.Random(len(holders))
    rows, keys, now = [], [], 0
    for _ in range(1200):
        now += rnd.choice([0, 1, 5, 20, 31, 60]) if rnd.random() < 0.98 else 4000
        rows.append((rnd.choice(holders), now, rnd.choice(["acquire", "acquire", "refresh", "refresh", "refresh", "release"])))
        keys.append(rnd.choice(["hot"] * 8 + ["a", "b", None]))
    got = LE.lock_holds(_ops_frame(spark, rows, keys), 30, hot_rows=hot, range_rows=25)
    got = spark.createDataFrame(got.collect(), got.schema)
    assert _lock_rows(got) == _lock_walk(rows, keys, 30)
    assert LE.lease_overlap(got).count() == 0


def test_ranges_that_a_hold_spans(spark):
    # one holder refreshes over many ranges while others try; some ranges hold no start at all
    rows = [("A", 0, "acquire")]
    for i in range(1, 400):
        rows += [("A", 10 * i, "refresh"), ("BC"[i % 2], 10 * i + 1, "acquire")]
    rows += [("A", 3995, "release"), ("C", 3995, "acquire"), ("B", 3996, "acquire"), ("B", 4100, "acquire")]
    got = LE.lock_holds(_ops_frame(spark, rows), 30, hot_rows=20, range_rows=30)
    got = spark.createDataFrame(got.collect(), got.schema)
    want = _lock_walk(rows, ["k"] * len(rows), 30)
    assert _lock_rows(got) == want and [w[2] for w in want] == ["A", "C", "B"]
    assert LE.lease_overlap(got).count() == 0


def test_an_acquire_while_another_holds_is_refused(spark):
    t = _ops_frame(spark, [("A", 0, "acquire"), ("B", 10, "acquire"), ("A", 20, "refresh")])
    assert _lock_rows(LE.lease_holds(t, 30, seq="seq")) == [("k", 0, "A", 1, 20, 50, 2)]
    # the holder itself may acquire again; at the instant of expiry the lock is still held
    t = _ops_frame(spark, [("A", 0, "acquire"), ("A", 10, "acquire"), ("B", 40, "acquire"), ("B", 41, "acquire"), ("A", 45, "release")])
    assert _lock_rows(LE.lease_holds(t, 30, seq="seq")) == [("k", 0, "A", 1, 10, 40, 2), ("k", 41, "B", 1, 41, 71, 1)]


def test_late_refresh_fails_and_does_not_overlap(spark):
    t = _ops_frame(spark, [("A", 0, "acquire"), ("A", 40, "refresh"), ("B", 41, "acquire"), ("A", 45, "release"), ("B", 50, "release")])
    holds = LE.lease_holds(t, 30, seq="seq")
    assert sorted((h.holder, h.touches) for h in holds.collect()) == [("A", 1), ("B", 2)]
    assert LE.lease_overlap(holds).count() == 0
