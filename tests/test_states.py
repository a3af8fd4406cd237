"""Transition table, terminal flags, guarded replay (unit + hot-key property)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runledger.functions.scalar import is_terminal, is_valid_transition
from runledger.operators import lifecycle as L
from runledger.schemas import STATES, transition_matrix

# The rules in words: who may follow whom, besides the same state again.
FOLLOWS = {
    "pending": "running cancelled failed interrupted_unresumable",
    "running": "checkpointing completed failed cancelled interrupted_resumable interrupted_unresumable",
    "checkpointing": "running completed failed cancelled interrupted_resumable interrupted_unresumable",
    "interrupted_resumable": "running interrupted_unresumable cancelled",
}


def test_all_pairs_of_states(spark):
    pairs = [(a, b, a == b or b in FOLLOWS.get(a, "").split()) for a in STATES for b in STATES]
    df = spark.createDataFrame(pairs, "f string, t string, want boolean")
    got = df.select(is_valid_transition("f", "t").alias("got"), "want").collect()
    assert len(got) == 64 and all(r.got == r.want for r in got)


def test_self_move_always_legal_even_unknown(spark):
    df = spark.createDataFrame([("mystery", "mystery"), ("mystery", "running"), ("interrupted_resumable", "failed")], "f string, t string")
    assert [r.v for r in df.select(is_valid_transition("f", "t").alias("v")).collect()] == [True, False, False]


def test_terminal_states_are_those_nothing_follows(spark):
    df = spark.createDataFrame([(s, s not in FOLLOWS) for s in STATES] + [("odd", False), (None, False)], "s string, want boolean")
    assert all(r.got == r.want for r in df.select(is_terminal("s").alias("got"), "want").collect())


def _py_durations(reqs):
    """(last entry to running, last terminal move) by the order of the log."""
    _, _, _, steps = _py_replay([t for t, _ in reqs])
    run = fin = None
    for (t, ts), (_, ok) in zip(reqs, steps):
        if ok and t == "running":
            run = ts
        if ok and t in STATES and t not in FOLLOWS:
            fin = ts
    return run, fin


@pytest.mark.parametrize("width,fanout", [(4, 2), (1 << 16, 256)])
def test_durations_follow_the_log_not_the_clock(spark, width, fanout):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (f"j{rnd.randint(0, 5)}", i, t0 + dt.timedelta(seconds=rnd.randint(0, 500)), rnd.choice(STATES + ["bogus", None]))
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "job_id string, seq long, recorded_at timestamp_ntz, to_state string").repartition(4)
    out = L.state_durations(df, bucket_width=width, fanout=fanout)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        mine = [(t, ts) for j, _, ts, t in rows if j == r.job_id]
        assert (r.started_at, r.finished_at) == _py_durations(mine)
        assert r.created_at == min(ts for _, ts in mine)


def test_completed_line_may_repeat_the_epoch(spark):
    rows = [("a", 1, "started", 0), ("a", 2, "checkpoint", 1), ("a", 3, "checkpoint", 2), ("a", 4, "completed", 2), ("a", 5, "started", 0), ("a", 6, "checkpoint", 2), ("a", 7, "checkpoint", 2)]
    df = spark.createDataFrame(rows, "job_id string, seq long, type string, epoch long")
    assert {r.seq: r.monotonic for r in L.epoch_monotonic(df).collect()} == {2: True, 3: True, 6: True, 7: False}


def _py_replay(reqs):
    legal = transition_matrix()
    idx = {s: i for i, s in enumerate(STATES)}
    cur, a, r, steps = 0, 0, 0, []
    for t in reqs:
        ti = idx.get(t, -1)
        ok = ti >= 0 and legal[cur][ti]
        steps.append((STATES[cur], ok))
        if ok:
            cur, a = ti, a + 1
        else:
            r += 1
    return STATES[cur], a, r, steps


def test_request_sequence(spark):
    rows = [("j1", 1, "running"), ("j1", 2, "pending"), ("j1", 3, "completed"), ("j1", 4, "completed")]
    df = spark.createDataFrame(rows, "job_id string, seq long, to_state string")
    r = L.replay_state(df).collect()[0]
    assert (r.final_state, r.applied, r.rejected) == ("completed", 3, 1)


@pytest.mark.parametrize("width,fanout", [(4, 2), (16, 4), (1 << 16, 256)])
def test_hot_job_many_buckets_and_levels(spark, width, fanout):
    """One job with most rows, spread over many buckets and composition levels."""
    rnd = random.Random(7)
    rows, seq = [], 0
    for job, n in (("hot", 600), ("a", 5), ("b", 40), ("c", 1)):
        for _ in range(n):
            seq += rnd.randint(1, 5)
            rows.append((job, seq, rnd.choice(STATES + ["bogus", None])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "job_id string, seq long, to_state string").repartition(5)
    got = {r.job_id: (r.final_state, r.applied, r.rejected) for r in L.replay_state(df, bucket_width=width, fanout=fanout).collect()}
    steps = {(r.job_id, r.seq): (r.from_state, r.accepted) for r in L.replay_steps(df, bucket_width=width, fanout=fanout).collect()}
    for job in ("hot", "a", "b", "c"):
        seqs = sorted((s, t) for j, s, t in rows if j == job)
        fin, a, r, st = _py_replay([t for _, t in seqs])
        assert got[job] == (fin, a, r)
        for (s, _), exp in zip(seqs, st):
            assert steps[(job, s)] == exp


def test_levels_are_used(spark):
    df = spark.range(0, 5000).select(F.lit("j").alias("job_id"), F.col("id").alias("seq"), F.lit("running").alias("to_state"))
    assert L._levels(df, "seq", 4, 4) >= 3
    r = L.replay_state(df, bucket_width=4, fanout=4).collect()[0]
    assert (r.final_state, r.applied, r.rejected) == ("running", 5000, 0)
