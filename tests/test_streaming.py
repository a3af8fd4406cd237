"""Streaming twins: replay state across batches, restart equals a fresh run."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from runledger.operators import aggregate as A
from runledger.operators import lease as LE
from runledger.operators import lifecycle as L
from runledger.plans import fixtures as fx
from runledger.streaming import core as C
from runledger.streaming import ops as S

from conftest import SF_SMALL


@pytest.mark.parametrize("chunks", [1, 3, 7])
def test_stream_replay_equals_batch(spark, chunks):
    src, out, ck = C.paths(spark, "t-st3")
    log = fx.job_log(spark, SF_SMALL)
    files = C.stage_chunks(log, src, "seq", chunks, 70)
    assert files > 1
    q = S.stream_replay_state(C.stream_session(spark).readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(src))
    C.run_available_now(q, out, ck)
    got = {(r.job_id, r.seq): (r.from_state, r.accepted) for r in spark.read.parquet(out).collect()}
    want = {(r.job_id, r.seq): (r.from_state, r.accepted) for r in L.replay_steps(log).collect()}
    assert got == want


def test_restart_on_same_checkpoint_equals_fresh_run(spark):
    from runledger.sources.tables import table

    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    src, out, ck = C.paths(spark, "t-st4")
    for lo, hi in ((-1, 60), (60, 120), (120, 10**9)):
        C.stage_chunks(docs.filter((F.col("doc_id") > lo) & (F.col("doc_id") <= hi)), src, "doc_id", 1)
        q = S.stream_word_count(spark.readStream.schema(docs.schema).parquet(src))
        C.run_available_now(q, out, ck, output_mode="update", foreach_batch=C.upsert_batches(out, ["word"]))
    got = {(r.word, r.n) for r in C.read_latest(spark, out, ["word"]).collect()}
    want = {(r.word, r.n) for r in A.word_count(A.tokenize(docs)).collect()}
    assert got == want


@pytest.mark.parametrize("files", [1, 3, 7])
def test_stale_alerts_do_not_depend_on_batch_borders(spark, files):
    rnd = random.Random(9)
    t0, now, rows = dt.datetime(2024, 1, 1), 0, []
    for i in range(60):
        now += rnd.choice([1, 7, 40, 130])
        rows.append((rnd.choice("abc"), i, t0 + dt.timedelta(seconds=now), "checkpoint"))
    rows.append(("end", 60, t0 + dt.timedelta(seconds=now + 10_000), "checkpoint"))
    src, out, ck = C.paths(spark, "t-st7")
    schema = "job_id string, seq long, ts timestamp_ntz, type string"
    for k in range(0, len(rows), -(-len(rows) // files)):
        spark.createDataFrame(rows[k : k + -(-len(rows) // files)], schema).coalesce(1).write.mode("append").parquet(src)
    sdf = C.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.run_available_now(S.stream_stale_alerts(sdf, 50), out, ck)
    base = int(t0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted((r.job_id, r.stale_since_ms - base) for r in spark.read.parquet(out).collect())
    want = []
    for job in "abc":
        at = [int((ts - t0).total_seconds()) for j, _, ts, _ in rows if j == job]
        want += [(job, (x + 50) * 1000) for x, y in zip(at, at[1:] + [10**9]) if y - x > 50]
    assert got == sorted(want)


def test_staging_keeps_rows_without_an_order(spark):
    rows = [(i if i % 3 else None, f"r{i}") for i in range(20)]
    for data in (rows, [(None, v) for _, v in rows]):
        src, _, _ = C.paths(spark, "t-stage")
        C.stage_chunks(spark.createDataFrame(data, "seq long, value string"), src, "seq", 3, 5)
        assert sorted(r.value for r in spark.read.parquet(src).collect()) == sorted(v for _, v in data)


def test_a_limit_that_is_hit_raises(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    src, out, ck = C.paths(spark, "t-limit")
    C.stage_chunks(docs, src, "doc_id", 6)
    q = S.stream_word_count(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src))
    with pytest.raises(TimeoutError):
        C.run_available_now(q, out, ck, output_mode="update", foreach_batch=C.upsert_batches(out, ["word"]), timeout_s=0.2)


def test_snapshot_published_twice_is_there_once(spark):
    from runledger.session import scratch_path
    from runledger.sources import sinks

    path, df = scratch_path(spark, "snap"), spark.range(5)
    sinks.publish_snapshot(df, path, "20240101")
    sinks.publish_snapshot(df, path, "20240102")
    sinks.publish_snapshot(df.filter("id < 3"), path, "20240102")
    assert sinks.latest_snapshot(spark, path).count() == 3


def test_log_lines_that_a_reader_skips(spark):
    from runledger.sources.ndjson import read_log

    good = '{"type":"checkpoint","job_id":"a","epoch":1,"found":2}'
    lines = {
        "plain": good,
        "space": "\t\u00a0 " + good + " \r",
        "null": '{"type":"checkpoint","epoch":null}',
        "big": '{"type":"checkpoint","found":18446744073709551615}',
        "done": '{"type":"completed","epoch":"x"}',
        "twice": '{"type":"checkpoint","epoch":"x","found":1,"epoch":7,"found":2}',
        "!twice": '{"type":"checkpoint","epoch":7,"epoch":"x"}',
        "low": '{"type":"checkpoint","epoch":-9223372036854775808}',
        "!high": '{"type":"checkpoint","epoch":9223372036854775808}',
        "!far": '{"type":"checkpoint","epoch":99999999999999999999}',
        "!u64": '{"type":"checkpoint","found":18446744073709551616}',
        "!word": good.replace("1", '"1"'),
        "!fraction": good.replace("2", "2.5"),
        "!quotes": good.replace('"', "'"),
        "!after": good + " x",
        "!two": good + good,
        "!list": good + "," + good,
        "!cut": good[:-3],
        "!other": good.replace("checkpoint", "note"),
    }
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines.values())], "seq long, value string")
    names = list(lines)
    assert {names[r.seq] for r in read_log(df).collect()} == {n for n in names if n[0] != "!"}
    values = {names[r.seq]: (r.epoch, r.found) for r in read_log(df).collect()}
    assert values["twice"] == (7, 2) and values["low"][0] == -(2**63)
    assert {names[r.seq] for r in read_log(df, strict_int64=True).collect()} == {n for n in names if n[0] != "!" and n != "big"}


def _staged(spark, rows, schema, name, files):
    src, out, ck = C.paths(spark, name)
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(src)
    sdf = C.stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    return src, out, ck, sdf


@pytest.mark.parametrize("files", [1, 3, 7])
def test_gaps_come_with_the_next_hold(spark, files):
    rnd = random.Random(files)
    t0, now, rows = dt.datetime(2024, 1, 1), 0, []
    for i in range(150):
        now += rnd.choice([0, 1, 5, 20, 31, 90])
        rows.append((rnd.choice(["k", "l", None]), rnd.choice("AAAABC"), t0 + dt.timedelta(seconds=now, microseconds=rnd.randint(0, 999_999)), i))
    rows.sort(key=lambda r: r[2])
    rows.append(("end", "Z", t0 + dt.timedelta(seconds=now + 500), 150))
    schema = "lease_key string, holder string, ts timestamp_ntz, seq long"
    _, out, ck, sdf = _staged(spark, rows, schema, "t-st8", files)
    C.run_available_now(S.stream_failover(sdf, 30, 5), out, ck)
    holds = LE.lease_holds(spark.createDataFrame(rows, schema), 30)
    want = LE.failover_gap(holds, 30, 5)
    got = spark.read.parquet(out)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_gaps_go_on_after_a_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    schema = "lease_key string, holder string, ts timestamp_ntz, seq long"
    src, out, ck = C.paths(spark, "t-st8r")
    # A holds over both runs, C's hold begins and ends inside it
    first = [("k", "A", at(s), s) for s in (0, 25, 50)] + [("k", "C", at(30), 99)]
    second = [("k", "A", at(75), 75), ("k", "B", at(120), 120), ("x", "Z", at(900), 900)]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        sdf = C.stream_session(spark).readStream.schema(schema).parquet(src)
        C.run_available_now(S.stream_failover(sdf, 30, 5), out, ck)
    want = LE.failover_gap(LE.lease_holds(spark.createDataFrame(first + second, schema), 30), 30, 5)
    got = spark.read.parquet(out).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 2


def test_lines_sent_again_belong_to_their_own_attempt(spark):
    t0 = dt.datetime(2024, 1, 1)
    line = lambda kind, epoch: '{"type":"%s","job_id":"j","epoch":%s,"found":1}' % (kind, epoch)
    log = [(1, line("started", "null")), (2, line("checkpoint", 1)), (3, line("checkpoint", 2)), (4, line("started", "null"))]
    log += [(5, line("checkpoint", 1)), (6, line("checkpoint", 2))]
    schema = "seq long, ts timestamp_ntz, value string"
    row = lambda r: (r[0], t0 + dt.timedelta(seconds=r[0]), r[1])
    src, out, ck = C.paths(spark, "t-st6")
    # a second run re-reads the log from its start, then goes on
    for part in (log[:5], log[:3] + log[3:]):
        spark.createDataFrame(list(map(row, part)), schema).coalesce(1).write.mode("append").parquet(src)
        raw = C.stream_session(spark).readStream.schema(schema).parquet(src)
        C.run_available_now(S.stream_dedupe(S.with_lines(raw)), out, ck)
    got = sorted((r.seq, r.attempt, r.epoch) for r in spark.read.parquet(out).collect())
    assert got == [(2, 1, 1), (3, 1, 2), (5, 2, 1), (6, 2, 2)]


def test_replay_goes_on_after_a_restart(spark):
    log = fx.job_log(spark, SF_SMALL)
    cut = log.approxQuantile("seq", [0.4], 0.0)[0]
    src, out, ck = C.paths(spark, "t-st3r")
    for part in (log.filter(F.col("seq") <= cut), log.filter(F.col("seq") > cut)):
        C.stage_chunks(part, src, "seq", 1)
        q = S.stream_replay_state(C.stream_session(spark).readStream.schema(log.schema).parquet(src))
        C.run_available_now(q, out, ck)
    got = {(r.job_id, r.seq): (r.from_state, r.accepted) for r in spark.read.parquet(out).collect()}
    assert got == {(r.job_id, r.seq): (r.from_state, r.accepted) for r in L.replay_steps(log).collect()}


def test_alert_clocks_are_forgotten_and_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    schema = "job_id string, seq long, ts timestamp_ntz, type string"
    src, out, ck = C.paths(spark, "t-st7r")
    row = lambda j, s: (j, s, t0 + dt.timedelta(seconds=s), "checkpoint")
    for part in ([row("a", 0), row("b", 10), row("a", 30)], [row("b", 60), row("a", 81), row(None, 90)], [row("end", 1000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        sdf = C.stream_session(spark).readStream.schema(schema).parquet(src)
        C.run_available_now(S.stream_stale_alerts(sdf, 50), out, ck)
    base = int(t0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = sorted((str(r.job_id), r.stale_since_ms // 1000 - base) for r in spark.read.parquet(out).collect())
    # b: 10 to 60 is not longer than the bound; a: 30 to 81 is
    assert got == [("None", 140), ("a", 80), ("a", 131), ("b", 110)]
    held = spark.read.format("statestore").option("path", ck).option("stateVarName", "held").load()
    assert held.count() == 1  # only the closing row's own clock


def test_a_kill_between_write_and_commit(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    src, out, ck = C.paths(spark, "t-st4k")
    write = C.upsert_batches(out, ["word"])
    C.stage_chunks(docs, src, "doc_id", 4)
    stream = lambda: S.stream_word_count(
        C.stream_session(spark).readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    )
    for batch in (0, 2):
        with pytest.raises(Exception, match="Killed"):
            C.run_available_now(stream(), out, ck, output_mode="update", foreach_batch=C.killed_after(write, batch))
    C.run_available_now(stream(), out, ck, output_mode="update", foreach_batch=write)
    got = {(r.word, r.n) for r in C.read_latest(spark, out, ["word"]).collect()}
    assert got == {(r.word, r.n) for r in A.word_count(A.tokenize(docs)).collect()}
    assert A.count_fingerprint(C.read_latest(spark, out, ["word"])).first() == A.count_fingerprint(A.word_count(A.tokenize(docs))).first()


def test_upserts_are_compacted(spark):
    _, out, _ = C.paths(spark, "t-upsert")
    write = C.upsert_batches(out, ["k"], every=3)
    want = {}
    for i in range(8):
        rows = [(i % 4, i), (10 + i, i)] if i != 4 else []
        want |= dict(rows)
        write(spark.createDataFrame(rows, "k long, v long"), i)
        if i == 5:
            write(spark.createDataFrame(rows, "k long, v long"), i)  # a retry replaces its own output
        assert {r.k: r.v for r in C.read_latest(spark, out, ["k"]).collect()} == want
    read = C._since_full(spark.read.parquet(out))
    assert sorted({r.batch_id for r in read.select("batch_id").distinct().collect()}) == [5, 6, 7]


def test_late_rows_and_windows_add_up(spark):
    from runledger.plans.q_stream import cadence_with_late_rows

    windows, late = cadence_with_late_rows(spark, SF_SMALL)
    total = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    n_late = late.count()
    assert n_late > 0 and late.filter("event_id % 50 <> 0").count() == 0
    assert windows.agg(F.sum("n")).first()[0] + n_late == total


def test_replay_state_calls_follow_slots_not_jobs():
    from runledger.schemas import STATES
    from runledger.streaming.state import Replay

    class Entries(dict):
        calls = 0

        def getValue(self, key):  # noqa: N802 - Spark's name
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802 - Spark's name
            self.calls += 1
            self[key] = value

    class Handle:
        def getMapState(self, *_):  # noqa: N802 - Spark's name
            return Entries()

    rnd = np.random.default_rng(5)
    names = np.array([None, "-", "=", "=-", "", *[f"job-{i}" for i in range(995)]], dtype=object)
    job = rnd.integers(0, len(names), 6000)
    rows = pd.DataFrame({"job_id": names[job], "slot": job % 8, "seq": np.arange(6000), "ms": np.arange(6000) // 10,
                         "to_state": rnd.choice([*STATES, "nonsense"], 6000)})
    whole, cut = Replay(), Replay()
    for p in (whole, cut):
        p.prepare(Handle())
    want, kept, wake = whole.advance(None, rows, 10_000)
    assert kept.empty and wake is None and len(want) == 6000 and whole.jobs.calls == 16
    parts, held = [], None
    for lo, mark in ((0, 150), (2000, 390), (4000, 10_000)):
        out, held, _ = cut.advance(held, rows.iloc[lo : lo + 2000], mark)
        parts.append(out)
    got = pd.concat(parts).sort_values("seq", ignore_index=True)
    pd.testing.assert_frame_equal(got, want.sort_values("seq", ignore_index=True))
    assert cut.jobs.calls == 48
    for a, b in zip(whole._known(np.arange(8)), cut._known(np.arange(8)), strict=True):
        assert len(a) == len(b)
    assert sum(whole._known(np.arange(8))[2][1:].sum(axis=0)) == 6000
