"""Streaming queries ST1-ST9.

Each callable stages its input (derived from the driver tables) as ordered
file chunks under the shared checkpoint folder, runs the stream with
``trigger(availableNow=True)`` and returns the sink read back.  The oracle is
the batch twin's SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.plans import fixtures as fx
from runledger.plans.catalog import register, with_ctes
from runledger.plans.fixtures import LEASE_TTL_SECONDS
from runledger.plans.oracle_sql import REPLAY_WALK
from runledger.plans.q_audit import _EVENTS_SQL
from runledger.plans.q_runs import HOLDS_SQL, POLL_SECONDS
from runledger.sources.tables import table
from runledger.streaming import core as C
from runledger.streaming import ops as S

CHUNKS = 3
STALE_NOW = "2024-01-31 00:00:00"
STALE_BOUND_S = 3 * 86400


def _stream_parquet(spark, path, schema, files):
    """A stream that reads a whole staged slice per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@register("stream_log", with_ctes(_EVENTS_SQL, "worker_log"))
def stream_log(spark, sf_dir):
    src, out, ck = C.paths(spark, "st1")
    files = C.stage_chunks(fx.worker_lines(spark, sf_dir, embed_seq=True), src, "seq", CHUNKS, fmt="text")
    C.run_available_now(S.stream_log(C.stream_session(spark), src, files), out, ck)
    return spark.read.parquet(out)


@register(
    "stream_latest_checkpoint",
    with_ctes(
        "select job_id, max(seq) as last_seq, arg_max(epoch, seq) as last_checkpoint_epoch, "
        "arg_max(found, seq) as last_checkpoint_found, arg_max(state_path, seq) as last_checkpoint_path "
        f"from ({_EVENTS_SQL}) where type = 'checkpoint' group by job_id",
        "worker_log",
    ),
)
def stream_latest_checkpoint(spark, sf_dir):
    src, out, ck = C.paths(spark, "st2")
    files = C.stage_chunks(fx.worker_lines(spark, sf_dir, embed_seq=True), src, "seq", CHUNKS, fmt="text")
    q = S.stream_latest_checkpoint(S.stream_log(C.stream_session(spark), src, files))
    C.run_available_now(q, out, ck, output_mode="update", foreach_batch=C.upsert_batches(out, ["job_id"]))
    return C.read_latest(spark, out, ["job_id"])


@register(
    "stream_replay_state",
    with_ctes(
        "select job_id, seq, to_state, from_state, accepted from walk where rn > 0",
        "job_log",
        recursive=True,
        raw=(REPLAY_WALK.strip(),),
    ),
)
def stream_replay_state(spark, sf_dir):
    src, out, ck = C.paths(spark, "st3")
    log = fx.job_log(spark, sf_dir)
    files = C.stage_chunks(log, src, "seq", CHUNKS)
    q = S.stream_replay_state(_stream_parquet(C.stream_session(spark), src, log.schema, files))
    C.run_available_now(q, out, ck)
    return spark.read.parquet(out)


@register("stream_resumable_count", with_ctes("select word, count(*) as n from tokens where word <> '' group by word", "tokens"))
def stream_resumable_count(spark, sf_dir):
    """Two runs on one checkpoint: the first sees only the first half of the documents and dies behind
    the sink's write, before its batch is committed; the restart does that batch again and picks up the
    rest.  The table equals a fresh run."""
    src, out, ck = C.paths(spark, "st4")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mid = docs.approxQuantile("doc_id", [0.5], 0.001)[0]
    write = C.upsert_batches(out, ["word"])
    C.stage_chunks(docs.filter(F.col("doc_id") <= mid), src, "doc_id", 1)
    words = S.stream_word_count(C.stream_session(spark).readStream.schema(docs.schema).parquet(src))
    try:
        C.run_available_now(words, out, ck, output_mode="update", foreach_batch=C.killed_after(write, 0))
    except Exception as e:  # noqa: BLE001 - Spark wraps the writer's error
        if "Killed" not in str(e):
            raise
    C.stage_chunks(docs.filter(F.col("doc_id").isNull() | (F.col("doc_id") > mid)), src, "doc_id", 1)
    words = S.stream_word_count(C.stream_session(spark).readStream.schema(docs.schema).parquet(src))
    C.run_available_now(words, out, ck, output_mode="update", foreach_batch=write)
    return C.read_latest(spark, out, ["word"])


def _close(df, path, seconds, **row):
    """One more file: a row that much later than all others, whose event time closes whatever is open.

    Its own session or window stays open, so it is never emitted.
    """
    late = F.max("ts") + F.make_dt_interval(secs=F.lit(seconds))
    one = df.agg(late.cast(df.schema["ts"].dataType).alias("ts")).filter("ts is not null")
    fields = [F.col("ts") if f.name == "ts" else F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
    one.select(*fields).write.mode("append").parquet(path)


def _touch_stream(spark, sf_dir, name, run):
    src, out, ck = C.paths(spark, name)
    t = fx.lease_touches(spark, sf_dir).select("lease_key", "holder", "ts", "seq")
    files = C.stage_chunks(t, src, "seq", CHUNKS)
    _close(t, src, 2 * LEASE_TTL_SECONDS, lease_key="", holder=-1)
    C.run_available_now(run(_stream_parquet(C.stream_session(spark), src, t.schema, files)), out, ck)
    return spark.read.parquet(out)


@register(
    "stream_lease_sessions",
    with_ctes(
        "select lease_key, holder, from_ts, last_touch, until_ts, touches from holds",
        "lease_touches",
        extra={"holds": HOLDS_SQL},
    ),
)
def stream_lease_sessions(spark, sf_dir):
    return _touch_stream(spark, sf_dir, "st5", lambda t: S.stream_lease_sessions(t, LEASE_TTL_SECONDS))


_EPOCHS = (
    "cast(sum(case when type = 'started' then 1 else 0 end) over (partition by job_id order by seq "
    "rows between unbounded preceding and current row) as bigint) as attempt"
)


@register(
    "stream_dedupe",
    with_ctes(
        "select job_id, attempt, row_number() over (partition by job_id, attempt order by seq) as epoch, seq, ts, found "
        f"from (select *, {_EPOCHS} from worker_log) where type = 'checkpoint'",
        "worker_log",
    ),
)
def stream_dedupe(spark, sf_dir):
    """Checkpoint lines carry the number that the worker printed (1, 2, ... in each of its runs); every 7th
    line is sent again a third of the log later (a re-attach re-reads the log).  The stream gets
    raw lines with their position and time; the attempts are found inside it.  A line is known by
    (job, attempt, epoch)."""
    src, out, ck = C.paths(spark, "st6")
    lines = fx.raw_lines(spark, sf_dir)
    span = lines.agg(F.max("seq") - F.min("seq")).first()[0] or 0
    again = lines.filter(F.col("seq") % 7 == 0).withColumn("arrival", F.col("seq") + F.lit(span // CHUNKS + 1))
    staged = lines.withColumn("arrival", F.col("seq")).unionByName(again)
    files = C.stage_chunks(staged, src, "arrival", CHUNKS)
    raw = _stream_parquet(C.stream_session(spark), src, staged.schema, files)
    C.run_available_now(S.stream_dedupe(S.with_lines(raw)), out, ck)
    return spark.read.parquet(out)


@register(
    "stream_stale_jobs",
    with_ctes(
        "select job_id, max(ts) as last_checkpoint_at from worker_log where type = 'checkpoint' group by job_id "
        f"having max(ts) < timestamp '{STALE_NOW}' - to_seconds({STALE_BOUND_S})",
        "worker_log",
    ),
)
def stream_stale_jobs(spark, sf_dir):
    src, out, ck = C.paths(spark, "st7")
    wl = fx.worker_log(spark, sf_dir)
    files = C.stage_chunks(wl, src, "seq", CHUNKS)
    q = S.stream_last_checkpoint_time(_stream_parquet(C.stream_session(spark), src, wl.schema, files))
    C.run_available_now(q, out, ck, output_mode="update", foreach_batch=C.upsert_batches(out, ["job_id"]))
    return S.stale_jobs(C.read_latest(spark, out, ["job_id"]), STALE_NOW, STALE_BOUND_S)


@register(
    "stream_stale_alerts",
    with_ctes(
        "select job_id, (epoch_us(ts) // 1000) as last_checkpoint_ms, (epoch_us(ts) // 1000) + "
        f"{STALE_BOUND_S * 1000} as stale_since_ms from (select job_id, ts, lead((epoch_us(ts) // 1000)) over "
        "(partition by job_id order by ts) as nxt from worker_log where type = 'checkpoint') "
        f"where nxt is null or nxt - (epoch_us(ts) // 1000) > {STALE_BOUND_S * 1000}",
        "worker_log",
    ),
)
def stream_stale_alerts(spark, sf_dir):
    """ST7, timer form: one alert per gap longer than the bound; a late row closes the open gaps."""
    src, out, ck = C.paths(spark, "st7a")
    points = fx.worker_log(spark, sf_dir).select("job_id", "seq", "ts", "type")
    files = C.stage_chunks(points, src, "seq", CHUNKS)
    _close(points, src, 2 * STALE_BOUND_S, job_id="", type="checkpoint")
    q = S.stream_stale_alerts(_stream_parquet(C.stream_session(spark), src, points.schema, files), STALE_BOUND_S)
    C.run_available_now(q, out, ck)
    return spark.read.parquet(out)


@register(
    "stream_failover",
    with_ctes(
        "select lease_key, holder, from_ts, last_touch, until_ts, next_holder, next_from_ts, "
        "(epoch_us(next_from_ts) - epoch_us(last_touch)) / 1e6 as gap_s, "
        f"(epoch_us(next_from_ts) - epoch_us(last_touch)) / 1e6 <= {float(LEASE_TTL_SECONDS + POLL_SECONDS)} as within_sla "
        "from (select *, lead(holder) over w as next_holder, lead(from_ts) over w as next_from_ts from holds "
        "window w as (partition by lease_key order by from_ts, holder)) "
        "where next_holder is not null and next_holder <> holder",
        "lease_touches",
        extra={"holds": HOLDS_SQL},
    ),
)
def stream_failover(spark, sf_dir):
    """ST8: gaps come out batch by batch, each once the hold has closed and the next one is known."""
    return _touch_stream(spark, sf_dir, "st8", lambda t: S.stream_failover(t, LEASE_TTL_SECONDS, POLL_SECONDS))


_DAILY = (
    "select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, event_type, "
    "count(*) as n, sum(cast(value as decimal(18,2))) as total_value from events "
    "group by 1, 2, 3"
)


@register("stream_cadence_counts", _DAILY)
def stream_cadence_counts(spark, sf_dir):
    src, out, ck = C.paths(spark, "st9")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    files = C.stage_chunks(ev, src, "event_id", CHUNKS)
    _close(ev, src, 2 * 86400, event_type="")
    q = S.stream_cadence_counts(_stream_parquet(C.stream_session(spark), src, ev.schema, files))
    C.run_available_now(q, out, ck)
    return spark.read.parquet(out)


def cadence_with_late_rows(spark, sf_dir):
    """(window totals, rows that came too late for them): every 50th event is held back by half the table."""
    src, out, ck = C.paths(spark, "st9l")
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    span = ev.agg(F.max("event_id") - F.min("event_id")).first()[0] or 0
    held = F.when(F.col("event_id") % 50 == 0, F.lit(span // 2)).otherwise(F.lit(0))
    files = C.stage_chunks(ev.withColumn("arrival", F.col("event_id") + held), src, "arrival", 2 * CHUNKS)
    _close(ev.withColumn("arrival", F.col("event_id")), src, 2 * 86400, event_type="")
    schema = spark.read.parquet(src).schema
    stream = lambda: _stream_parquet(C.stream_session(spark), src, schema, files)
    C.run_available_now(S.stream_cadence_counts(stream()), out, ck)
    late, marks = out + "-late", out + "-marks"
    timed = S.with_event_time(stream())
    C.run_available_now(timed, out, ck + "-late", foreach_batch=C.late_batches(late, marks, "1 day"))
    return spark.read.parquet(out), spark.read.schema(timed.schema.add("batch_id", "long")).parquet(late)


@register("stream_cadence_late", _DAILY)
def stream_cadence_late(spark, sf_dir):
    """ST9 with rows sent late: what the windows hold and what the watermark dropped add up to the input."""
    windows, late = cadence_with_late_rows(spark, sf_dir)
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    dropped = late.select(
        day.alias("window_start"), (day + F.expr("interval 1 day")).alias("window_end"), "event_type",
        F.lit(1).cast("bigint").alias("n"), F.col("value").cast("decimal(18,2)").alias("total_value"),
    )
    both = windows.unionByName(dropped).groupBy("window_start", "window_end", "event_type")
    return both.agg(F.sum("n").alias("n"), F.sum("total_value").cast("decimal(28,2)").alias("total_value"))
