"""Streaming operators ST1-ST9 (each has a batch twin used as its oracle).

* ST1 ``stream_log``: ``readStream.text`` -> the same tolerant parser as SRC1.
* ST2 ``stream_latest_checkpoint``: ``max_by`` per job in a stateful
  aggregation, emitted in update mode.
* ST3 ``stream_replay_state``: guarded replay; the state is each job's current state, its
  counts and the requests above the event-time watermark; requests
  are applied in ``seq`` order once the watermark passes them.
* ST4 ``stream_resumable_count``: word count whose result after a restart on
  the same checkpoint equals an uninterrupted run.
* ST5 ``stream_lease_sessions``: holds as event-time session windows (gap =
  TTL); append mode emits sessions closed by the watermark.
* ST6 ``stream_dedupe``: attempt counter, then ``dropDuplicatesWithinWatermark``
  for re-sent lines (its state is bounded by the watermark delay).
* ST7 ``stream_stale_jobs``: last checkpoint per job kept as state; stale =
  older than ``now - bound``.  ``stream_stale_alerts`` is the timer form.
* ST8 ``stream_failover``: failover gaps, emitted as soon as the next hold is known.
* ST9 ``stream_cadence_counts``: tumbling event-time windows with a
  watermark; rows later than the watermark are dropped (Spark's rule).

ST3, ST6, ST7's alerts and ST8 are processors of ``streaming.state``.

Event time columns of the driver tables are ``timestamp_ntz``; watermarks
need ``timestamp``, so streams cast (session time zone UTC).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.functions.scalar import ntz_from_micros, utc_instant
from runledger.operators import aggregate as A
from runledger.sources.ndjson import read_log
from runledger.streaming import state


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """ST1: tail NDJSON files into typed events (arrival order = ``seq`` member)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return read_log(lines, order=None)


def with_lines(lines: DataFrame) -> DataFrame:
    """Events of raw lines (``value``) that came with a position ``seq`` and a time ``ts``."""
    place = F.struct("seq", "ts").alias("_place")
    return read_log(lines.select(place, "value"), order="_place").select("_place.*", "*").drop("_place")


def stream_latest_checkpoint(events: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """ST2: latest checkpoint per job by arrival; use output mode ``update``."""
    cp = events.filter(F.col("type") == "checkpoint")
    last = cp.groupBy(key).agg(F.max_by(F.struct(seq, "epoch", "found", "state_path"), F.col(seq)).alias("c"))
    return last.select(
        key,
        F.col(f"c.{seq}").alias("last_seq"),
        F.col("c.epoch").alias("last_checkpoint_epoch"),
        F.col("c.found").alias("last_checkpoint_found"),
        F.col("c.state_path").alias("last_checkpoint_path"),
    )


def stream_replay_state(
    requests: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    to: str = "to_state",
    ts: str = "recorded_at",
    delay: str = "0 seconds",
) -> DataFrame:
    """ST3: per request its from-state and whether it was accepted (append mode).

    Requests may arrive out of order by up to the watermark ``delay``: they
    wait in state and are applied, in ``seq`` order, once the event-time watermark reaches
    them; a timer wakes their group then.  At most the requests of one delay window wait.
    A job's own state (current state, counts) stays: a terminal state must go on refusing requests.
    """
    return state.replayed(requests, key, seq, to, ts, delay)


def stream_word_count(docs: DataFrame) -> DataFrame:
    """ST4: running word count of a document stream (output mode ``update``)."""
    return A.word_count(A.tokenize(docs))


def _ntz(instant) -> F.Column:
    """timestamp -> timestamp_ntz as UTC wall clock (zone-free)."""
    return ntz_from_micros(F.unix_micros(instant))


def with_event_time(df: DataFrame, ts: str = "ts", out: str = "event_time") -> DataFrame:
    return df.withColumn(out, utc_instant(ts))


def stream_lease_sessions(
    touches: DataFrame, ttl_seconds: int, key: str = "lease_key", holder: str = "holder", ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """ST5: holds as session windows with gap = TTL, emitted once closed (append)."""
    t = with_event_time(touches, ts).withWatermark("event_time", delay)
    g = t.groupBy(key, holder, F.session_window("event_time", f"{ttl_seconds} seconds").alias("s")).agg(
        F.min(ts).alias("from_ts"), F.max(ts).alias("last_touch"), F.count(F.lit(1)).alias("touches")
    )
    return g.select(key, holder, "from_ts", "last_touch", _ntz(F.col("s.end")).alias("until_ts"), "touches")


def stream_dedupe(events: DataFrame, ts: str = "ts", delay: str = "30 days") -> DataFrame:
    """ST6: checkpoint lines with their attempt, each once however often it is sent within the watermark delay.

    Two chained stateful operators: one numbers lines by attempt, the other drops what it has
    seen of (job, attempt, epoch).
    """
    points = state.attempt_points(events, ts, delay)
    return points.dropDuplicatesWithinWatermark(["job_id", "attempt", "epoch"]).drop("event_time")


def stream_last_checkpoint_time(events: DataFrame, key: str = "job_id", ts: str = "ts") -> DataFrame:
    """ST7 state: time of each job's newest checkpoint (output mode ``update``)."""
    return events.filter(F.col("type") == "checkpoint").groupBy(key).agg(F.max(ts).alias("last_checkpoint_at"))


def stale_jobs(last: DataFrame, now, bound_seconds: int) -> DataFrame:
    """ST7 (and its batch twin): jobs whose newest checkpoint is older than now - bound."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(bound_seconds))
    return last.filter(F.col("last_checkpoint_at") < limit)


def stream_cadence_counts(events: DataFrame, every: str = "1 day", ts: str = "ts", by: str = "event_type", delay: str = "0 seconds") -> DataFrame:
    """ST9: totals per tumbling event-time window, emitted once the window closes."""
    t = with_event_time(events, ts).withWatermark("event_time", delay)
    g = t.groupBy(F.window("event_time", every).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total_value")
    )
    return g.select(
        _ntz(F.col("w.start")).alias("window_start"),
        _ntz(F.col("w.end")).alias("window_end"),
        by,
        "n",
        "total_value",
    )


def stream_stale_alerts(
    events: DataFrame, bound_seconds: int, key: str = "job_id", ts: str = "ts", delay: str = "0 seconds"
) -> DataFrame:
    """ST7 with event-time timers: one alert each time a job goes longer than
    ``bound_seconds`` (event time) without a checkpoint.

    State is the time of each running job's newest checkpoint; a timer
    wakes its group once the watermark passes ``last + bound``, which alerts and forgets the job.
    A checkpoint that arrives before its gap's timer fired raises that alert
    itself.  So every gap longer than the bound gives one alert, wherever the
    batches are cut; the last, open gap gives one when the watermark passes it.
    """
    points = events.filter(F.col("type") == "checkpoint")
    return state.stale_alerts(points, bound_seconds, key, ts, delay)


def stream_failover(
    touches: DataFrame, ttl_seconds: int, poll_seconds: float, key: str = "lease_key", holder: str = "holder", ts: str = "ts",
    delay: str = "0 seconds",
) -> DataFrame:
    """ST8: failover gaps as they happen (append mode), two chained stateful operators.

    The first, keyed by (key, holder), makes holds of touches and tells of each when it opens and when it
    closes; the second, keyed by key, pairs a closed hold with the next one.
    """
    gaps = state.hold_gaps(touches, ttl_seconds, key, holder, ts, delay)
    at = lambda c: ntz_from_micros(F.col(c))
    sla = float(ttl_seconds) + float(poll_seconds)
    gap_s = (F.col("next_from_us") - F.col("last_us")) / 1e6
    return gaps.select(
        F.col("lease_key").alias(key), F.col("holder").alias(holder), at("from_us").alias("from_ts"), at("last_us").alias("last_touch"),
        ntz_from_micros(F.col("last_us") + ttl_seconds * 1_000_000).alias("until_ts"),
        F.col("next_holder").alias("next_" + holder), at("next_from_us").alias("next_from_ts"),
        gap_s.alias("gap_s"), (gap_s <= F.lit(sla)).alias("within_sla"),
    )
