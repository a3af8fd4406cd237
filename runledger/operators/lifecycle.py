"""Job lifecycle over an ordered request/event log: W1 W2 W6 W7 W10 A8 A10 A11.

Guarded replay (W2) is a left fold per job: start ``pending``; a request is
applied when the move is legal, else rejected and the state is kept.  A batch
of requests is a function on the 8 states, and such functions compose
associatively.  So the fold is computed as

1. leaf: per ``(job, seq bucket)`` fold the (bounded) sorted requests into an
   8-slot table ``slot[s] = (end state, applied, rejected)`` for every start
   state ``s`` -- one Catalyst ``aggregate`` over the bucket's rows;
2. levels: group ``fanout`` neighbouring buckets of a job and compose their
   tables in order, until one table per job remains.

No group ever holds more than ``bucket_width`` rows or ``fanout`` tables, so a
job with a third of all rows is spread over many tasks.  Everything runs in
Catalyst higher-order functions; no Python per row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.functions.scalar import is_valid_transition, seconds_between, state_index
from runledger.operators import ordered
from runledger.schemas import STATES, TERMINAL_STATES, transition_matrix

BUCKET_WIDTH = 1 << 16
FANOUT = 256


def _matrix_sql() -> str:
    rows = [
        "array(" + ", ".join("true" if v else "false" for v in row) + ")"
        for row in transition_matrix()
    ]
    return "array(" + ", ".join(rows) + ")"


_IDENTITY = "transform(sequence(0, 7), i -> named_struct('e', i, 'a', 0L, 'r', 0L))"

# Fold one bucket's sorted requests (x.t = target index, -1 if unknown) into
# the 8-slot table.
_LEAF = (
    "aggregate(reqs, {ident}, (acc, x) -> transform(acc, s -> "
    "IF(x.t < 0, named_struct('e', s.e, 'a', s.a, 'r', s.r + 1L), "
    "IF({m}[s.e][x.t], named_struct('e', x.t, 'a', s.a + 1L, 'r', s.r), "
    "named_struct('e', s.e, 'a', s.a, 'r', s.r + 1L)))))"
).format(ident=_IDENTITY, m=_matrix_sql())

# Compose tables in bucket order: acc then x.fn.
_COMPOSE = (
    "aggregate(parts, {ident}, (acc, x) -> transform(acc, s -> named_struct("
    "'e', x.fn[s.e].e, 'a', s.a + x.fn[s.e].a, 'r', s.r + x.fn[s.e].r)))"
).format(ident=_IDENTITY)


def _levels(log: DataFrame, seq: str, bucket_width: int, fanout: int) -> int:
    """Composition levels needed so that the last group holds <= fanout tables."""
    row = log.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi")).first()
    if row is None or row["lo"] is None:
        return 0
    buckets = (int(row["hi"]) - int(row["lo"])) // bucket_width + 1
    if buckets <= fanout:
        return 0
    return max(0, math.ceil(math.log(buckets) / math.log(fanout)) - 1)


def transition_tables(
    log: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    to: str = "to_state",
    bucket_width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Leaf tables: one row per (key, bucket) with column ``fn``."""
    reqs = log.select(
        key,
        F.col(seq).alias("_seq"),
        state_index(to).alias("t"),
        ordered.bucket_of(seq, bucket_width).alias("b"),
    )
    return (
        reqs.groupBy(key, "b")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_seq"), F.col("t")))).alias("reqs"))
        .select(key, "b", F.expr(_LEAF).alias("fn"))
    )


def replay_state(
    log: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    to: str = "to_state",
    bucket_width: int = BUCKET_WIDTH,
    fanout: int = FANOUT,
    levels: int | None = None,
) -> DataFrame:
    """Final state, applied and rejected counts per key.

    ``seq`` must be a unique integer order within a key.
    """
    if levels is None:
        levels = _levels(log, seq, bucket_width, fanout)
    tables = transition_tables(log, key, seq, to, bucket_width)
    for _ in range(levels):
        tables = (
            tables.groupBy(key, F.floor(F.col("b") / fanout).cast("bigint").alias("pb"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("b"), F.col("fn")))).alias("parts"))
            .select(key, F.col("pb").alias("b"), F.expr(_COMPOSE).alias("fn"))
        )
    final = (
        tables.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("b"), F.col("fn")))).alias("parts"))
        .select(key, F.expr(_COMPOSE)[0].alias("slot"))
    )
    states = F.array(*[F.lit(s) for s in STATES])
    return final.select(
        key,
        F.element_at(states, F.col("slot.e") + 1).alias("final_state"),
        F.col("slot.a").alias("applied"),
        F.col("slot.r").alias("rejected"),
    )


def state_counts(final: DataFrame, state_col: str = "final_state") -> DataFrame:
    """A10: jobs per current state."""
    return final.groupBy(F.col(state_col).alias("state")).agg(F.count(F.lit(1)).alias("n_jobs"))


# ---------------------------------------------------------------------------
# Per-request replay (from-state and accepted flag of every request)
# ---------------------------------------------------------------------------
def bucket_start_states(tables: DataFrame, key: str, levels: int, fanout: int = FANOUT) -> DataFrame:
    """State index at the start of each (key, b) bucket (exclusive prefix of tables).

    A group walks at most ``fanout`` tables; the start state of a group comes
    from the same walk one level up (``levels`` more levels above this one).
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col("b"), F.col("fn")))).alias("parts")
    if levels == 0:
        groups = tables.groupBy(key).agg(parts).withColumn("start", F.lit(0))
    else:
        pb = F.floor(F.col("b") / fanout).cast("bigint").alias("pb")
        groups = tables.groupBy(key, pb).agg(parts)
        parents = groups.select(key, F.col("pb").alias("b"), F.expr(_COMPOSE).alias("fn"))
        pstart = bucket_start_states(parents, key, levels - 1, fanout).withColumnRenamed("b", "pb")
        groups = groups.join(pstart, [key, "pb"], "inner")
    walk = (
        "aggregate(parts, named_struct('cur', start, 'out', "
        "cast(array() as array<struct<b:bigint,s:int>>)), "
        "(acc, x) -> named_struct('cur', x.fn[acc.cur].e, 'out', "
        "concat(acc.out, array(named_struct('b', x.b, 's', acc.cur))))).out"
    )
    return groups.select(key, F.explode(F.expr(walk)).alias("w")).select(
        key, F.col("w.b").alias("b"), F.col("w.s").alias("start")
    )


def step_states(target: np.ndarray, first: np.ndarray, start: np.ndarray, legal: np.ndarray, carry: int = 0):
    """(state before, accepted, state after) of every request of consecutive groups.

    ``target``: index of the requested state, -1 if unknown; ``first``: where a group begins, with its state in
    ``start``; rows before the first group go on from ``carry``.  Each
    request is a function on the 8 states; a group's first row becomes
    the constant function of its start state, so one prefix
    composition over the rows (log2 of the longest group in numpy gathers) gives every
    row's state without a per-row loop.
    """
    n = len(target)
    slots = np.arange(len(legal))
    ok_t = target >= 0
    tt = np.where(ok_t, target, 0)
    # g[i, s]: state after row i when the state before it is s.
    moves = legal[slots[None, :], tt[:, None]] & ok_t[:, None]
    g = np.where(moves, tt[:, None], slots[None, :])
    g[first] = g[first, start[first]][:, None]
    longest = np.diff(np.concatenate([[0], np.flatnonzero(first), [n]])).max(initial=0)
    d = 1
    while d < longest:
        g[d:] = np.take_along_axis(g[d:], g[:-d], axis=1)
        d *= 2
    after = g[:, carry]
    before = np.empty(n, dtype=np.int64)
    before[:1] = carry
    before[1:] = after[:-1]
    before[first] = start[first]
    return before, ok_t & legal[before, tt], after


def replay_steps(
    log: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    to: str = "to_state",
    bucket_width: int = BUCKET_WIDTH,
    fanout: int = FANOUT,
) -> DataFrame:
    """Every request with the state it met (``from_state``) and ``accepted``.

    Bucket start states come from the composed tables; inside one bucket
    (at most ``bucket_width`` rows) the rows are walked in one sorted
    ``mapInPandas`` pass as a vectorised prefix composition, since Catalyst
    has no per-element scan with output.
    """
    levels = _levels(log, seq, bucket_width, fanout)
    tables = transition_tables(log, key, seq, to, bucket_width)
    starts = bucket_start_states(tables, key, levels, fanout)
    # Hash the log by (key, b) once; the join with the (small) start table
    # keeps that partitioning, so each bucket is contiguous after the sort.
    rows = (
        log.withColumn("b", ordered.bucket_of(seq, bucket_width))
        .repartition(key, "b")
        .join(starts, [key, "b"], "inner")
        .sortWithinPartitions(key, "b", seq)
    )
    legal = np.array(transition_matrix(), dtype=bool)
    index = {s: i for i, s in enumerate(STATES)}
    states = np.array(STATES, dtype=object)
    schema = T.StructType(
        rows.schema.fields
        + [T.StructField("from_state", T.StringType()), T.StructField("accepted", T.BooleanType())]
    )

    def walk(batches):
        # Rows arrive sorted by (key, b, seq); a group may span batches.
        last_group, carry = None, 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            t = pdf[to].map(index).fillna(-1).to_numpy(dtype=np.int64)
            k, b = pdf[key], pdf["b"]
            same_key = (k == k.shift()) | (k.isna() & k.shift().isna())
            first = ~(same_key & (b == b.shift())).to_numpy()
            first[0] = (k.iloc[0], b.iloc[0]) != last_group
            start = pdf["start"].to_numpy(dtype=np.int64)
            before, accepted, after = step_states(t, first, start, legal, carry)
            pdf["from_state"] = states[before]
            pdf["accepted"] = accepted
            last_group, carry = (k.iloc[-1], b.iloc[-1]), int(after[-1])
            yield pdf

    return rows.mapInPandas(walk, schema).drop("b", "start")


# ---------------------------------------------------------------------------
# Window operators on the log
# ---------------------------------------------------------------------------
def transition_pairs(
    log: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    to: str = "to_state",
    bucket_width: int = BUCKET_WIDTH,
    hot: bool | None = None,
) -> DataFrame:
    """(from, to, valid) for each consecutive pair of requested states.

    ``from`` is the previous request of the job (``pending`` for the first).
    """
    out = ordered.shifted(log.select(key, seq, to), [key], [seq], ordered.bucket_of(seq, bucket_width), [to], "prev_", hot=hot)
    frm = F.coalesce(F.col("prev_" + to), F.lit("pending"))
    return out.select(
        key, seq, frm.alias("from_state"), F.col(to).alias("to_state"), is_valid_transition(frm, F.col(to)).alias("valid")
    )


def attempts(
    wlog: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    type_col: str = "type",
    bucket_width: int = BUCKET_WIDTH,
    hot: bool | None = None,
) -> DataFrame:
    """Attempt number per row; each `started` row opens a new attempt, rows before the first are 0."""
    return ordered.running_sums(
        wlog,
        [key],
        [seq],
        ordered.bucket_of(seq, bucket_width),
        {"attempt": F.when(F.col(type_col) == "started", 1).otherwise(0).cast("bigint")},
        hot=hot,
    )


def epoch_monotonic(
    wlog: DataFrame, key: str = "job_id", seq: str = "seq", bucket_width: int = BUCKET_WIDTH, hot: bool | None = None
) -> DataFrame:
    """Flag checkpoints whose epoch does not grow inside an attempt.

    Checkpoints only: a `completed` line repeats the epoch of the final one.
    """
    if hot is None:
        hot = ordered.has_hot_key(wlog, [key])
    att = attempts(wlog, key, seq, bucket_width=bucket_width, hot=hot)
    ep = att.filter(F.col("type") == "checkpoint")
    out = ordered.shifted(ep, [key, "attempt"], [seq], ordered.bucket_of(seq, bucket_width), ["epoch"], "prev_", hot=hot)
    return out.select(
        key, seq, "attempt", "epoch", "prev_epoch",
        F.coalesce(F.col("epoch") > F.col("prev_epoch"), F.lit(True)).alias("monotonic"),
    )


# The leaf and compose steps again, with the time of the last applied entry to
# running (run) and to a terminal state (fin) in every slot.
_TERMINAL_INDEX = ", ".join(str(STATES.index(t)) for t in TERMINAL_STATES)
_TIMED_IDENTITY = (
    "transform(sequence(0, 7), i -> named_struct('e', i, 'run', cast(null as {t}), 'fin', cast(null as {t})))"
)
_TIMED_LEAF = (
    "aggregate(reqs, {ident}, (acc, x) -> transform(acc, s -> "
    "IF(x.t >= 0 AND {m}[s.e][greatest(x.t, 0)], named_struct('e', x.t, "
    "'run', IF(x.t = {running}, x.ts, s.run), 'fin', IF(x.t IN ({terminal}), x.ts, s.fin)), s)))"
)
_TIMED_COMPOSE = (
    "aggregate(parts, {ident}, (acc, x) -> transform(acc, s -> named_struct('e', x.fn[s.e].e, "
    "'run', coalesce(x.fn[s.e].run, s.run), 'fin', coalesce(x.fn[s.e].fin, s.fin))))"
)


def state_durations(
    log: DataFrame,
    key: str = "job_id",
    seq: str = "seq",
    ts: str = "recorded_at",
    to: str = "to_state",
    bucket_width: int = BUCKET_WIDTH,
    fanout: int = FANOUT,
) -> DataFrame:
    """Created (first request time), started_at = time of the last accepted
    entry to running (D11: every entry overwrites it, resumes included) and
    finished_at = time of the last accepted terminal move (terminal self moves are
    legal and overwrite it too); queue wait and runtime in seconds.  "Last" is
    by ``seq``, whatever the clock says.

    The guarded replay's slots carry the two times, so this is one aggregate
    per level and no row leaves the JVM.
    """
    kind = log.schema[ts].dataType.simpleString()
    ident = _TIMED_IDENTITY.format(t=kind)
    leaf = _TIMED_LEAF.format(ident=ident, m=_matrix_sql(), running=STATES.index("running"), terminal=_TERMINAL_INDEX)
    compose = _TIMED_COMPOSE.format(ident=ident)
    levels = _levels(log, seq, bucket_width, fanout)
    tables = (
        log.groupBy(key, ordered.bucket_of(seq, bucket_width).alias("b"))
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col(seq).alias("seq"), state_index(to).alias("t"), F.col(ts).alias("ts")))
            ).alias("reqs"),
            F.min(ts).alias("lo"),
        )
        .select(key, "b", "lo", F.expr(leaf).alias("fn"))
    )
    parts = F.array_sort(F.collect_list(F.struct("b", "fn"))).alias("parts")
    for _ in range(levels):
        tables = (
            tables.groupBy(key, F.floor(F.col("b") / fanout).cast("bigint").alias("pb"))
            .agg(parts, F.min("lo").alias("lo"))
            .select(key, F.col("pb").alias("b"), "lo", F.expr(compose).alias("fn"))
        )
    last = tables.groupBy(key).agg(parts, F.min("lo").alias("created_at")).select(key, "created_at", F.expr(compose)[0].alias("s"))
    agg = last.select(key, "created_at", F.col("s.run").alias("started_at"), F.col("s.fin").alias("finished_at"))
    secs = seconds_between
    return agg.select(
        key, "created_at", "started_at", "finished_at",
        F.round(secs("created_at", "started_at"), 6).alias("queue_wait_s"),
        F.round(secs("started_at", "finished_at"), 6).alias("run_s"),
    )


def latest_checkpoint(
    wlog: DataFrame, key: str = "job_id", seq: str = "seq", ts: str = "ts", path: str = "state_path"
) -> DataFrame:
    """Last checkpoint per job by arrival (max_by seq): at, epoch, found, path."""
    cp = wlog.filter(F.col("type") == "checkpoint")
    last = cp.groupBy(key).agg(F.max_by(F.struct(ts, "epoch", "found", path, seq), F.col(seq)).alias("c"))
    return last.select(
        key,
        F.col(f"c.{ts}").alias("last_checkpoint_at"),
        F.col("c.epoch").alias("last_checkpoint_epoch"),
        F.col("c.found").alias("last_checkpoint_found"),
        F.col(f"c.{path}").alias("last_checkpoint_path"),
        F.col(f"c.{seq}").alias("last_seq"),
    )


def exit_outcome(wlog_attempts: DataFrame, exits: DataFrame, key: str = "job_id") -> DataFrame:
    """Per run (job, attempt): completed if the exit code is 0 or a
    `completed` line was seen (D12), else failed.

    ``exits``: (key, attempt, exit_code), one row per ended process; a run
    without one counts as failed unless it said it completed.
    """
    g = wlog_attempts.groupBy(key, "attempt").agg(F.bool_or(F.col("type") == "completed").alias("saw_completed"))
    done = F.coalesce(F.col("exit_code") == 0, F.lit(False)) | F.col("saw_completed")
    return g.join(exits.select(key, "attempt", "exit_code"), [key, "attempt"], "left").select(
        key, "attempt", "exit_code", "saw_completed", F.when(done, "completed").otherwise("failed").alias("outcome")
    )


__all__ = [
    "replay_state",
    "replay_steps",
    "state_counts",
    "transition_pairs",
    "attempts",
    "epoch_monotonic",
    "state_durations",
    "latest_checkpoint",
    "exit_outcome",
    "TERMINAL_STATES",
]
