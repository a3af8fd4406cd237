"""Lifecycle queries: W1 W2 W6 W7 W10 A8 A10 A11 over job_log / worker_log."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import lifecycle as L
from runledger.plans import fixtures as fx
from runledger.plans.catalog import register, with_ctes
from runledger.plans.oracle_sql import REPLAY_WALK, TERMINAL_LIST, valid_sql

_REPLAY_FINAL = (
    "final as (select job_id, st as final_state, applied, rejected from walk "
    "where (job_id, rn) in (select job_id, max(rn) from req group by job_id))"
)


@register(
    "replay_state",
    with_ctes(
        "select job_id, final_state, applied, rejected from final",
        "job_log",
        recursive=True,
        raw=(REPLAY_WALK.strip() + ",\n" + _REPLAY_FINAL,),
    ),
)
def replay_state(spark, sf_dir):
    return L.replay_state(fx.job_log(spark, sf_dir))


@register(
    "state_counts",
    with_ctes(
        "select final_state as state, count(*) as n_jobs from final group by final_state",
        "job_log",
        recursive=True,
        raw=(REPLAY_WALK.strip() + ",\n" + _REPLAY_FINAL,),
    ),
)
def state_counts(spark, sf_dir):
    return L.state_counts(L.replay_state(fx.job_log(spark, sf_dir)))


@register(
    "replay_steps",
    with_ctes(
        "select job_id, seq, recorded_at, to_state, found, from_state, accepted from walk "
        "join (select job_id, seq, found from job_log) j using (job_id, seq) where rn > 0",
        "job_log",
        recursive=True,
        raw=(REPLAY_WALK.strip(),),
    ),
)
def replay_steps(spark, sf_dir):
    return L.replay_steps(fx.job_log(spark, sf_dir))


@register(
    "transition_pairs",
    with_ctes(
        "select job_id, seq, from_state, to_state, "
        + valid_sql("from_state", "to_state")
        + " as valid from (select job_id, seq, to_state, coalesce(lag(to_state) over "
        "(partition by job_id order by seq), 'pending') as from_state from job_log)",
        "job_log",
    ),
)
def transition_pairs(spark, sf_dir):
    return L.transition_pairs(fx.job_log(spark, sf_dir))


_ATTEMPTS = (
    "attempts as (select *, cast(sum(case when type = 'started' then 1 else 0 end) over "
    "(partition by job_id order by seq rows between unbounded preceding and current row) as bigint) "
    "as attempt from worker_log)"
)


@register(
    "attempts",
    with_ctes("select * from attempts", "worker_log", raw=(_ATTEMPTS,)),
)
def attempts(spark, sf_dir):
    return L.attempts(fx.worker_log(spark, sf_dir))


@register(
    "epoch_monotonic",
    with_ctes(
        "select job_id, seq, attempt, epoch, prev_epoch, coalesce(epoch > prev_epoch, true) as monotonic "
        "from (select *, lag(epoch) over (partition by job_id, attempt order by seq) as prev_epoch "
        "from attempts where type = 'checkpoint')",
        "worker_log",
        raw=(_ATTEMPTS,),
    ),
)
def epoch_monotonic(spark, sf_dir):
    return L.epoch_monotonic(fx.worker_log(spark, sf_dir))


@register(
    "state_durations",
    with_ctes(
        f"""select job_id, created_at, started_at, finished_at,
               round((epoch_us(started_at) - epoch_us(created_at)) / 1e6, 6) as queue_wait_s,
               round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 6) as run_s
        from (select job_id, min(recorded_at) as created_at,
                     arg_max(recorded_at, seq) filter (where accepted and to_state = 'running') as started_at,
                     arg_max(recorded_at, seq) filter (where accepted and to_state in {TERMINAL_LIST}) as finished_at
              from walk where rn > 0 group by job_id)""",
        "job_log",
        recursive=True,
        raw=(REPLAY_WALK.strip(),),
    ),
)
def state_durations(spark, sf_dir):
    return L.state_durations(fx.job_log(spark, sf_dir))


_PATH = "'/state/' || job_id || '-' || cast(epoch as varchar) || '.bin'"


@register(
    "latest_checkpoint",
    with_ctes(
        "select job_id, arg_max(ts, seq) as last_checkpoint_at, arg_max(epoch, seq) as last_checkpoint_epoch, "
        f"arg_max(found, seq) as last_checkpoint_found, arg_max({_PATH}, seq) as last_checkpoint_path, max(seq) as last_seq "
        "from worker_log where type = 'checkpoint' group by job_id",
        "worker_log",
    ),
)
def latest_checkpoint(spark, sf_dir):
    path = F.concat(F.lit("/state/"), F.col("job_id"), F.lit("-"), F.col("epoch").cast("string"), F.lit(".bin"))
    return L.latest_checkpoint(fx.worker_log(spark, sf_dir).withColumn("state_path", path))


@register(
    "exit_outcome",
    with_ctes(
        "select job_id, attempt, exit_code, saw_completed, "
        "case when exit_code = 0 or saw_completed then 'completed' else 'failed' end as outcome "
        "from (select job_id, attempt, case when max(seq) % 4 < 3 then max(seq) % 4 end as exit_code, "
        "bool_or(type = 'completed') as saw_completed from attempts group by job_id, attempt)",
        "worker_log",
        raw=(_ATTEMPTS,),
    ),
)
def exit_outcome(spark, sf_dir):
    """Exit codes 0, 1, 2 from the run's last line; every fourth run has none yet."""
    runs = L.attempts(fx.worker_log(spark, sf_dir))
    code = F.max("seq") % 4
    exits = runs.groupBy("job_id", "attempt").agg(code.alias("exit_code")).filter("exit_code < 3")
    return L.exit_outcome(runs, exits)
