"""Reconcile / requests queries: J1 J1a A1 J2 J6 SRC5 J3 P7 P8 P9."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import reconcile as R
from runledger.operators import requests as Q
from runledger.plans import fixtures as fx
from runledger.plans.catalog import register, with_ctes
from runledger.sources.dims import registry_audit

CURRENT_PID = 1
FAULT_TS = "1996-06-30 00:00:00"

ORPHANS_SQL = (
    "select id, job_id, controller_pid, state from (select container_id as id, cast(job_id as varchar) as job_id, "
    "case when regexp_full_match(pid_label, '[+-]?[0-9]+') then cast(pid_label as bigint) else 0 end as controller_pid, state "
    "from containers) where controller_pid not in (1, 2)"
)
_LIVE = (
    "select job_id, container_id, state as container_state, pid_label "
    "from (select *, row_number() over (partition by job_id order by state <> 'running', container_id) as rn "
    "from containers) where rn = 1"
)
_ACTIONS = (
    "select j.job_id, j.state, l.container_id, "
    "case when j.state in ('running', 'checkpointing') and l.container_state = 'running' and l.pid_label <> '1' then 'reattach' "
    "when j.state in ('running', 'checkpointing') and l.container_state = 'running' then 'none' "
    "when j.state in ('running', 'checkpointing') and j.has_checkpoint then 'mark_resumable' "
    "when j.state in ('running', 'checkpointing') then 'mark_unresumable' "
    "when j.state = 'interrupted_resumable' then 'resume' else 'none' end as action "
    "from jobs j left join live l on j.job_id = l.job_id "
    "where j.state in ('running', 'checkpointing', 'pending', 'interrupted_resumable')"
)


def _ctes(body):
    return with_ctes(body, "jobs", "containers", extra={"live": _LIVE, "actions": _ACTIONS})


@register("live_container", with_ctes("select cast(job_id as varchar) as job_key, container_id, container_state, pid_label from live", "containers", extra={"live": _LIVE}))
def live_container(spark, sf_dir):
    return R.live_container(fx.containers(spark, sf_dir))


@register(
    "reconcile",
    _ctes("select job_id, state, container_id, action, action in ('resume', 'mark_resumable') as resume_scheduled from actions"),
)
def reconcile(spark, sf_dir):
    return R.reconcile(fx.jobs(spark, sf_dir), fx.containers(spark, sf_dir), CURRENT_PID)


@register(
    "reconcile_summary",
    _ctes(
        "select count(*) filter (where action = 'reattach') as reattached, "
        "count(*) filter (where action = 'mark_resumable') as marked_resumable, "
        "count(*) filter (where action = 'mark_unresumable') as marked_unresumable, "
        "count(*) filter (where action in ('resume', 'mark_resumable')) as resume_scheduled from actions"
    ),
)
def reconcile_summary(spark, sf_dir):
    return R.reconcile_summary(R.reconcile(fx.jobs(spark, sf_dir), fx.containers(spark, sf_dir), CURRENT_PID))


@register(
    "orphans",
    with_ctes(
        f"select * from ({ORPHANS_SQL})",
        "containers",
    ),
)
def orphans(spark, sf_dir):
    return R.orphans(fx.containers(spark, sf_dir), fx.alive_pids(spark))


@register(
    "fault_triage",
    with_ctes(
        "select j.job_id, j.state, c.id as checkpoint_id, c.id_part as checkpoint_id_part, c.id_supp as checkpoint_id_supp, "
        "c.recorded_at as checkpoint_at, case when c.id is not null then 'interrupted_resumable' else 'interrupted_unresumable' end as verdict "
        "from jobs j left join (select * from (select *, row_number() over (partition by job_id order by id desc, id_part desc, id_supp desc, recorded_at desc) as rn "
        f"from job_events where event_type = 'checkpoint' and recorded_at <= timestamp '{FAULT_TS}') where rn = 1) c on j.job_id = c.job_id "
        "where j.state not in ('completed', 'failed', 'cancelled', 'interrupted_unresumable')",
        "jobs",
        "job_events",
    ),
)
def fault_triage(spark, sf_dir):
    ev = fx.job_events(spark, sf_dir).filter(F.col("event_type") == "checkpoint")
    return R.fault_triage(
        fx.jobs(spark, sf_dir), ev, F.lit(FAULT_TS).cast("timestamp_ntz"), order=("id", "id_part", "id_supp")
    )


@register(
    "registry_dim",
    with_ctes(
        "select r.*, coalesce(case when trim(worker_name) = '' then 'missing_worker_name' "
        "when trim(image) = '' then 'missing_image' when trim(command) = '' then 'missing_command' end, "
        "case when line = f.first_line then 'ok' else 'duplicate_worker_name' end) as verdict "
        "from registry_rows r left join (select worker_name as n, min(line) as first_line from registry_rows "
        "where trim(worker_name) <> '' and trim(image) <> '' and trim(command) <> '' group by worker_name) f "
        "on r.worker_name = f.n",
        "registry_rows",
    ),
)
def registry_audit_q(spark, sf_dir):
    return registry_audit(fx.registry_rows(spark, sf_dir))


_REQ_COLS = "req_id, worker_name, image, command, \"limit\", seed, checkpoint_every"
_VALID = (
    "select q.*, case when q.worker_name = '' then 'primes' else q.worker_name end as resolved_worker, "
    "r.image as reg_image, r.command as reg_command, r.checkpoint_interval as reg_interval "
    "from requests q join registry r on (case when q.worker_name = '' then 'primes' else q.worker_name end) = r.worker_name"
)


@register(
    "validate_requests",
    with_ctes(f"select {_REQ_COLS}, resolved_worker, reg_image, reg_command, reg_interval from valid", "requests", "registry", extra={"valid": _VALID}),
)
def validate_requests(spark, sf_dir):
    return Q.validate_requests(fx.requests(spark, sf_dir), fx.registry(spark)).drop("args")


@register(
    "rejected_requests",
    with_ctes(
        f"select {_REQ_COLS}, resolved_worker from (select *, case when worker_name = '' then 'primes' else worker_name end as resolved_worker from requests) "
        "where resolved_worker not in (select worker_name from registry)",
        "requests",
        "registry",
    ),
)
def rejected_requests(spark, sf_dir):
    return Q.rejected_requests(fx.requests(spark, sf_dir), fx.registry(spark)).drop("args")


_RESOLVED = (
    "select req_id, resolved_worker, args, \"limit\", seed, "
    "coalesce(nullif(image, ''), nullif(reg_image, ''), 'runledger/worker:latest') as image, "
    "coalesce(nullif(command, ''), nullif(reg_command, ''), '/usr/local/bin/worker') as command, "
    "case when checkpoint_every = 0 then reg_interval else checkpoint_every end as checkpoint_every from valid"
)


@register(
    "resolve_defaults",
    with_ctes(
        "select req_id, resolved_worker, image, command, checkpoint_every from (" + _RESOLVED + ")",
        "requests", "registry", extra={"valid": _VALID},
    ),
)
def resolve_defaults(spark, sf_dir):
    v = Q.validate_requests(fx.requests(spark, sf_dir), fx.registry(spark))
    return Q.resolve_defaults(v).select("req_id", "resolved_worker", "image", "command", "checkpoint_every")


_ARGV = (
    "select req_id, ['--worker', resolved_worker] || args "
    "|| case when \"limit\" > 0 then ['--limit', cast(\"limit\" as varchar)] else []::varchar[] end "
    "|| case when checkpoint_every > 0 then ['--checkpoint-every', cast(checkpoint_every as varchar)] else []::varchar[] end "
    "|| case when seed > 0 then ['--seed', cast(seed as varchar)] else []::varchar[] end as argv from (" + _RESOLVED + ")"
)


def _argv(spark, sf_dir):
    v = Q.validate_requests(fx.requests(spark, sf_dir), fx.registry(spark))
    return Q.build_args(Q.resolve_defaults(v))


@register(
    "build_args",
    with_ctes("select req_id, cast(to_json(argv) as varchar) as args_json from (" + _ARGV + ")", "requests", "registry", extra={"valid": _VALID}),
)
def build_args(spark, sf_dir):
    return _argv(spark, sf_dir).select("req_id", Q.encode_args("argv").alias("args_json"))


STATE_FILE = "/state/job.bin"
_ARG_OR = "coalesce(case when list_position(argv, '{f}') > 0 then argv[list_position(argv, '{f}') + 1] end, {d})"


@register(
    "container_args",
    with_ctes(
        "select req_id, cast(to_json(['--worker', " + _ARG_OR.format(f="--worker", d="'primes'") + ", '--job-id', cast(req_id as varchar), "
        "'--limit', " + _ARG_OR.format(f="--limit", d="'100000'") + ", '--checkpoint-every', "
        + _ARG_OR.format(f="--checkpoint-every", d="'5000'") + f", '--output-state', '{STATE_FILE}'] "
        "|| case when " + _ARG_OR.format(f="--seed", d="''") + " <> '' then ['--seed', " + _ARG_OR.format(f="--seed", d="''") + "] else []::varchar[] end "
        f"|| case when state = 'interrupted_resumable' and has_checkpoint then ['--resume-from', '{STATE_FILE}'] else []::varchar[] end) as varchar) as args_json "
        "from (" + _ARGV + ") a join jobs j on j.job_id = a.req_id",
        "requests", "registry", "jobs", extra={"valid": _VALID},
    ),
)
def container_args(spark, sf_dir):
    """P9, second assembly: what the container of each accepted job is started with."""
    jobs = fx.jobs(spark, sf_dir).select(
        F.col("job_id").alias("req_id"), "state", F.when(F.col("has_checkpoint"), F.lit(STATE_FILE)).alias("last_checkpoint_path")
    )
    out = Q.container_args(_argv(spark, sf_dir).join(jobs, "req_id"), "req_id", STATE_FILE)
    return out.select("req_id", Q.encode_args("container_argv").alias("args_json"))


def _flag_sql(flag: str, default: str) -> str:
    pos = f"list_position(argv, '{flag}')"
    return f"coalesce(case when {pos} > 0 then argv[{pos} + 1] end, '{default}')"


@register(
    "arg_flag",
    with_ctes(
        f"select req_id, {_flag_sql('--seed', '0')} as seed, {_flag_sql('--checkpoint-every', '999')} as checkpoint_every, "
        f"{_flag_sql('--tag', 'none')} as tag from (" + _ARGV + ")",
        "requests", "registry", extra={"valid": _VALID},
    ),
)
def arg_flag_q(spark, sf_dir):
    out = Q.arg_flags(_argv(spark, sf_dir), {"--seed": "0", "--checkpoint-every": "999", "--tag": "none"})
    return out.select("req_id", "seed", "checkpoint_every", "tag")
