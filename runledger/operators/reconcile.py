"""Reconciliation of the ledger with what is really running: J1 J1a A1 J2 J6.

All joins are equi-joins on the job id (or pid) with the big side shuffled
once; the per-job choice of a live container is a hash aggregate (min_by with
map-side combine), not a window, so a job with very many containers does not
end up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.scalar import try_int
from runledger.schemas import LABEL_CONTROLLER_PID, LABEL_JOB_ID, RECOVERY_STATES, TERMINAL_STATES
from runledger.sources.dims import sized_broadcast


def live_container(containers: DataFrame, labels: str = "labels") -> DataFrame:
    """One container per job id label; a running one is preferred, ties by container id.

    Containers without a job id label are skipped.
    """
    jid = F.col(labels)[LABEL_JOB_ID]
    c = containers.withColumn("_jid", jid).filter(F.col("_jid").isNotNull() & (F.col("_jid") != ""))
    pref = F.struct((F.col("state") != "running").alias("_nr"), F.col("container_id"))
    picked = c.groupBy("_jid").agg(
        F.min_by(F.struct("container_id", "state", F.col(labels)[LABEL_CONTROLLER_PID].alias("pid_label")), pref).alias("c")
    )
    return picked.select(
        F.col("_jid").alias("job_key"),
        F.col("c.container_id").alias("container_id"),
        F.col("c.state").alias("container_state"),
        F.col("c.pid_label").alias("pid_label"),
    )


def reconcile(
    jobs: DataFrame,
    containers: DataFrame,
    current_pid: int,
    auto_resume: bool = True,
    job_id: str = "job_id",
    has_checkpoint: str = "has_checkpoint",
) -> DataFrame:
    """Action per non-terminal job.

    running/checkpointing: live running container of another pid -> reattach;
    of this pid -> none (D10); otherwise checkpoint -> mark_resumable else
    mark_unresumable.  interrupted_resumable -> resume when auto_resume.
    pending -> none.  ``resume_scheduled`` also counts freshly marked rows
    when auto_resume is on.
    """
    scan = jobs.filter(F.col("state").isin(*RECOVERY_STATES))
    live = live_container(containers)
    j = scan.join(live, F.col(job_id).cast("string") == F.col("job_key"), "left")
    running = F.col("state").isin("running", "checkpointing")
    live_run = F.col("container_id").isNotNull() & (F.col("container_state") == "running")
    own = F.coalesce(F.col("pid_label") == F.lit(str(current_pid)), F.lit(False))
    action = (
        F.when(running & live_run & ~own, "reattach")
        .when(running & live_run & own, "none")
        .when(running & F.col(has_checkpoint), "mark_resumable")
        .when(running, "mark_unresumable")
        .when(F.col("state") == "interrupted_resumable", "resume" if auto_resume else "none")
        .otherwise("none")
    )
    sched = F.when(F.lit(auto_resume) & action.isin("resume", "mark_resumable"), True).otherwise(False)
    return j.select(job_id, "state", "container_id", action.alias("action"), sched.alias("resume_scheduled"))


def reconcile_summary(actions: DataFrame) -> DataFrame:
    """A1: reattached / resumable / unresumable / resume_scheduled counts."""
    a = F.col("action")
    return actions.agg(
        F.count_if(a == "reattach").alias("reattached"),
        F.count_if(a == "mark_resumable").alias("marked_resumable"),
        F.count_if(a == "mark_unresumable").alias("marked_unresumable"),
        F.count_if(F.col("resume_scheduled")).alias("resume_scheduled"),
    )


def orphans(containers: DataFrame, alive_pids: DataFrame, labels: str = "labels") -> DataFrame:
    """Containers whose creator pid is not alive; pid <= 0 or unparsable -> orphan.

    ``alive_pids`` has one column ``pid`` (the host's process table).
    """
    pid = try_int(F.col(labels)[LABEL_CONTROLLER_PID])
    c = containers.select(
        F.col("container_id").alias("id"),
        F.col(labels)[LABEL_JOB_ID].alias("job_id"),
        pid.alias("controller_pid"),
        F.col("state"),
    )
    alive = sized_broadcast(alive_pids.select(F.col("pid").cast("bigint").alias("_pid")).filter(F.col("_pid") > 0), 1_000_000)
    return c.join(alive, c["controller_pid"] == alive["_pid"], "left_anti")


def fault_triage(
    jobs: DataFrame,
    checkpoints: DataFrame,
    fault_ts=None,
    job_id: str = "job_id",
    ts: str = "recorded_at",
    order: tuple[str, ...] = ("id",),
) -> DataFrame:
    """For each non-terminal job, its last checkpoint at or before the fault.

    A job with one becomes interrupted_resumable, else interrupted_unresumable.
    ``fault_ts=None`` means +infinity, which gives the ledger's own result (D4).
    An as-of lookup: filter, then ``max_by`` per job (hash aggregate), then a
    left join.
    """
    cp = checkpoints if fault_ts is None else checkpoints.filter(F.col(ts) <= F.lit(fault_ts))
    last = cp.groupBy(F.col(job_id).alias("_j")).agg(
        F.max_by(F.struct(*[F.col(c) for c in order], F.col(ts)), F.struct(*[F.col(c) for c in order], F.col(ts))).alias("c")
    )
    nt = jobs.filter(~F.col("state").isin(*TERMINAL_STATES))
    j = nt.join(last, nt[job_id] == last["_j"], "left")
    return j.select(
        job_id,
        "state",
        *[F.col(f"c.{c}").alias(f"checkpoint_{c}") for c in order],
        F.col(f"c.{ts}").alias("checkpoint_at"),
        F.when(F.col("c").isNotNull(), "interrupted_resumable").otherwise("interrupted_unresumable").alias("verdict"),
    )
