"""Reconcile decisions (incl. D10), orphans, fault triage (D4), outcome."""

import datetime as dt

from pyspark.sql import functions as F

from runledger.operators import lifecycle as L
from runledger.operators import reconcile as R
from runledger.schemas import LABEL_CONTROLLER_PID, LABEL_JOB_ID


def _containers(spark, rows):
    data = [(cid, st, {LABEL_JOB_ID: jid, LABEL_CONTROLLER_PID: pid} if pid is not None else {LABEL_JOB_ID: jid}) for cid, jid, st, pid in rows]
    return spark.createDataFrame(data, "container_id string, state string, labels map<string,string>")


def test_reconcile_actions(spark):
    jobs = spark.createDataFrame(
        [
            ("r1", "running", True),
            ("r2", "running", False),
            ("r3", "checkpointing", True),
            ("r4", "running", True),
            ("p1", "pending", False),
            ("i1", "interrupted_resumable", True),
            ("c1", "completed", True),
        ],
        "job_id string, state string, has_checkpoint boolean",
    )
    cont = _containers(
        spark,
        [
            ("x1", "r1", "running", "99"),
            ("x2", "r1", "exited", "99"),
            ("x3", "r3", "running", "1"),
            ("x4", "r4", "exited", "7"),
        ],
    )
    got = {r.job_id: (r.action, r.resume_scheduled) for r in R.reconcile(jobs, cont, current_pid=1).collect()}
    assert got == {
        "r1": ("reattach", False),
        "r2": ("mark_unresumable", False),
        "r3": ("none", False),  # own pid, still running: nothing (D10)
        "r4": ("mark_resumable", True),
        "p1": ("none", False),
        "i1": ("resume", True),
    }
    s = R.reconcile_summary(R.reconcile(jobs, cont, current_pid=1)).collect()[0]
    assert (s.reattached, s.marked_resumable, s.marked_unresumable, s.resume_scheduled) == (1, 1, 1, 2)
    s2 = R.reconcile_summary(R.reconcile(jobs, cont, current_pid=1, auto_resume=False)).collect()[0]
    assert s2.resume_scheduled == 0


def test_live_container_prefers_running(spark):
    cont = _containers(spark, [("b", "j", "exited", "1"), ("c", "j", "running", "1"), ("a", "j", "exited", "1"), ("z", "", "running", "1")])
    got = R.live_container(cont).collect()
    assert [(r.job_key, r.container_id) for r in got] == [("j", "c")]


def test_orphans(spark):
    pids = {"a": "1", "b": "0", "c": "abc", "d": "5", "e": None, "f": " 2 ", "g": "3000000000", "h": "-1", "i": "+2", "j": "4294967297"}
    cont = _containers(spark, [(k, "j" + k, "running", v) for k, v in pids.items()])
    alive = spark.createDataFrame([(1,), (2,), (4294967297,)], "pid long")
    got = {r.id: r.controller_pid for r in R.orphans(cont, alive).collect()}
    assert got == {"b": 0, "c": 0, "d": 5, "e": 0, "f": 0, "g": 3000000000, "h": -1}


def test_fault_triage(spark):
    t0 = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([("a", "running"), ("b", "running"), ("c", "completed")], "job_id string, state string")
    cps = spark.createDataFrame([(1, "a", t0), (2, "b", t0 + dt.timedelta(hours=5))], "id long, job_id string, recorded_at timestamp_ntz")
    at = F.lit(t0 + dt.timedelta(hours=1)).cast("timestamp_ntz")
    got = {r.job_id: r.verdict for r in R.fault_triage(jobs, cps, at).collect()}
    assert got == {"a": "interrupted_resumable", "b": "interrupted_unresumable"}
    inf = {r.job_id: r.verdict for r in R.fault_triage(jobs, cps).collect()}
    assert inf == {"a": "interrupted_resumable", "b": "interrupted_resumable"}


def test_exit_outcome(spark):
    rows = [("j", 1, "started"), ("j", 2, "completed"), ("k", 3, "started"), ("k", 4, "checkpoint"), ("k", 5, "started"), ("l", 6, "started")]
    wl = spark.createDataFrame(rows, "job_id string, seq long, type string")
    exits = spark.createDataFrame([("j", 1, 137), ("k", 1, 0), ("k", 2, 2)], "job_id string, attempt long, exit_code int")
    got = {(r.job_id, r.attempt): (r.exit_code, r.outcome) for r in L.exit_outcome(L.attempts(wl), exits).collect()}
    assert got == {("j", 1): (137, "completed"), ("k", 1): (0, "completed"), ("k", 2): (2, "failed"), ("l", 1): (None, "failed")}


def test_run_identity_deals_documents_by_their_text(spark):
    from runledger.plans.q_audit import _by_document

    docs = spark.range(300).selectExpr("id as doc_id", "repeat('word ', 100) as text")
    parts = _by_document(docs, 5_000)
    assert parts.rdd.getNumPartitions() == 30  # 150,000 bytes
    assert max(parts.rdd.glom().map(len).collect()) < 30
    assert _by_document(docs).rdd.getNumPartitions() == 7 and _by_document(docs.limit(0)).rdd.getNumPartitions() == 7


def test_run_identity_is_a_multiset_difference(spark):
    from runledger.operators.audit import run_diff, run_identity, run_identity_diff

    a = spark.createDataFrame([("x", 1)] * 4 + [("y", 2), (None, 3)], "w string, n long")
    b = spark.createDataFrame([("x", 1), ("z", 5), (None, 3)], "w string, n long")
    got = sorted(tuple(r) for r in run_identity_diff(a, b).collect())
    assert got == [("x", 1, "only_a", 3), ("y", 2, "only_a", 1), ("z", 5, "only_b", 1)]
    assert [tuple(r) for r in run_identity(a, b).collect()] == [(4, 1, False)]
    assert [tuple(r) for r in run_identity(a, a).collect()] == [(0, 0, True)]
    d = {r.w: r.diff for r in run_diff(a.dropDuplicates(), b.withColumn("n", F.col("n") + 0), ["w"], ["n"]).collect()}
    assert d == {"y": "only_left", "z": "only_right"}
