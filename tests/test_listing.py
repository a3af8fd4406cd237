"""Paging (3/3/1, no id twice, faithful tie skip), limits, lookups, redaction."""

import datetime as dt

from pyspark.sql import functions as F

from runledger.operators import listing as LS


def _jobs(spark, created_ns):
    rows = [(f"{chr(ord('a') + i)}0", dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=c // 1000), "pending") for i, c in enumerate(created_ns)]
    return spark.createDataFrame(rows, "job_id string, created_at timestamp_ntz, state string")


def test_pages_3_3_1(spark):
    jobs = _jobs(spark, [1_000_000_000 + i * 1_000_000 for i in range(7)])
    pages = LS.walk_pages(jobs, 3)
    sizes = [p.count() for p in pages]
    assert sizes == [3, 3, 1]
    ids = LS.page_union([p.select("job_id", "created_at", "state") for p in pages]).collect()
    assert len(ids) == 7 and all(r.n_seen == 1 for r in ids)
    assert LS.page_violations(LS.page_union([p.select("job_id") for p in pages]), jobs).count() == 0
    twice = LS.page_union([p.select("job_id") for p in [*pages[:2], pages[0]]])
    bad = {r.job_id: r.n_seen for r in LS.page_violations(twice, jobs).collect()}
    assert bad == {"g0": 2, "f0": 2, "e0": 2, "a0": 0}
    whole = {r.job_id: (r.page_no, r.page_rank) for r in LS.numbered_pages(jobs.withColumn("job_id", F.ascii("job_id")), 3).collect()}
    assert whole[ord("g")] == (1, 1) and whole[ord("a")] == (3, 1) and len(whole) == 7
    first = [r.job_id for r in pages[0].orderBy("page_rank").collect()]
    assert first == ["g0", "f0", "e0"]


def test_faithful_mode_skips_ties(spark):
    # Four rows share one created_at; strict seek on created_at skips the tie partners.
    jobs = _jobs(spark, [1, 2, 2, 2, 2, 3])
    default = LS.walk_pages(jobs, 2)
    faithful = LS.walk_pages(jobs, 2, faithful=True)
    assert sum(p.count() for p in default) == 6
    assert sum(p.count() for p in faithful) < 6


def test_unknown_cursor_gives_empty_page(spark):
    jobs = _jobs(spark, [1, 2, 3])
    assert LS.jobs_page(jobs, 2, cursor="zz", faithful=True).count() == 0
    assert LS.jobs_page(jobs, 2, cursor="zz").count() == 0


def test_clamp_limit():
    assert LS.clamp_limit(0, 50) == 50
    assert LS.clamp_limit(201, 25) == 25
    assert LS.clamp_limit(-3, 25) == 25
    assert LS.clamp_limit(200, 25) == 200


def test_jobs_in_states_empty_list(spark):
    jobs = _jobs(spark, [1, 2])
    assert LS.jobs_in_states(jobs, []).count() == 0


def test_recovery_scan_states(spark):
    rows = [("a", "running"), ("b", "checkpointing"), ("c", "completed"), ("d", "pending")]
    df = spark.createDataFrame(rows, "id string, state string").withColumn("created_at", F.lit(1))
    got = {r.id for r in LS.jobs_in_states(df, ["running", "checkpointing"]).collect()}
    assert got == {"a", "b"}


def test_recent_events_newest_first_and_clamped(spark):
    ev = spark.createDataFrame([(i, "j1") for i in range(1, 5)] + [(10, "j2")], "id long, job_id string")
    got = LS.recent_events(ev, 2).filter("job_id = 'j1'").orderBy("event_rank").collect()
    assert [r.id for r in got] == [4, 3]
    assert LS.recent_events(ev, 0).filter("job_id = 'j1'").count() == 4


def test_redact_updates(spark):
    df = spark.createDataFrame([({"state": "running", "controller_pid": "9", "exit_code": "0", "secret": "x"},)], "m map<string,string>")
    got = df.select(LS.redact_updates(F.col("m")).alias("r")).collect()[0].r
    assert got == {"state": "running", "exit_code": "0"}


def test_state_filter_and_lookup_miss(spark):
    jobs = _jobs(spark, [1, 2, 3]).withColumn("state", F.when(F.col("job_id") == "a0", "running").otherwise("pending"))
    assert LS.jobs_by_state(jobs, None).count() == 3
    assert LS.jobs_by_state(jobs, "").count() == 3
    assert [r.job_id for r in LS.jobs_by_state(jobs, "running").collect()] == ["a0"]
    assert LS.job_lookup(jobs, "nope", id_col="job_id").count() == 0
    assert LS.job_lookup(jobs, "b0", id_col="job_id").count() == 1


def test_job_detail_nests_the_newest_events(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    ev = spark.createDataFrame([("a", i, f"e{i}") for i in range(30)], "job_id string, id long, event_type string")
    got = {r.job_id: [(e.id, e.event_type) for e in r.events] for r in LS.job_detail(jobs, ev).collect()}
    assert got == {"a": [(i, f"e{i}") for i in range(29, 4, -1)], "b": []}
