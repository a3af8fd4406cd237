"""Flag lookup, defaults and argument assembly, registry audit."""

from pyspark.sql import functions as F

from runledger.functions.scalar import arg_flag
from runledger.operators import requests as Q
from runledger.sources.dims import registry_audit


def test_arg_flag_cases(spark):
    rows = [
        (["--a", "1", "--b", "2", "--a", "3"], "--a", "none", "1"),
        (["--b", "--a"], "--b", "none", "--a"),
        (["--c", "x", "--a"], "--a", "none", "none"),
        ([], "--a", "none", "none"),
        (["--aa", "5"], "--a", "none", "none"),
    ]
    df = spark.createDataFrame(rows, "args array<string>, key string, dflt string, want string")
    got = df.select(arg_flag(F.col("args"), F.col("key"), F.col("dflt")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_defaults_and_args(spark):
    reg = spark.createDataFrame(
        [("primes", "img:reg", "/bin/reg", 5000, 2), ("beta", "", "", 10, 1)],
        "worker_name string, image string, command string, checkpoint_interval int, schema_version int",
    )
    req = spark.createDataFrame(
        [(1, "", "", "", [], 5, 0, 0), (2, "beta", "mine", "", ["-x"], 0, 3, 7), (3, "nope", "", "", [], 1, 1, 1)],
        "req_id long, worker_name string, image string, command string, args array<string>, limit long, seed long, checkpoint_every int",
    )
    ok = Q.build_args(Q.resolve_defaults(Q.validate_requests(req, reg)))
    got = {r.req_id: r for r in ok.collect()}
    assert set(got) == {1, 2}
    assert got[1].image == "img:reg" and got[1].command == "/bin/reg" and got[1].checkpoint_every == 5000
    assert got[1].argv == ["--worker", "primes", "--limit", "5", "--checkpoint-every", "5000"]
    assert got[2].image == "mine" and got[2].command == "/usr/local/bin/worker"
    assert got[2].argv == ["--worker", "beta", "-x", "--checkpoint-every", "7", "--seed", "3"]
    assert [r.req_id for r in Q.rejected_requests(req, reg).collect()] == [3]
    over = Q.resolve_defaults(Q.validate_requests(req, reg), image_override="img:ci").filter("req_id = 1").first()
    assert over.image == "img:ci"


def test_registry_audit(spark):
    rows = [
        (1, "alpha", "img", "/bin/a"),
        (2, "beta", "img", "/bin/b"),
        (3, "alpha", "img", "/bin/a2"),
        (4, "gamma", "", "/bin/g"),
        (5, "", "img", "/bin/x"),
        (6, "delta", "img", ""),
    ]
    df = spark.createDataFrame(rows, "line long, worker_name string, image string, command string")
    got = {r.line: r.verdict for r in registry_audit(df).collect()}
    assert got == {1: "ok", 2: "ok", 3: "duplicate_worker_name", 4: "missing_image", 5: "missing_worker_name", 6: "missing_command"}


def test_sleep_flag_only_when_positive(spark):
    df = spark.createDataFrame(
        [(1, "primes", [], 0, 0, 0, 250), (2, "primes", [], 0, 0, 0, 0)],
        "req_id long, resolved_worker string, args array<string>, limit long, seed long, checkpoint_every int, sleep_per_checkpoint_ms int",
    )
    got = {r.req_id: r.argv for r in Q.build_args(df).collect()}
    assert got == {1: ["--worker", "primes", "--sleep-per-checkpoint-ms", "250"], 2: ["--worker", "primes"]}


def test_sized_broadcast_only_under_bound(spark):
    from runledger.sources.dims import literal_frame, sized_broadcast
    from pyspark.sql import types as T

    small = literal_frame(spark, [(1,), (2,)], T.StructType([T.StructField("pid", T.IntegerType())]))
    big = spark.range(0, 50).withColumnRenamed("id", "pid")
    probe = spark.range(0, 1000).withColumnRenamed("id", "pid")
    plan_small = probe.join(sized_broadcast(small, 10), "pid")._jdf.queryExecution().optimizedPlan().toString()
    plan_big = probe.join(sized_broadcast(big, 10), "pid")._jdf.queryExecution().optimizedPlan().toString()
    assert "BROADCAST" in plan_small.upper() and "broadcast" not in plan_big.lower()


def test_container_args(spark):
    rows = [
        (1, ["--worker", "w", "--limit", "9", "--seed", "4"], "running", "/p"),
        (2, [], "interrupted_resumable", "/p"),
        (3, ["--seed"], "interrupted_resumable", None),
    ]
    df = spark.createDataFrame(rows, "id long, argv array<string>, state string, last_checkpoint_path string")
    got = {r.id: r.container_argv for r in Q.container_args(df, "id", "/s.bin").collect()}
    fixed = ["--checkpoint-every", "5000", "--output-state", "/s.bin"]
    assert got[1] == ["--worker", "w", "--job-id", "1", "--limit", "9", *fixed, "--seed", "4"]
    assert got[2] == ["--worker", "primes", "--job-id", "2", "--limit", "100000", *fixed, "--resume-from", "/s.bin"]
    assert got[3] == ["--worker", "primes", "--job-id", "3", "--limit", "100000", *fixed]
