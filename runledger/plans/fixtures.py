"""Derived relations on the driver's tables (FIXTURES.md part B).

Each relation has a Spark builder and the same definition as DuckDB SQL
(`SQL[name]`), so a query and its oracle start from one definition.  All
builders are lazy projections/filters of the base tables: Catalyst prunes
columns and pushes filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.functions.scalar import epoch_micros
from runledger.schemas import LABEL_CONTROLLER_PID, LABEL_CREATED_AT, LABEL_JOB_ID
from runledger.sources import blobs as B
from runledger.sources.tables import table

# ---------------------------------------------------------------------------
# FIXED VALUES: registry rows used with the derived request table, and the
# label keys of worker containers.
# ---------------------------------------------------------------------------
REGISTRY_ROWS = [
    ("primes", "runledger/worker:latest", "/usr/local/bin/worker", 5000, 2),
    ("matmul", "runledger/worker:latest", "/usr/local/bin/worker", 1000, 1),
    ("wordcount", "runledger/worker:latest", "/usr/local/bin/worker", 1000, 1),
    ("1-URGENT", "runledger/worker:urgent", "/usr/local/bin/worker", 500, 1),
    ("2-HIGH", "", "", 0, 1),
]
LEASE_TTL_SECONDS = 24 * 3600
CADENCE_K = 10
# ---------------------------------------------------------------------------


def _registry_values_sql() -> str:
    rows = ", ".join(
        f"('{n}', '{i}', '{c}', {iv}, {v})" for n, i, c, iv, v in REGISTRY_ROWS
    )
    return (
        "select * from (values " + rows + ") "
        "as r(worker_name, image, command, checkpoint_interval, schema_version)"
    )


def _state_case(col: str) -> str:
    return (
        f"case {col} when 'signup' then 'pending' when 'view' then 'running' "
        "when 'click' then 'checkpointing' when 'purchase' then 'completed' "
        "when 'error' then 'interrupted_resumable' end"
    )


def _worker_type_case(col: str) -> str:
    return (
        f"case {col} when 'signup' then 'started' when 'click' then 'checkpoint' "
        "when 'view' then 'checkpoint' when 'purchase' then 'completed' "
        "when 'error' then 'failed' end"
    )


def _jobs_state_sql() -> str:
    return (
        "case when o_orderstatus = 'P' then case when o_orderpriority < '3' then 'pending' else 'running' end "
        "when o_orderstatus = 'O' then case when o_orderpriority < '3' then 'checkpointing' else 'interrupted_resumable' end "
        "else case when o_orderpriority < '3' then 'completed' when o_orderpriority < '5' then 'failed' else 'cancelled' end end"
    )


# DuckDB definitions of the derived relations (valid DuckDB SQL).
SQL: dict[str, str] = {
    "job_log": f"""
        select cast(user_id as varchar) || '-' || strftime(ts, '%Y%m%d') as job_id,
               event_id as seq, ts as recorded_at,
               {_state_case('event_type')} as to_state,
               cast(json_extract(props, '$.k') as bigint) as found
        from events""",
    "worker_log": f"""
        select cast(user_id as varchar) as job_id, event_id as seq, ts,
               {_worker_type_case('event_type')} as type,
               cast(json_extract(props, '$.k') as bigint) as epoch,
               cast(json_extract(props, '$.k') as bigint) as found
        from events""",
    "runs": """
        select event_id as run_id, 'u' || cast(user_id % 3 as varchar) as worker,
               value as latency_ms, event_type = 'error' as err,
               cast(ts as date) as day, ts
        from events""",
    "jobs": f"""
        select o_orderkey as job_id, o_orderdate as created_at,
               {_jobs_state_sql()} as state,
               o_orderkey % 3 <> 0 as has_checkpoint
        from orders""",
    "containers": f"""
        select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as container_id,
               l_orderkey as job_id,
               case when l_linestatus = 'O' then 'running' else 'exited' end as state,
               l_suppkey % 5 as controller_pid,
               case l_linenumber when 7 then ' ' || cast(l_suppkey % 5 as varchar)
                    when 5 then cast(l_suppkey % 5 + 4294967296 as varchar)
                    else cast(l_suppkey % 5 as varchar) end as pid_label,
               l_linenumber
        from lineitem""",
    "requests": """
        select o_orderkey as req_id,
               case when o_orderpriority = '5-LOW' then '' else o_orderpriority end as worker_name,
               case when o_orderkey % 5 = 0 then 'custom/image:' || cast(o_orderkey % 7 as varchar) else '' end as image,
               case when o_orderkey % 11 = 0 then '/bin/custom' else '' end as command,
               case when o_orderkey % 2 = 0 then ['--tag', o_orderstatus] else []::varchar[] end as args,
               o_custkey as "limit",
               o_orderkey % 4 as seed,
               cast(o_orderkey % 3 * 1000 as integer) as checkpoint_every
        from orders""",
    "registry": _registry_values_sql(),
    "lease_touches": """
        select event_type as lease_key, user_id as holder, ts, value, event_id as seq
        from events""",
    "tokens": r"""
        select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as word
        from documents""",
    "matrix": """
        select l_suppkey as i, l_partkey as k, cast(sum(l_quantity) as bigint) as v
        from lineitem group by l_suppkey, l_partkey""",
    "ordered_hits": """
        select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey,
               l_returnflag = 'R' as hit
        from lineitem""",
    "job_events": """
        select l_orderkey * 8 + l_linenumber as id, l_partkey as id_part, l_suppkey as id_supp,
               l_orderkey as job_id,
               case when l_linenumber = 1 then 'created'
                    when l_returnflag = 'R' then 'checkpoint' else 'transition' end as event_type,
               l_shipdate as recorded_at,
               l_linenumber, l_quantity, l_linestatus, l_suppkey
        from lineitem""",
}
SQL["lease_starts"] = """
        select event_id as seq, event_type as lease_key, user_id as starter, ts
        from events"""
SQL["lease_ops"] = """
        select 'k' || cast(user_id % 20 as varchar) as lease_key, user_id % 3 as holder, ts, event_id as seq,
               case event_type when 'signup' then 'acquire' when 'error' then 'acquire'
                    when 'purchase' then 'release' else 'refresh' end as op
        from events"""
SQL["registry_rows"] = """
        select p_partkey as line,
               case when p_size % 17 = 0 then '' else p_brand end as worker_name,
               case when p_size % 10 = 0 then '' else 'img/' || replace(lower(p_type), ' ', '-') end as image,
               case when p_size % 13 = 0 then '' else '/usr/local/bin/' || lower(p_brand) end as command,
               p_size * 100 as checkpoint_interval, 1 as schema_version
        from part"""
SQL["ledger_rows"] = f"""
        select cast(o_orderkey as varchar) as id, 'runledger/worker:latest' as image,
               '/usr/local/bin/worker' as command,
               to_json(['--worker', o_orderpriority, '--limit', cast(o_custkey as varchar)]) as args_json,
               state, ns as created_at,
               case when state <> 'pending' then ns + 3600000000000 end as started_at,
               case when state in ('completed', 'failed', 'cancelled') then ns + 7200000000000 end as finished_at,
               case when state = 'completed' then 0 when state = 'failed' then 1 end::bigint as exit_code,
               case when has_checkpoint then ns + 1800000000000 end as last_checkpoint_at,
               case when has_checkpoint then '/state/' || cast(o_orderkey as varchar) || '.bin' end as last_checkpoint_path,
               case when has_checkpoint then o_orderkey % 10 end as last_checkpoint_epoch,
               case when has_checkpoint then cast(floor(o_totalprice) as bigint) end as last_checkpoint_found,
               null::varchar as container_id, null::bigint as controller_pid,
               null::varchar as state_volume_path, null::varchar as assigned_controller_id
        from (select *, epoch_us(o_orderdate) * 1000 as ns, {_jobs_state_sql()} as state,
                     o_orderkey % 3 <> 0 as has_checkpoint from orders)"""


# ---------------------------------------------------------------------------
# Spark builders
# ---------------------------------------------------------------------------
def _state_case_col(col: str):
    c = F.col(col)
    return (
        F.when(c == "signup", "pending")
        .when(c == "view", "running")
        .when(c == "click", "checkpointing")
        .when(c == "purchase", "completed")
        .when(c == "error", "interrupted_resumable")
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per user and day; seq = event_id is the total order."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").alias("recorded_at"),
        _state_case_col("event_type").alias("to_state"),
        F.get_json_object("props", "$.k").cast("bigint").alias("found"),
    )


def worker_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed worker output, one job per user."""
    ev = table(spark, sf_dir, "events")
    t = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.when(t == "signup", "started")
        .when(t.isin("click", "view"), "checkpoint")
        .when(t == "purchase", "completed")
        .when(t == "error", "failed")
        .alias("type"),
        k.alias("epoch"),
        k.alias("found"),
    )


def worker_lines(spark: SparkSession, sf_dir: str, embed_seq: bool = False) -> DataFrame:
    """worker_log as NDJSON text (`value`) plus its arrival order (`seq`).

    Every tenth event becomes a junk line that a reader skips: a comment, a
    cut object, a blank line, a wrong type, single quotes, trailing text, a
    fraction, an epoch beyond 64 bits or a found of 2^64; so the surviving set is known (event_id % 10 <> 0).
    Lines carry white space of several kinds at both ends, every 13th `found` is an
    unsigned value above 2^63, and every 11th line repeats members, the last of which counts.
    """
    seq = F.col("seq")
    wl = worker_log(spark, sf_dir).withColumn("found", u64_found())
    payload = F.to_json(
        F.struct(
            *([F.col("seq")] if embed_seq else []),
            F.col("type"),
            F.col("job_id"),
            F.col("epoch"),
            F.col("found"),
            F.concat(F.lit("/state/"), F.col("job_id"), F.lit(".bin")).alias("state_path"),
        )
    )
    point = F.concat(F.lit('{"type":"checkpoint","job_id":"'), F.col("job_id"), F.lit('","epoch":'))
    k = F.floor(seq / 10) % 9
    junk = (
        F.when(k == 0, F.concat(F.lit("# junk "), seq.cast("string")))
        .when(k == 1, F.expr("substring(to_json(named_struct('type', type, 'job_id', job_id)), 1, 12)"))
        .when(k == 2, F.lit(" \t "))
        .when(k == 3, F.concat(point, F.lit('"x"}')))
        .when(k == 4, F.translate(payload, '"', "'"))
        .when(k == 5, F.concat(payload, F.lit(" done")))
        .when(k == 6, F.concat(point, F.lit('1,"found":1.5}')))
        .when(k == 7, F.concat(point, F.lit('99999999999999999999}')))
        .otherwise(F.concat(point, F.lit('1,"found":18446744073709551616}')))
    )
    twice = F.concat(F.lit('{"job_id":"none","found":0,"type":"completed",'), F.substr(payload, F.lit(2)))
    payload = F.when(seq % 11 == 0, twice).otherwise(payload)
    before = F.element_at(F.array(F.lit("  "), F.lit("\t"), F.lit("")), (seq % 3 + 1).cast("int"))
    after = F.when(seq % 4 == 0, "\t ").otherwise("")
    return wl.select(seq, F.when(seq % 10 == 0, junk).otherwise(F.concat(before, payload, after)).alias("value"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """worker_log as text lines with position and time; a checkpoint's ``epoch`` is the worker's own count,
    which begins at 1 in every run of the worker (behind each ``started`` line)."""
    log = worker_log(spark, sf_dir)
    by = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started, point = (F.when(F.col("type") == t, 1).otherwise(0) for t in ("started", "checkpoint"))
    run = log.withColumn("_run", F.sum(started).over(by))
    printed = F.sum(point).over(Window.partitionBy("job_id", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = run.withColumn("epoch", F.when(F.col("type") == "checkpoint", printed))
    return numbered.select("seq", "ts", F.to_json(F.struct("type", "job_id", "epoch", "found")).alias("value"))


def u64_found():
    """`found` with every 13th value mirrored to the top of the unsigned 64-bit range."""
    found = F.col("found").cast("decimal(20,0)")
    top = (F.lit("18446744073709551615").cast("decimal(20,0)") - found).cast("decimal(20,0)")
    return F.when(F.col("seq") % 13 == 0, top).otherwise(found)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("worker"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("err"),
        F.to_date("ts").alias("day"),
        F.col("ts"),
    )


def _jobs_state_col():
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    return (
        F.when(st == "P", F.when(pr < "3", "pending").otherwise("running"))
        .when(st == "O", F.when(pr < "3", "checkpointing").otherwise("interrupted_resumable"))
        .otherwise(F.when(pr < "3", "completed").when(pr < "5", "failed").otherwise("cancelled"))
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderdate").alias("created_at"),
        _jobs_state_col().alias("state"),
        (F.col("o_orderkey") % 3 != 0).alias("has_checkpoint"),
    )


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container listing with a label map; some pid labels are padded, some beyond 32 bits."""
    li = table(spark, sf_dir, "lineitem")
    df = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("container_id"),
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_linestatus") == "O", "running").otherwise("exited").alias("state"),
        (F.col("l_suppkey") % 5).alias("controller_pid"),
        F.col("l_linenumber"),
    )
    pid = F.col("controller_pid")
    pid_label = (
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit(" "), pid.cast("string")))
        .when(F.col("l_linenumber") == 5, (pid.cast("bigint") + 4294967296).cast("string"))
        .otherwise(pid.cast("string"))
    )
    labels = F.map_concat(
        F.create_map(
            F.lit(LABEL_JOB_ID), F.col("job_id").cast("string"),
            F.lit(LABEL_CONTROLLER_PID), pid_label,
        ),
        F.when(
            F.col("l_linenumber") % 2 == 1,
            F.create_map(F.lit(LABEL_CREATED_AT), F.col("l_linenumber").cast("string")),
        ).otherwise(F.create_map().cast("map<string,string>")),
    )
    return df.withColumn("labels", labels)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("req_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("worker_name"),
        F.when(k % 5 == 0, F.concat(F.lit("custom/image:"), (k % 7).cast("string"))).otherwise("").alias("image"),
        F.when(k % 11 == 0, "/bin/custom").otherwise("").alias("command"),
        F.when(k % 2 == 0, F.array(F.lit("--tag"), F.col("o_orderstatus")))
        .otherwise(F.array().cast("array<string>"))
        .alias("args"),
        F.col("o_custkey").alias("limit"),
        (k % 4).alias("seed"),
        ((k % 3) * 1000).cast("int").alias("checkpoint_every"),
    )


def registry(spark: SparkSession) -> DataFrame:
    from runledger.schemas import REGISTRY_SCHEMA
    from runledger.sources.dims import literal_frame

    return literal_frame(spark, REGISTRY_ROWS, REGISTRY_SCHEMA)


def lease_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("lease_key"),
        F.col("user_id").alias("holder"),
        F.col("ts"),
        F.col("value"),
        F.col("event_id").alias("seq"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from runledger.operators.aggregate import tokenize

    return tokenize(table(spark, sf_dir, "documents"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k")).agg(
        F.sum("l_quantity").cast("bigint").alias("v")
    )


def ordered_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        (F.col("l_returnflag") == "R").alias("hit"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only event log keyed like `jobs` (job_id = order key).

    The payload is JSON text, as the ledger stores it.  Line numbers repeat
    inside an order in the driver's data, so the total order of the log is
    ``(id, id_part, id_supp)``.
    """
    li = table(spark, sf_dir, "lineitem")
    etype = (
        F.when(F.col("l_linenumber") == 1, "created")
        .when(F.col("l_returnflag") == "R", "checkpoint")
        .otherwise("transition")
    )
    payload = (
        F.when(etype == "created", F.to_json(F.struct(F.lit("pending").alias("state"))))
        .when(
            etype == "checkpoint",
            F.to_json(
                F.struct(
                    F.col("l_linenumber").cast("bigint").alias("epoch"),
                    F.col("l_quantity").cast("bigint").alias("found"),
                    F.concat(F.lit("/state/"), F.col("l_orderkey").cast("string"), F.lit(".bin")).alias("path"),
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.when(F.col("l_linestatus") == "O", "pending").otherwise("running").alias("from"),
                    F.when(F.col("l_linestatus") == "O", "running").otherwise("completed").alias("to"),
                    F.create_map(
                        F.lit("state"), F.when(F.col("l_linestatus") == "O", "running").otherwise("completed"),
                        F.lit("controller_pid"), F.col("l_suppkey").cast("string"),
                        F.lit("container_id"), F.concat(F.lit("c-"), F.col("l_orderkey").cast("string")),
                        F.lit("last_checkpoint_epoch"), F.col("l_linenumber").cast("string"),
                    ).alias("updates"),
                )
            )
        )
    )
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("id_part"),
        F.col("l_suppkey").alias("id_supp"),
        F.col("l_orderkey").alias("job_id"),
        etype.alias("event_type"),
        payload.alias("payload"),
        F.col("l_shipdate").alias("recorded_at"),
    )


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 17-column ledger as stored: unix nanos, args as JSON text."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ns = epoch_micros("o_orderdate") * 1000
    base = o.select(
        k.cast("string").alias("id"),
        F.lit("runledger/worker:latest").alias("image"),
        F.lit("/usr/local/bin/worker").alias("command"),
        F.to_json(F.array(F.lit("--worker"), F.col("o_orderpriority"), F.lit("--limit"), F.col("o_custkey").cast("string"))).alias("args_json"),
        F.col("o_orderdate"),
        ns.alias("created_at"),
        k,
        F.col("o_totalprice"),
        _jobs_state_col().alias("state"),
        (k % 3 != 0).alias("has_checkpoint"),
    )
    return base.select(
        "id", "image", "command", "args_json", "state", "created_at",
        F.when(F.col("state") != "pending", F.col("created_at") + 3_600_000_000_000).alias("started_at"),
        F.when(F.col("state").isin("completed", "failed", "cancelled"), F.col("created_at") + 7_200_000_000_000).alias("finished_at"),
        F.when(F.col("state") == "completed", F.lit(0)).when(F.col("state") == "failed", F.lit(1)).cast("bigint").alias("exit_code"),
        F.when(F.col("has_checkpoint"), F.col("created_at") + 1_800_000_000_000).alias("last_checkpoint_at"),
        F.when(F.col("has_checkpoint"), F.concat(F.lit("/state/"), F.col("id"), F.lit(".bin"))).alias("last_checkpoint_path"),
        F.when(F.col("has_checkpoint"), k % 10).alias("last_checkpoint_epoch"),
        F.when(F.col("has_checkpoint"), F.floor(F.col("o_totalprice")).cast("bigint")).alias("last_checkpoint_found"),
        F.lit(None).cast("string").alias("container_id"),
        F.lit(None).cast("bigint").alias("controller_pid"),
        F.lit(None).cast("string").alias("state_volume_path"),
        F.lit(None).cast("string").alias("assigned_controller_id"),
    )


def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry file rows in load order (line), some malformed or repeated."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("line"),
        F.when(size % 17 == 0, "").otherwise(F.col("p_brand")).alias("worker_name"),
        F.when(size % 10 == 0, "").otherwise(F.concat(F.lit("img/"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")))).alias("image"),
        F.when(size % 13 == 0, "").otherwise(F.concat(F.lit("/usr/local/bin/"), F.lower("p_brand"))).alias("command"),
        (size * 100).alias("checkpoint_interval"),
        F.lit(1).alias("schema_version"),
    )


def alive_pids(spark: SparkSession) -> DataFrame:
    """Process table of the controller host: pid 1 is the controller itself, 2 another live one."""
    from pyspark.sql import types as T

    from runledger.sources.dims import literal_frame

    return literal_frame(spark, [(1,), (2,)], T.StructType([T.StructField("pid", T.LongType())]))


def lease_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job starts claimed under a lease: one per touch, by its toucher."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("lease_key"),
        F.col("user_id").alias("starter"),
        F.col("ts"),
    )


def lease_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock requests of three holders on twenty keys: acquire, refresh, release."""
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), (F.col("user_id") % 20).cast("string")).alias("lease_key"),
        (F.col("user_id") % 3).alias("holder"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(t.isin("signup", "error"), "acquire").when(t == "purchase", "release").otherwise("refresh").alias("op"),
    )


def _framed(body, crc_off, cut):
    """A frame of hex text with its CRC; ``crc_off`` spoils the CRC, ``cut`` keeps ten bytes."""
    raw = F.unhex(body)
    crc = F.crc32(raw)
    used = F.when(crc_off, F.pmod(crc + 1, F.lit(4294967296))).otherwise(crc)
    frame = F.concat(raw, F.unhex(B.le_hex(used, 4)))
    return F.when(cut, F.substring(frame, 1, 10)).otherwise(frame)


def jobc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JOBC v2 frame per document, damaged by doc_id % 8 (0 none, 1 cut to
    10 bytes, 2 flipped crc, 3 other magic, 4 version 99, 5 count 9999,
    6 count 8 with 4 entries, 7 one extra byte); 3-7 carry a valid crc."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id") % 8
    body = F.concat(
        F.when(d == 3, B.le_hex(F.lit(B.JOBC_MAGIC + 1), 4)).otherwise(B.le_hex(F.lit(B.JOBC_MAGIC), 4)),
        F.when(d == 4, B.le_hex(F.lit(99), 4)).otherwise(B.le_hex(F.lit(B.JOBC_VERSION), 4)),
        B.le_hex(F.col("n_chars"), 8),
        B.le_hex(F.col("doc_id"), 8),
        B.le_hex(F.col("doc_id") * 7, 8),
        F.lit("01"),
        F.when(d == 5, B.le_hex(F.lit(9999), 4)).when(d == 6, B.le_hex(F.lit(8), 4)).otherwise(B.le_hex(F.lit(4), 4)),
        *[B.le_hex(F.col("doc_id") + v, 8) for v in (11, 17, 29, 41)],
        F.when(d == 7, F.lit("AB")).otherwise(F.lit("")),
    )
    return docs.select("doc_id", _framed(body, d == 2, d == 1).alias("content"))


def mmul_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One MMUL v1 frame per document, damaged by doc_id % 5 (0 none, 1 cut, 2 crc, 3 magic, 4 version)."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id") % 5
    body = F.concat(
        F.when(d == 3, B.le_hex(F.lit(B.JOBC_MAGIC), 4)).otherwise(B.le_hex(F.lit(B.MMUL_MAGIC), 4)),
        F.when(d == 4, B.le_hex(F.lit(7), 4)).otherwise(B.le_hex(F.lit(B.MMUL_VERSION), 4)),
        B.le_hex(F.col("n_chars"), 8),
        B.le_hex(F.col("doc_id") + 3, 8),
        B.le_hex(F.col("doc_id") * 11, 8),
        F.lit("F0FFFFFFFFFFFFFF"),
    )
    return docs.select("doc_id", _framed(body, d == 2, d == 1).alias("content"))


def wcnt_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One WCNT v1 frame with two entries per document, damaged by doc_id % 7 (0 none, 1 cut,
    2 crc, 3 magic, 4 version, 5 count 65, 6 count 3 with two entries)."""
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id") % 7
    body = F.concat(
        F.when(d == 3, B.le_hex(F.lit(B.JOBC_MAGIC), 4)).otherwise(B.le_hex(F.lit(B.WCNT_MAGIC), 4)),
        F.when(d == 4, B.le_hex(F.lit(7), 4)).otherwise(B.le_hex(F.lit(B.WCNT_VERSION), 4)),
        B.le_hex(F.col("doc_id") + 3, 8),
        B.le_hex(F.col("n_chars"), 8),
        B.le_hex(F.col("doc_id") * 11, 8),
        F.when(d == 5, B.le_hex(F.lit(65), 4)).when(d == 6, B.le_hex(F.lit(3), 4)).otherwise(B.le_hex(F.lit(2), 4)),
        *[F.concat(B.le_hex(F.lit(i), 4), B.le_hex(F.col("doc_id") + i, 8)) for i in (6, 19)],
    )
    return docs.select("doc_id", _framed(body, d == 2, d == 1).alias("content"))
