"""Sinks: SNK1 snapshot publish, SNK2 event append, SNK3 orphan report.

All writes go through Spark's output commit protocol: a job's files become
visible only when the job commits, so readers never see half a write, and a
lost executor's task is simply retried.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN_TS = re.compile(r"[0-9A-Za-z_.-]+")


def publish_snapshot(df: DataFrame, path: str, run_ts: str) -> None:
    """SNK1: write one time-stamped result; earlier snapshots stay readable.

    A snapshot has a folder of its own, so publishing it again (a retry)
    replaces it.  The pointer, one row in a folder of its own, is written after
    the data has committed: a reader never sees half a snapshot.
    """
    if not _RUN_TS.fullmatch(run_ts):
        raise ValueError(f"not a plain time stamp: {run_ts!r}")
    df.write.mode("overwrite").parquet(f"{path}/data/{run_ts}")
    pointer = df.sparkSession.range(1).select(F.lit(run_ts).alias("published"))
    pointer.write.mode("overwrite").parquet(f"{path}/published/run_ts={run_ts}")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """SNK1: the snapshot that the newest pointer names (one small row per snapshot is read)."""
    newest = spark.read.parquet(f"{path}/published").agg(F.max("published")).first()[0]
    return spark.read.parquet(f"{path}/data/{newest}")


def append_events(events: DataFrame, path: str, payload_cols: list[str], key: str = "job_id", event_type: str = "event_type") -> None:
    """SNK2: append one row per change with a JSON payload."""
    out = events.select(
        "id", key, event_type, F.to_json(F.struct(*payload_cols)).alias("payload"), "recorded_at"
    )
    out.write.mode("append").parquet(path)


def write_orphan_report(orphans: DataFrame, path: str) -> None:
    """SNK3: one JSON line per orphan container."""
    orphans.select("id", "job_id", "controller_pid", "state").write.mode("overwrite").json(path)


ORPHAN_REPORT_SCHEMA = "id string, job_id string, controller_pid bigint, state string"
