"""Structured Streaming building blocks shared by ST1-ST9.

Input files for a stream are staged in arrival order: chunk i is written by
its own write job before chunk i+1, so the file source (oldest file first)
never reads a later chunk before an earlier one.  All paths live under the
session's shared checkpoint folder (``spark.checkpoint.dir``), never on a
machine-local disk, and every query has its own ``checkpointLocation``, so a
restarted query resumes where it stopped.

Keyed state that must be read as a table is emitted in ``update`` mode
through ``foreachBatch``: each batch appends the changed keys tagged with its
batch id (a re-run of a batch overwrites its own partition, so a retry is
idempotent), and the reader keeps the row of the highest batch per key.  Every
``COMPACT_EVERY`` batches a batch writes all keys instead, and readers start
there, so what a reader reads does not grow with the age of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.session import scratch_path


ROWS_PER_FILE = 250_000
COMPACT_EVERY = 16


def stage_chunks(df: DataFrame, path: str, order: str, chunks: int, rows_per_file: int | None = None, fmt: str = "parquet") -> int:
    """Write ``df`` as ``chunks`` ordered slices of ``order``, one write job each; returns the files of a slice.

    Slice bounds come from approximate quantiles of ``order`` (one small
    aggregate), so no slice is pulled through one task.  The number of files, the same for every
    slice, follows the rows; only slices are in order, rows and files of a slice are not.  A trigger that
    reads so many files reads whole slices.
    """
    files = -(-df.count() // (chunks * (rows_per_file or ROWS_PER_FILE))) or 1
    qs = [i / chunks for i in range(1, chunks)]
    # Equal quantiles bound no slice; without any value there is one slice.
    bounds = sorted(set(df.approxQuantile(order, qs, 0.001))) if qs else []
    at = F.col(order)
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:], strict=False):
        above = F.lit(True) if lo is None else at > F.lit(lo)
        within = above if hi is None else above & (at <= F.lit(hi))
        # rows without an order come first
        part = df.filter(at.isNull() | within if lo is None else within)
        part = part.repartition(files)  # dealt in turn: every file gets rows
        if fmt == "text":
            part.select("value").write.mode("append").text(path)
        else:
            part.write.mode("append").parquet(path)
    return files


def run_available_now(
    sdf: DataFrame,
    sink: str,
    checkpoint: str,
    output_mode: str = "append",
    fmt: str = "parquet",
    foreach_batch: Callable | None = None,
    timeout_s: float | None = None,
) -> None:
    """Process everything available, then stop.

    Waits as long as it takes.  A caller's ``timeout_s`` raises when it is hit:
    a part of the result is never returned as if it were all.
    """
    w = sdf.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        q: StreamingQuery = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", sink).start()
    try:
        ended = q.awaitTermination() if timeout_s is None else q.awaitTermination(timeout_s)
    finally:
        if q.isActive:
            q.stop()
    if ended is False:
        raise TimeoutError(f"the stream did not end within {timeout_s} s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def upsert_batches(path: str, keys: Sequence[str], every: int | None = None) -> Callable:
    """foreachBatch writer: append the batch's rows tagged with its batch id.

    The batch is written into its own ``batch_id=N`` partition with dynamic
    partition overwrite, so a retried batch replaces exactly its own output.  Every ``every`` batches the
    partition gets the newest row of all keys (``full=1``): earlier partitions are not read any more and may
    be deleted.
    """
    period = every or COMPACT_EVERY

    def write(batch: DataFrame, batch_id: int) -> None:
        full = batch_id % period == period - 1
        rows = batch.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "full": F.lit(int(full))})
        if full:
            kept = _since_full(batch.sparkSession.read.schema(rows.schema).parquet(path).filter(F.col("batch_id") < batch_id))
            newest = _newest(kept.unionByName(rows), keys)
            rows = newest.withColumns({"batch_id": F.lit(batch_id).cast("bigint"), "full": F.lit(1)})
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "full")
            .parquet(path)
        )

    return write


def _since_full(df: DataFrame) -> DataFrame:
    """The partitions from the last full one on (found from partition values alone)."""
    last = df.filter("full = 1").agg(F.max("batch_id")).first()[0]
    return df if last is None else df.filter(F.col("batch_id") >= last)


def _newest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    vals = [c for c in df.columns if c not in (*keys, "batch_id", "full")]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("batch_id")).alias("_v"))
    return last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Per key, the row written by the highest batch (hash aggregate, no window)."""
    return _newest(_since_full(spark.read.parquet(path)), keys)


def late_batches(late: str, marks: str, every: str) -> Callable:
    """foreachBatch writer of the rows that a window stream over the same input drops: those whose window
    (tumbling, of length ``every`` over ``event_time``) ends at or below the watermark that Spark holds late rows
    against: the one of the batch before, which is the latest event time of all batches before that.  Rows go to ``late``, each batch's latest event time to ``marks``, both into
    the batch's own partition, so a retried batch replaces its own output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = F.lit(batch_id).cast("bigint").alias("batch_id")
        seen = batch.agg(F.max(F.unix_millis("event_time")).alias("ms")).select("ms", mine)
        _replace(seen, marks)
        before = spark.read.schema(seen.schema).parquet(marks).filter(F.col("batch_id") < batch_id - 1)
        watermark = before.agg(F.max("ms")).first()[0]
        end = F.unix_millis(F.window("event_time", every)["end"])
        rows = batch.withColumn("_end", end).filter(F.col("_end") <= F.lit(watermark)).drop("_end")
        _replace(rows.select("*", mine), late)

    return write


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


class Killed(RuntimeError):
    """Stands for a worker that dies: raised behind a sink's write, before the batch is committed."""


def killed_after(write: Callable, batch: int) -> Callable:
    """A foreachBatch writer that dies once batch ``batch`` is written."""

    def run(df: DataFrame, batch_id: int) -> None:
        write(df, batch_id)
        if batch_id == batch:
            raise Killed(f"after the write of batch {batch_id}")

    return run


def stream_session(spark: SparkSession) -> SparkSession:
    """A sibling session for running streams, sized to the cluster.

    A stateful stream fixes its number of state partitions from
    ``spark.sql.shuffle.partitions`` on its first run; the batch setting of
    the caller (often 200 or thousands) would make every micro-batch run that
    many state tasks.  The sibling shares the SparkContext and caches, takes
    the caller's time zone, and uses the cluster's default parallelism (all
    paths are still taken from the caller's checkpoint folder).  The caller's
    own conf is not changed.
    """
    try:
        ss = spark.newSession()
        par = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - e.g. Spark Connect: use the caller's session
        return spark
    tz = spark.conf.get("spark.sql.session.timeZone", None)
    if tz:
        ss.conf.set("spark.sql.session.timeZone", tz)
    # State lives on local disk with changelogs in the checkpoint folder, not on the heap.
    ss.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    ss.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    caller = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ss.conf.set("spark.sql.shuffle.partitions", str(max(1, min(caller, par))))
    return ss


def paths(spark: SparkSession, name: str) -> tuple[str, str, str]:
    """(input, sink, checkpoint) folders for one run of a streaming query."""
    base = scratch_path(spark, name)
    return f"{base}/in", f"{base}/out", f"{base}/ckpt"
