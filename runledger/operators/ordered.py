"""Per-key ordered operators that stay bounded when one key is huge.

Two plans, one result.  Where no key has more than ``HOT_ROWS`` rows (one
pre-aggregated count over the key columns decides), a plain window per key is
used: one scan, one exchange, one sort for any number of values and lags.
Where some key is larger, only the rows of such keys are cut into buckets of
the ordering.  Without ``bucket`` the cut is by rows: one range exchange along key and order
makes ranges of about ``RANGE_ROWS`` rows, wherever in time a key's rows lie.  For dense sequence numbers
``bucket`` may give the cut (non-decreasing along the order), which saves that pass.  The window
then runs inside ``(key, bucket)``, and bucket borders are stitched with a second,
much smaller window over one row per bucket of a hot key.  A cold key is one
bucket and needs no border row.

The set of hot keys has at most (rows / ``HOT_ROWS``) members, so it is
broadcast.  Callers that chain several helpers over one input pass the
decision on (``hot=``), so the keys are counted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scalar import epoch_micros

_B = "_bucket"
HOT_ROWS = 2_000_000
RANGE_ROWS = 500_000
BORDER_FANOUT = 4096


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def has_hot_key(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> bool:
    """Whether some key has more than ``rows`` rows (default ``HOT_ROWS``)."""
    return not _hot_keys(df, keys, rows).isEmpty()


def _hot_keys(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    return _hot_counts(df, keys, rows).drop("_n")


def _hot_counts(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    most = HOT_ROWS if rows is None else rows
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k + "_r"])
    return cond


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: k + "_r" for k in keys})


def _bucketed(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column | None, rows: int | None) -> DataFrame:
    """df + _bucket: the ordering bucket for rows of hot keys, null for the others."""
    counts = _hot_counts(df, keys, rows)
    hot = _renamed(counts.drop("_n"), keys).withColumn("_hot", F.lit(True))
    names = [k + "_r" for k in keys]
    if bucket is not None:
        marked = df.withColumn(_B, bucket)
        out = marked.join(F.broadcast(hot), _same(marked, hot, keys), "left")
        return out.withColumn(_B, F.when(F.col("_hot"), F.col(_B))).drop("_hot", *names)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    marked = df.join(F.broadcast(hot), _same(df, hot, keys), "left").drop(*names)
    ranges = max(2, -(-total // RANGE_ROWS))
    # Range bounds are sampled, so the rows are written once: every pass sees the same ranges.
    cut = marked.filter("_hot").repartitionByRange(ranges, *keys, *_cols(order))
    cut = pinned(cut.withColumn(_B, F.spark_partition_id().cast("bigint")))
    cold = marked.filter("_hot is null").withColumn(_B, F.lit(None).cast("bigint"))
    return cut.unionByName(cold).drop("_hot")


def _stitched(local: DataFrame, border: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the border values of its bucket (null for cold keys)."""
    names = [*keys, _B]
    right = _renamed(border, names)
    return local.join(right, _same(local, right, names), "left").drop(*[n + "_r" for n in names])


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column | None,
    values: dict[str, Column],
    inclusive: bool = True,
    levels: int = 1,
    hot: bool | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add running sums ``sum(v) over (partition by keys order by order)``.

    ``inclusive=False`` gives the sum over strictly earlier rows.  ``hot``:
    whether some key is too large for one task (None: count and see).
    """
    if hot is None:
        hot = has_hot_key(df, keys, hot_rows)
    if not hot:
        end = Window.currentRow if inclusive else -1
        frame = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, end)
        return df.select("*", *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(n) for n, v in values.items()])
    df = _bucketed(df, keys, order, bucket, hot_rows)
    w = Window.partitionBy(*keys, _B).orderBy(*_cols(order))
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select(
        "*",
        *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"_l_{n}") for n, v in values.items()],
        *([v.alias(f"_v_{n}") for n, v in values.items()] if not inclusive else []),
    )
    totals = (
        df.filter(F.col(_B).isNotNull())
        .groupBy(*keys, _B)
        .agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_t_{n}") for n, v in values.items()])
    )
    if levels > 0:
        # The bucket totals are themselves summed in buckets of buckets, so a
        # key spanning very many buckets is still split over tasks.
        tb = totals.withColumnRenamed(_B, "_bb")
        off = running_sums(
            tb, keys, ["_bb"], bucket_of("_bb", BORDER_FANOUT),
            {f"_o_{n}": F.col(f"_t_{n}") for n in values}, inclusive=False, levels=levels - 1,
            hot=True, hot_rows=0,
        )
        offsets = off.select(*keys, F.col("_bb").alias(_B), *[f"_o_{n}" for n in values])
    else:
        wb = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            *keys, _B, *[F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)).alias(f"_o_{n}") for n in values]
        )
    out = _stitched(local, offsets, keys)
    for n in values:
        own = F.lit(0) if inclusive else F.coalesce(F.col(f"_v_{n}"), F.lit(0))
        out = out.withColumn(n, F.col(f"_l_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) - own)
    drop = [_B, *[f"_l_{n}" for n in values], *[f"_o_{n}" for n in values]]
    if not inclusive:
        drop += [f"_v_{n}" for n in values]
    return out.drop(*drop)


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    bucket: Column | None,
    cols: Sequence[str],
    prefix: str,
    direction: str = "lag",
    levels: int = 1,
    hot: bool | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``lag(c)`` (or ``lead(c)``) for each column, named ``prefix + c``.

    Rows at a bucket edge of a hot key take the value from the neighbouring
    non-empty bucket: the last row of the previous bucket (lag) or the first
    row of the next one (lead), found with a window over one row per bucket.
    """
    if direction not in ("lag", "lead"):
        raise ValueError(direction)
    shift = F.lag if direction == "lag" else F.lead
    if hot is None:
        hot = has_hot_key(df, keys, hot_rows)
    if not hot:
        w = Window.partitionBy(*keys).orderBy(*_cols(order))
        return df.select("*", *[shift(c).over(w).alias(prefix + c) for c in cols])
    df = _bucketed(df, keys, order, bucket, hot_rows)
    w = Window.partitionBy(*keys, _B).orderBy(*_cols(order))
    local = df.select(
        "*", *[shift(c).over(w).alias(f"_s_{c}") for c in cols], shift(F.lit(1)).over(w).isNull().alias("_edge")
    )
    # The row a neighbouring bucket needs: last row (lag) / first row (lead), combined map-side.
    pick = F.max_by if direction == "lag" else F.min_by
    ends = (
        df.filter(F.col(_B).isNotNull())
        .groupBy(*keys, _B)
        .agg(pick(F.struct(*cols), F.struct(*_cols(order))).alias("_end"))
    )
    if levels > 0:
        # Neighbouring buckets found the same way, one level up.
        eb = ends.withColumnRenamed(_B, "_bb")
        nb = shifted(
            eb, keys, ["_bb"], bucket_of("_bb", BORDER_FANOUT), ["_end"], "_n", direction, levels - 1, hot=True, hot_rows=0
        )
        border = nb.select(*keys, F.col("_bb").alias(_B), F.col("_n_end").alias("_nb"))
    else:
        wb = Window.partitionBy(*keys).orderBy(_B)
        border = ends.select(*keys, _B, shift("_end").over(wb).alias("_nb"))
    out = _stitched(local, border, keys)
    for c in cols:
        out = out.withColumn(prefix + c, F.when(F.col("_edge"), F.col(f"_nb.{c}")).otherwise(F.col(f"_s_{c}")))
    return out.drop(_B, "_edge", "_nb", *[f"_s_{c}" for c in cols])


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, so that every later pass (and a retry after a
    lost executor) reads the same rows and partitions."""
    from runledger.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucket_of(col, width) -> Column:
    """Integer bucket of a numeric ordering column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("bigint")


def time_bucket(col, seconds: int) -> Column:
    """Integer bucket of a timestamp (or timestamp_ntz) ordering column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(epoch_micros(c) / F.lit(seconds * 1_000_000)).cast("bigint")


def global_running_sums(df: DataFrame, order: Sequence[str], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """Running sums along one global order, without an unpartitioned window.

    Two passes over one range partitioning of the order:
    1. per range partition, the totals of each value, summed over the
       partitions before it (a window over one row per partition);
    2. inside each partition a window along the order, plus those totals.
    Range bounds are sampled per job, so the range-partitioned data is
    written once with ``checkpoint()`` to the shared checkpoint folder, with
    its partition number: both passes read the same partitions, and a lost
    executor re-reads them instead of re-sampling.  ``order`` must be a total
    order (ties would make the running value depend on the order of tied rows).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(values)
    base = df.select(*df.columns, *[values[k].cast("bigint").alias(f"_v_{k}") for k in names])
    fixed = pinned(base.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    totals = fixed.groupBy("_pid").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in names])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names])
    frame = Window.partitionBy("_pid").orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = fixed.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(frame), F.lit(0)).alias(f"_l_{k}") for k in names])
    out = local.join(F.broadcast(offsets), "_pid")
    return out.select(*df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in names])
