"""Run statistics and the regression gate: A2 A3 J10.

Percentiles are exact: linear interpolation at rank p*(n-1), the bench's own
rule.  Three methods:

* ``"rank"`` (default): distributed rank selection.  Values are counted per
  (group, value) with map-side combine, cumulative counts come from the
  running sums of ``ordered``, and the rows whose count interval holds a
  target rank are picked by a filter.  A group with very many distinct values
  is cut into ranges of equally many, so no task holds it whole.
* ``"map"``: Spark's ``percentile`` (a value->count map per group, merged in
  one task per group); fine when distinct values per group are few.
* ``"approx"``: ``percentile_approx`` (bounded sketch, approximate).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scalar import seconds_between
from runledger.operators import ordered

QUANTILES = (0.5, 0.95, 0.99)


@dataclass(frozen=True)
class Baseline:
    """Floors and ceilings; a floor or ceiling <= 0 disables its check
    (failures are always compared)."""

    min_jobs_per_sec: float
    max_p50_ms: float
    max_p95_ms: float
    max_p99_ms: float
    max_failures: int


def _pcts(x: Column, qs: Sequence[float], approx: bool) -> Column:
    arr = F.array(*[F.lit(q) for q in qs])
    return F.percentile_approx(x, arr, 10000) if approx else F.percentile(x, arr)


def rank_percentiles(
    df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], hot: bool | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Exact percentiles per group by distributed rank selection.

    Returns ``by`` + one column ``_q{i}`` per quantile (null for an empty
    group).  Values are counted per (group, value) first.  Where a group has
    more distinct values than fit one task, it is cut into ranges that hold about the same
    number of them whatever their distribution, as many as its values ask for.
    """
    by = list(by) or ["_all"]
    if by == ["_all"]:
        df = df.withColumn("_all", F.lit(1))
    vals = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = vals.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if hot is None:
        hot = ordered.has_hot_key(counts, by, hot_rows)
    if hot:
        run = ordered.running_sums(counts, by, ["_v"], None, {"_cum": F.col("_c")}, levels=0, hot=True, hot_rows=hot_rows)
        totals = counts.groupBy(*by).agg(F.sum("_c").alias("_n")).withColumnsRenamed({k: k + "_r" for k in by})
        same = F.lit(True)
        for k in by:
            same = same & run[k].eqNullSafe(totals[k + "_r"])
        run = run.join(totals, same).drop(*[k + "_r" for k in by])
    else:
        run = ordered.running_sums(counts, by, ["_v"], F.lit(0), {"_cum": F.col("_c")}, levels=0, hot=False)
        run = run.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    picks, outs = [], []
    for i, q in enumerate(qs):
        rank = F.lit(q) * (F.col("_n") - 1)
        r_lo, r_hi = F.floor(rank), F.ceil(rank)
        prev = F.col("_cum") - F.col("_c")
        in_lo = (prev <= r_lo) & (r_lo < F.col("_cum"))
        in_hi = (prev <= r_hi) & (r_hi < F.col("_cum"))
        picks.append(in_lo | in_hi)
        outs += [
            F.max(F.when(in_lo, F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when(in_hi, F.col("_v"))).alias(f"_hi{i}"),
            F.max(rank - r_lo).alias(f"_f{i}"),
        ]
    cond = picks[0]
    for c in picks[1:]:
        cond = cond | c
    sel = run.filter(cond).groupBy(*by).agg(*outs)
    res = sel.select(
        *by,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"_q{i}")
            for i in range(len(qs))
        ],
    )
    return res.drop("_all")


def _stats(runs: DataFrame, by: Sequence[str], latency: str, err: str, qs: Sequence[float], method: str) -> DataFrame:
    """Percentiles of successful latencies per group as columns _q0.. (null if none)."""
    lat_ok = F.when(~F.col(err), F.col(latency))
    if method == "rank":
        ok = runs.filter(~F.col(err)).select(*by, F.col(latency))
        got = rank_percentiles(ok, by, latency, qs)
        keys = runs.select(*by).distinct() if by else None
        return keys.join(got, list(by), "left") if by else got
    g = runs.groupBy(*by) if by else runs.groupBy()
    agg = g.agg(_pcts(lat_ok, qs, method == "approx").alias("_p"))
    return agg.select(*by, *[F.col("_p")[i].alias(f"_q{i}") for i in range(len(qs))])


def run_summary(
    runs: DataFrame,
    by: Sequence[str] = (),
    latency: str = "latency_ms",
    err: str = "err",
    ts: str = "ts",
    method: str = "rank",
) -> DataFrame:
    """A2: successes, failures, wall seconds, jobs/s and latency stats over
    successes only; a group without successes reports 0 for each stat."""
    ok = ~F.col(err)
    lat_ok = F.when(ok, F.col(latency))
    g = runs.groupBy(*by) if by else runs.groupBy()
    agg = g.agg(
        F.count_if(ok).alias("successes"),
        F.count_if(F.col(err)).alias("failures"),
        seconds_between(F.min(ts), F.max(ts)).alias("wall_s"),
        F.max(lat_ok).alias("_max"),
        F.avg(lat_ok).alias("_mean"),
    )
    p = _stats(runs, by, latency, err, QUANTILES, method)
    agg = agg.join(p, list(by), "left") if by else _one_row_join(agg, p)
    z = F.lit(0.0)
    return agg.select(
        *by,
        "successes",
        "failures",
        F.col("wall_s"),
        F.when(F.col("wall_s") > 0, F.col("successes") / F.col("wall_s")).otherwise(z).alias("jobs_per_sec"),
        F.round(F.coalesce(F.col("_q0"), z), 6).alias("p50_ms"),
        F.round(F.coalesce(F.col("_q1"), z), 6).alias("p95_ms"),
        F.round(F.coalesce(F.col("_q2"), z), 6).alias("p99_ms"),
        F.coalesce(F.col("_max"), z).alias("max_ms"),
        F.round(F.coalesce(F.col("_mean"), z), 6).alias("mean_ms"),
    )


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row (or empty) aggregates side by side on a constant key."""
    k = "_one"
    return a.withColumn(k, F.lit(1)).join(b.withColumn(k, F.lit(1)), k, "left").drop(k)


def latency_percentiles(
    runs: DataFrame,
    by: Sequence[str],
    qs: Sequence[float],
    latency: str = "latency_ms",
    err: str = "err",
    method: str = "rank",
) -> DataFrame:
    """A3: exact percentiles of successful latencies per group (empty -> 0)."""
    p = _stats(runs, by, latency, err, qs, method)
    cols = [F.round(F.coalesce(F.col(f"_q{i}"), F.lit(0.0)), 6).alias(f"p{_label(q)}") for i, q in enumerate(qs)]
    return p.select(*by, *cols)


def _label(q: float) -> str:
    s = f"{q * 100:g}"
    return s.replace(".", "_")


def regress_gate(summary: DataFrame, baseline: Baseline, by: Sequence[str] = ()) -> DataFrame:
    """One row per violated check of each summary row."""
    b = baseline
    checks = [
        ("failures", F.col("failures").cast("double"), float(b.max_failures), F.col("failures") > F.lit(b.max_failures)),
    ]
    if b.min_jobs_per_sec > 0:
        checks.append(("jobs_per_sec", F.col("jobs_per_sec"), b.min_jobs_per_sec, F.col("jobs_per_sec") < F.lit(b.min_jobs_per_sec)))
    for name, lim in (("p50_ms", b.max_p50_ms), ("p95_ms", b.max_p95_ms), ("p99_ms", b.max_p99_ms)):
        if lim > 0:
            checks.append((name, F.col(name), lim, F.col(name) > F.lit(lim)))
    arr = F.array(
        *[
            F.struct(F.lit(n).alias("check"), v.alias("value"), F.lit(float(lim)).alias("limit"), bad.alias("violated"))
            for n, v, lim, bad in checks
        ]
    )
    return (
        summary.select(*by, F.inline(arr))
        .filter(F.col("violated"))
        .drop("violated")
    )
