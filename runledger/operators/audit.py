"""Run comparison and log merging: J9 U2 U3, SRC4 label filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(containers: DataFrame, key: str, value: str | None = None, labels: str = "labels") -> DataFrame:
    """SRC4: containers carrying label ``key`` (any value) or ``key=value``."""
    m = F.col(labels)
    cond = F.map_contains_key(m, key) if value is None else (m[key] == F.lit(value))
    return containers.filter(F.coalesce(cond, F.lit(False)))


def run_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys only left / only right / with a differing value (null-safe)."""
    lv = [F.col(v).alias(f"{v}_left") for v in values]
    rv = [F.col(v).alias(f"{v}_right") for v in values]
    l_ = left.select(*[F.col(k).alias(f"_lk_{k}") for k in keys], *lv, F.lit(True).alias("_inl"))
    r_ = right.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *rv, F.lit(True).alias("_inr"))
    cond = None
    for k in keys:
        c = F.col(f"_lk_{k}").eqNullSafe(F.col(f"_rk_{k}"))
        cond = c if cond is None else cond & c
    j = l_.join(r_, cond, "full_outer")
    same = None
    for v in values:
        c = F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right"))
        same = c if same is None else same & c
    kind = (
        F.when(F.col("_inr").isNull(), "only_left")
        .when(F.col("_inl").isNull(), "only_right")
        .when(~same, "value_differs")
    )
    out = j.select(
        *[F.coalesce(F.col(f"_lk_{k}"), F.col(f"_rk_{k}")).alias(k) for k in keys],
        *[f"{v}_left" for v in values],
        *[f"{v}_right" for v in values],
        kind.alias("diff"),
    )
    return out.filter(F.col("diff").isNotNull())


def run_identity_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset difference both ways; empty iff the runs are identical.

    One signed count per distinct row (+1 per copy in a, -1 per copy in b),
    combined map-side in a single aggregate; a row that one side has more often
    comes back once, with the ``side`` and the ``surplus``.
    """
    cols = a.columns
    u = a.select(*cols, F.lit(1).cast("bigint").alias("_d")).unionByName(
        b.select(*cols, F.lit(-1).cast("bigint").alias("_d"))
    )
    g = u.groupBy(*cols).agg(F.sum("_d").alias("_n")).filter(F.col("_n") != 0)
    side = F.when(F.col("_n") > 0, "only_a").otherwise("only_b")
    return g.select(*cols, side.alias("side"), F.abs(F.col("_n")).alias("surplus"))


def run_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2 as one row: surplus rows of either side, and whether the runs are identical."""
    count = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("surplus"))), F.lit(0).cast("bigint"))
    out = run_identity_diff(a, b).agg(count("only_a").alias("only_a"), count("only_b").alias("only_b"))
    return out.withColumn("identical", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def merged_log(logs: Sequence[DataFrame], sources: Sequence[str] | None = None) -> DataFrame:
    """Several logs as one event table (missing columns become null)."""
    out = None
    for i, df in enumerate(logs):
        d = df.withColumn("source", F.lit(sources[i] if sources else str(i)))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
