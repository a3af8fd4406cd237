"""Lease-log audit: W8 W9 J7 J8.

Touches (acquire / refresh) of one holder merge into holds: a touch at most
``ttl`` after the previous one extends the hold (expiry is "strictly after"),
otherwise a new hold starts; a hold lasts until its last touch + ttl.

Coverage questions ("how many holds cover this instant?") are answered with a
sweep line instead of a range join: hold starts count +1, hold ends -1, and a
running sum along time gives the number of holds active at each probe.  That
is linear in holds + probes and never emits interval pairs.  Running sums and
lag/lead use the helpers of ``ordered``: one window per lease key, and ranges of
its order where a key is too large for one task (``hot``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.scalar import seconds_between
from runledger.operators import ordered
from runledger.operators.lock import lock_holds


def _secs(a, b) -> F.Column:
    return seconds_between(a, b)


def lease_holds(
    touches: DataFrame,
    ttl_seconds: int,
    key: str = "lease_key",
    holder: str = "holder",
    ts: str = "ts",
    seq: str | None = None,
    hot: bool | None = None,
) -> DataFrame:
    """Holds (key, holder, hold_no, from_ts, last_touch, until_ts, touches).

    Every touch counts: it extends its holder's hold, or opens one after expiry.  A log with an ``op``
    column (acquire, refresh, release) is replayed by the lock's rules instead (``lock.lock_holds``), where
    holders exclude each other; there ``seq`` breaks ties of ``ts``.
    """
    if "op" in touches.columns:
        if seq is None:
            raise ValueError("a request log needs a column that orders requests of one instant")
        return lock_holds(touches, ttl_seconds, key, holder, ts, seq)
    keys, order = [key, holder], [ts, *([seq] if seq else [])]
    if hot is None:
        hot = ordered.has_hot_key(touches, keys)
    lagged = ordered.shifted(touches.select(*keys, *order), keys, order, None, [ts], "prev_", levels=0, hot=hot)
    new = F.col("prev_" + ts).isNull() | (_secs("prev_" + ts, ts) > ttl_seconds)
    chains = ordered.running_sums(
        lagged, keys, order, None, {"_chain": F.when(new, 1).otherwise(0).cast("bigint")}, levels=0, hot=hot
    )
    holds = chains.groupBy(*keys, "_chain").agg(
        F.min(ts).alias("from_ts"), F.max(ts).alias("last_touch"), F.count(F.lit(1)).alias("touches")
    )
    until = F.col("last_touch") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    until = until.cast(touches.schema[ts].dataType).alias("until_ts")
    return holds.select(*keys, F.col("_chain").alias("hold_no"), "from_ts", "last_touch", "touches", until)


def failover_gap(
    holds: DataFrame,
    ttl_seconds: int,
    poll_seconds: float,
    key: str = "lease_key",
    holder: str = "holder",
    hot: bool | None = None,
) -> DataFrame:
    """From each hold to the next hold of the key by another holder.

    gap_s = next holder's first touch - this holder's last touch; the bound is
    ttl + poll.  Rows where the next hold is by the same holder or there is
    none are dropped.
    """
    nxt = ordered.shifted(holds, [key], ["from_ts", holder], None, [holder, "from_ts"], "next_", direction="lead", levels=0, hot=hot)
    sla = float(ttl_seconds) + float(poll_seconds)
    out = nxt.filter(F.col("next_" + holder).isNotNull() & (F.col("next_" + holder) != F.col(holder)))
    return out.select(
        key,
        holder,
        "from_ts",
        "last_touch",
        "until_ts",
        F.col("next_" + holder).alias("next_holder"),
        F.col("next_from_ts").alias("next_from_ts"),
        _secs("last_touch", "next_from_ts").alias("gap_s"),
        (_secs("last_touch", "next_from_ts") <= F.lit(sla)).alias("within_sla"),
    )


def _edges(start: str, end: str, released: str | None = None) -> list[F.Column]:
    """The marks of an interval: +1 at its start, -1 at its end, with their rank among equal instants.

    An interval includes its end, unless it was ``released`` then: others may start at that instant.
    """
    last = F.lit(2) if released is None else F.when(F.col(released), -1).otherwise(2)
    return [
        F.struct(F.col(start).alias("_t"), F.lit(0).alias("_o"), F.lit(1).cast("bigint").alias("_d")),
        F.struct(F.col(end).alias("_t"), last.alias("_o"), F.lit(-1).cast("bigint").alias("_d")),
    ]


def _swept(events: DataFrame, keys: Sequence[str], own: str | None, hot: bool | None, hot_own: bool | None = None) -> DataFrame:
    """Probes (``_o`` = 1) with the number of open intervals per key and, with ``own``, per (key, own).

    A key may be hot where none of its (key, own) is (``hot_own``; None: as ``hot``).
    """
    order = ["_t", "_o", F.col("_p._probe_id")]
    run = events
    if own:
        hot_own = hot if hot_own is None else hot_own
        run = ordered.running_sums(run, [*keys, own], order, None, {"n_own": F.col("_d")}, levels=0, hot=hot_own)
    if hot is None:
        hot = ordered.has_hot_key(events, keys)
    if hot:
        run = ordered.pinned(run)  # a hot key's rows are counted, sampled and cut
    run = ordered.running_sums(run, list(keys), order, None, {"n_cover": F.col("_d")}, levels=0, hot=hot)
    return run.filter(F.col("_o") == 1).select("_p.*", "n_cover", *(["n_own"] if own else []))


def coverage(
    intervals: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    at: str,
    own: str | None = None,
    hot: bool | None = None,
    hot_own: bool | None = None,
) -> DataFrame:
    """Number of closed intervals [start, end] of the same keys covering each probe.

    ``probes`` keeps all its columns and gains ``n_cover``; it must carry a
    unique ``_probe_id`` column (any orderable type, e.g. a struct).  Sweep: +1
    at start (before probes of the same instant), -1 at end (after them),
    running sum per key along time.  With ``own`` (a column of both sides) the
    same sweep also counts, as ``n_own``, the intervals that share it.
    """
    by = [*keys, *([own] if own else [])]
    marks = intervals.select(*by, F.explode(F.array(*_edges(start, end))).alias("_e")).select(
        *by, "_e.*", F.lit(None).cast(probes.schema).alias("_p")
    )
    # Probes travel through the sweep whole, so no join back is needed.
    pts = probes.select(
        *by, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(0).cast("bigint").alias("_d"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("_p"),
    )
    return _swept(marks.unionByName(pts), keys, own, hot, hot_own)


def start_by_holder(
    starts: DataFrame,
    holds: DataFrame,
    key: str = "lease_key",
    holder: str = "holder",
    starter: str = "starter",
    ts: str = "ts",
    probe_id: str = "seq",
    hot: bool | None = None,
    hot_own: bool | None = None,
) -> DataFrame:
    """Per start, how many holds of its key cover it and whether the
    starter itself held the lease; a start without its own hold is a violation.
    Both counts come from one sweep."""
    p = starts.withColumn("_probe_id", F.col(probe_id))
    renamed = holds.withColumnRenamed(holder, starter)
    found = coverage(renamed, p, [key], "from_ts", "until_ts", ts, own=starter, hot=hot, hot_own=hot_own)
    own_hold = F.col("n_own") > 0
    return found.select(
        *starts.columns, F.col("n_cover").alias("n_covering"), own_hold.alias("own_hold"), (~own_hold).alias("violation")
    )


def lease_overlap(
    holds: DataFrame, key: str = "lease_key", holder: str = "holder", hot: bool | None = None
) -> DataFrame:
    """Holds that start while another holder's hold of the key is active.

    Holds of one holder never overlap (a new one starts only after the old one
    expired), so a hold is offending iff at least two holds cover its start.
    Each hold gives its two marks and its probe in one pass.  A ``released`` hold does not
    cover the instant of its release.
    """
    row = F.struct(F.struct(F.col(key), F.col(holder), F.col("hold_no")).alias("_probe_id"), *[F.col(c) for c in holds.columns])
    none = F.lit(None).cast(holds.select(row.alias("_p")).schema["_p"].dataType)
    probe = F.struct(F.col("from_ts").alias("_t"), F.lit(1).alias("_o"), F.lit(0).cast("bigint").alias("_d"))
    released = "released" if "released" in holds.columns else None
    parts = [F.struct(e.alias("_e"), none.alias("_p")) for e in _edges("from_ts", "until_ts", released)]
    events = holds.select(
        F.col(key), F.explode(F.array(*parts, F.struct(probe.alias("_e"), row.alias("_p")))).alias("_x")
    ).select(key, "_x._e.*", "_x._p")
    cov = _swept(events, [key], None, hot)
    return cov.filter(F.col("n_cover") >= 2).withColumnRenamed("n_cover", "n_active").drop("_probe_id")
