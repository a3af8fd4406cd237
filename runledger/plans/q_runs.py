"""Run statistics and lease audit queries: A2 A3 J10 W8 W9 J7 J8."""

from __future__ import annotations

from runledger.operators import lease as LE
from runledger.operators import ordered
from runledger.operators import runstats as RS
from runledger.plans import fixtures as fx
from runledger.plans.catalog import register, with_ctes
from runledger.plans.fixtures import LEASE_TTL_SECONDS

# FIXED VALUES: a baseline under which some workers pass and some fail.
BASELINE = RS.Baseline(min_jobs_per_sec=0.00102, max_p50_ms=35.0, max_p95_ms=150.0, max_p99_ms=0.0, max_failures=670)
POLL_SECONDS = 3600

_SUMMARY = (
    "select {by} count(*) filter (where not err) as successes, count(*) filter (where err) as failures, "
    "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as wall_s, "
    "case when (epoch_us(max(ts)) - epoch_us(min(ts))) > 0 then count(*) filter (where not err) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) else 0.0 end as jobs_per_sec, "
    "round(coalesce(quantile_cont(latency_ms, 0.5) filter (where not err), 0.0), 6) as p50_ms, "
    "round(coalesce(quantile_cont(latency_ms, 0.95) filter (where not err), 0.0), 6) as p95_ms, "
    "round(coalesce(quantile_cont(latency_ms, 0.99) filter (where not err), 0.0), 6) as p99_ms, "
    "coalesce(max(latency_ms) filter (where not err), 0.0) as max_ms, "
    "round(coalesce(avg(latency_ms) filter (where not err), 0.0), 6) as mean_ms "
    "from runs {group}"
)


def _summary_sql(by: str) -> str:
    return _SUMMARY.format(by=f"{by}," if by else "", group=f"group by {by}" if by else "")


@register("run_summary", with_ctes(_summary_sql("worker"), "runs"))
def run_summary(spark, sf_dir):
    return RS.run_summary(fx.runs(spark, sf_dir), ["worker"])


@register("run_summary_daily", with_ctes(_summary_sql("day"), "runs"))
def run_summary_daily(spark, sf_dir):
    return RS.run_summary(fx.runs(spark, sf_dir), ["day"])


@register("run_summary_total", with_ctes(_summary_sql(""), "runs"))
def run_summary_total(spark, sf_dir):
    return RS.run_summary(fx.runs(spark, sf_dir))


@register(
    "latency_percentiles",
    with_ctes(
        "select worker, "
        + ", ".join(
            f"round(coalesce(quantile_cont(latency_ms, {q}) filter (where not err), 0.0), 6) as p{lbl}"
            for q, lbl in ((0.0, "0"), (0.5, "50"), (0.95, "95"), (0.99, "99"), (1.0, "100"))
        )
        + " from runs group by worker",
        "runs",
    ),
)
def latency_percentiles(spark, sf_dir):
    return RS.latency_percentiles(fx.runs(spark, sf_dir), ["worker"], (0.0, 0.5, 0.95, 0.99, 1.0))


def _gate_sql() -> str:
    b = BASELINE
    parts = [f"select worker, 'failures' as \"check\", cast(failures as double) as value, {float(b.max_failures)} as \"limit\" from s where failures > {b.max_failures}"]
    if b.min_jobs_per_sec > 0:
        parts.append(f"select worker, 'jobs_per_sec', jobs_per_sec, {b.min_jobs_per_sec} from s where jobs_per_sec < {b.min_jobs_per_sec}")
    for name, lim in (("p50_ms", b.max_p50_ms), ("p95_ms", b.max_p95_ms), ("p99_ms", b.max_p99_ms)):
        if lim > 0:
            parts.append(f"select worker, '{name}', {name}, {float(lim)} from s where {name} > {float(lim)}")
    return " union all ".join(parts)


@register("regress_gate", with_ctes(_gate_sql(), "runs", extra={"s": _summary_sql("worker")}))
def regress_gate(spark, sf_dir):
    return RS.regress_gate(RS.run_summary(fx.runs(spark, sf_dir), ["worker"]), BASELINE, ["worker"])


_TTL_US = f"{LEASE_TTL_SECONDS}000000"
HOLDS_SQL = (
    "select lease_key, holder, hold_no, min(ts) as from_ts, max(ts) as last_touch, count(*) as touches, "
    f"max(ts) + to_seconds({LEASE_TTL_SECONDS}) as until_ts from ("
    "select *, cast(sum(case when prev is null or epoch_us(ts) - epoch_us(prev) > "
    f"{_TTL_US} then 1 else 0 end) over (partition by lease_key, holder order by ts rows between unbounded preceding and current row) as bigint) as hold_no "
    "from (select *, lag(ts) over (partition by lease_key, holder order by ts) as prev from lease_touches)) "
    "group by lease_key, holder, hold_no"
)


def _holds(spark, sf_dir):
    """(holds, hot, hot_own): the holds, and whether some key, or some holder of a key, is too large for one task
    (a key has at most two marks per touch and one probe per start)."""
    touches = fx.lease_touches(spark, sf_dir)
    most = ordered.HOT_ROWS // 3
    hot = ordered.has_hot_key(touches, ["lease_key"], most)
    hot_own = hot and ordered.has_hot_key(touches, ["lease_key", "holder"], most)
    return LE.lease_holds(touches, LEASE_TTL_SECONDS, hot=hot_own), hot, hot_own


@register("lease_holds", with_ctes("select * from holds", "lease_touches", extra={"holds": HOLDS_SQL}))
def lease_holds(spark, sf_dir):
    return _holds(spark, sf_dir)[0]


OPS_TTL = 6 * 3600
_OPS_WALK = f"""
ops as (select *, row_number() over (partition by lease_key order by ts, seq) as rn from lease_ops),
walk as (
  select lease_key, 0::bigint as rn, null::bigint as held_by, null::timestamp as expires, 0::bigint as opened, false as good,
         null::timestamp as ts, null::varchar as op
  from (select distinct lease_key from ops)
  union all
  select w.lease_key, o.rn,
    case when o.op = 'release' and o.holder = w.held_by and o.ts <= w.expires then null
         when o.op = 'acquire' and (w.expires is null or o.ts > w.expires) then o.holder
         else w.held_by end,
    case when o.op = 'release' and o.holder = w.held_by and o.ts <= w.expires then null
         when o.op = 'acquire' and (w.expires is null or o.ts > w.expires) then o.ts + to_seconds({OPS_TTL})
         when o.op <> 'release' and o.holder = w.held_by and o.ts <= w.expires then o.ts + to_seconds({OPS_TTL})
         else w.expires end,
    case when o.op = 'acquire' and (w.expires is null or o.ts > w.expires) then w.opened + 1 else w.opened end,
    case when w.expires is null or o.ts > w.expires then o.op = 'acquire' else o.holder = w.held_by end, o.ts, o.op
  from walk w join ops o on o.lease_key = w.lease_key and o.rn = w.rn + 1),
good as (select walk.*, ops.holder from walk join ops using (lease_key, rn) where good)"""


@register(
    "lease_holds_ops",
    with_ctes(
        "select lease_key, holder, row_number() over (partition by lease_key, holder order by opened) as hold_no, "
        "min(ts) as from_ts, max(ts) as last_touch, count(*) as touches, "
        f"case when bool_or(op = 'release') then max(ts) else max(ts) + to_seconds({OPS_TTL}) end as until_ts, "
        "bool_or(op = 'release') as released from good group by lease_key, holder, opened",
        "lease_ops",
        recursive=True,
        raw=(_OPS_WALK.strip(),),
    ),
)
def lease_holds_ops(spark, sf_dir):
    """W8 with the lock's own rules: holders exclude each other, refreshes may come late, releases end a hold."""
    return LE.lease_holds(fx.lease_ops(spark, sf_dir), OPS_TTL, seq="seq")


@register(
    "failover_gap",
    with_ctes(
        "select lease_key, holder, from_ts, last_touch, until_ts, next_holder, next_from_ts, "
        "(epoch_us(next_from_ts) - epoch_us(last_touch)) / 1e6 as gap_s, "
        f"(epoch_us(next_from_ts) - epoch_us(last_touch)) / 1e6 <= {float(LEASE_TTL_SECONDS + POLL_SECONDS)} as within_sla "
        "from (select *, lead(holder) over w as next_holder, lead(from_ts) over w as next_from_ts from holds "
        "window w as (partition by lease_key order by from_ts, holder)) "
        "where next_holder is not null and next_holder <> holder",
        "lease_touches",
        extra={"holds": HOLDS_SQL},
    ),
)
def failover_gap(spark, sf_dir):
    holds, hot, _ = _holds(spark, sf_dir)
    return LE.failover_gap(holds, LEASE_TTL_SECONDS, POLL_SECONDS, hot=hot)


@register(
    "start_by_holder",
    with_ctes(
        "select s.seq, s.lease_key, s.starter, s.ts, "
        "(select count(*) from holds h where h.lease_key = s.lease_key and h.from_ts <= s.ts and s.ts <= h.until_ts) as n_covering, "
        "exists (select 1 from holds h where h.lease_key = s.lease_key and h.holder = s.starter and h.from_ts <= s.ts and s.ts <= h.until_ts) as own_hold, "
        "not exists (select 1 from holds h where h.lease_key = s.lease_key and h.holder = s.starter and h.from_ts <= s.ts and s.ts <= h.until_ts) as violation "
        "from lease_starts s",
        "lease_touches",
        "lease_starts",
        extra={"holds": HOLDS_SQL},
    ),
)
def start_by_holder(spark, sf_dir):
    holds, hot, hot_own = _holds(spark, sf_dir)
    return LE.start_by_holder(fx.lease_starts(spark, sf_dir), holds, hot=hot, hot_own=hot_own)


@register(
    "lease_overlap",
    with_ctes(
        "select h.*, (select count(*) from holds h2 where h2.lease_key = h.lease_key and h2.from_ts <= h.from_ts and h.from_ts <= h2.until_ts) as n_active "
        "from holds h where exists (select 1 from holds h2 where h2.lease_key = h.lease_key and h2.holder <> h.holder "
        "and h2.from_ts <= h.from_ts and h.from_ts <= h2.until_ts)",
        "lease_touches",
        extra={"holds": HOLDS_SQL},
    ),
)
def lease_overlap(spark, sf_dir):
    holds, hot, _ = _holds(spark, sf_dir)
    return LE.lease_overlap(holds, hot=hot)
