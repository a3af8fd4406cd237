"""Aggregation queries: A4-A7 J11 W4 W5 W11 A9."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import aggregate as A
from runledger.operators import lifecycle as L
from runledger.operators import ordered
from runledger.plans import fixtures as fx
from runledger.plans.catalog import register, with_ctes
from runledger.plans.fixtures import CADENCE_K
from runledger.sources.tables import table

U64 = "18446744073709551616"
_FP = "cast(('0x' || substr(md5({x}), 1, 15)) as bigint)"
_WC = "select word, count(*) as n from tokens where word <> '' group by word"
_WORD_FP = _FP.format(x="word || ':' || cast(n as varchar)")
_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
_ORDER_SQL = "l_shipdate, l_orderkey, l_linenumber, l_partkey"


def _tokens(spark, sf_dir):
    return fx.tokens(spark, sf_dir)


@register("word_count", with_ctes("select word, count(*) as n from tokens where word <> '' group by word", "tokens"))
def word_count(spark, sf_dir):
    return A.word_count(_tokens(spark, sf_dir))


@register(
    "count_fingerprint",
    with_ctes(
        "select count(*) as n_keys, cast(sum(n) as bigint) as total, "
        f"cast(sum({_WORD_FP}::hugeint) % {U64} as decimal(20,0)) as fingerprint from wc",
        "tokens",
        extra={"wc": _WC},
    ),
)
def count_fingerprint(spark, sf_dir):
    return A.count_fingerprint(A.word_count(_tokens(spark, sf_dir)))


@register(
    "total_check",
    with_ctes(
        "select t.n_tokens, c.sum_counts, t.n_tokens = c.sum_counts as ok from "
        "(select count(*)::bigint as n_tokens from tokens where word <> '') t, (select sum(n)::bigint as sum_counts from wc) c",
        "tokens",
        extra={"wc": _WC},
    ),
)
def total_check(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return A.total_check(t, A.word_count(t))


# B has one column per line number: the product grows with the suppliers, not with their square.
_B = "select l_partkey as k, l_linenumber as j, cast(sum(l_quantity) as bigint) as v from lineitem group by 1, 2"
_C = f"select a.i, b.j, sum(a.v::hugeint * b.v) % {U64} as c from matrix a join b on a.k = b.k group by a.i, b.j"


def _b(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("j")).agg(
        F.sum("l_quantity").cast("bigint").alias("v")
    )



@register("matrix_product", with_ctes("select i, j, cast(c as decimal(20,0)) as c from c", "matrix", extra={"b": _B, "c": _C}))
def matrix_product(spark, sf_dir):
    return A.matrix_product(fx.matrix(spark, sf_dir), _b(spark, sf_dir))


@register(
    "matrix_product_tiles", with_ctes("select i, j, cast(c as decimal(20,0)) as c from c", "matrix", extra={"b": _B, "c": _C})
)
def matrix_product_tiles(spark, sf_dir):
    """J11 by blocks: the same cells as the coordinate form."""
    return A.matrix_product_tiles(fx.matrix(spark, sf_dir), _b(spark, sf_dir))


@register(
    "matrix_fingerprint",
    with_ctes(
        f"select count(*) as n_cells, cast(sum(c)::hugeint % {U64} as decimal(20,0)) as sum_cells from c",
        "matrix",
        extra={"b": _B, "c": _C},
    ),
)
def matrix_fingerprint(spark, sf_dir):
    return A.matrix_fingerprint(A.matrix_product(fx.matrix(spark, sf_dir), _b(spark, sf_dir)))


_POS = (
    "select *, count(*) over w as pos, count(*) filter (where hit) over w as hits, "
    "count(*) over (partition by l_suppkey) as total, count(*) filter (where hit) over (partition by l_suppkey) as total_hits "
    f"from ordered_hits window w as (partition by l_suppkey order by {_ORDER_SQL} rows between unbounded preceding and current row)"
)


@register(
    "cadence_snapshots",
    with_ctes(
        f"select l_suppkey, cast(hits / {CADENCE_K} as bigint) as epoch, pos as cursor, hits as found, "
        f"least(1.0, pos / total) as progress, false as final from ({_POS}) where hit and hits % {CADENCE_K} = 0 "
        f"union all select l_suppkey, cast(floor(count(*) filter (where hit) / {CADENCE_K}) + 1 as bigint), count(*), "
        "count(*) filter (where hit), 1.0, true from ordered_hits group by l_suppkey",
        "ordered_hits",
    ),
)
def cadence_snapshots(spark, sf_dir):
    return A.cadence_snapshots(fx.ordered_hits(spark, sf_dir), "l_suppkey", _ORDER, None, CADENCE_K)


_RESUMED = (
    "select *, count(*) over j as pos, count(*) filter (where hit) over j as hits, "
    "count(*) over (partition by job_id) as total, count(*) filter (where hit) over a as run_hits from "
    "(select job_id, seq, type = 'checkpoint' as hit, cast(sum(case when type = 'started' then 1 else 0 end) over "
    "(partition by job_id order by seq rows between unbounded preceding and current row) as bigint) as attempt from worker_log) "
    "window j as (partition by job_id order by seq rows between unbounded preceding and current row), "
    "a as (partition by job_id, attempt order by seq rows between unbounded preceding and current row)"
)
RESUMED_K = 3


@register(
    "resumed_snapshots",
    with_ctes(
        f"select job_id, attempt, cast(run_hits / {RESUMED_K} as bigint) as epoch, pos as cursor, hits as found, "
        f"least(1.0, pos / total) as progress, false as final from ({_RESUMED}) where hit and run_hits % {RESUMED_K} = 0 "
        f"union all select job_id, attempt, cast(floor(run_hits / {RESUMED_K}) + 1 as bigint), pos, hits, 1.0, true "
        f"from ({_RESUMED}) where pos = total",
        "worker_log",
    ),
)
def resumed_snapshots(spark, sf_dir):
    """W4 with resumes: cadence and epochs restart in every attempt of a job."""
    log = fx.worker_log(spark, sf_dir)
    hot = ordered.has_hot_key(log, ["job_id"])
    rows = L.attempts(log, hot=hot).select("job_id", "attempt", "seq", (F.col("type") == "checkpoint").alias("hit"))
    return A.resumed_snapshots(rows, "job_id", "attempt", ["seq"], ordered.bucket_of("seq", L.BUCKET_WIDTH), RESUMED_K, hot=hot)


@register(
    "progress_curve",
    with_ctes(
        "select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, hit, pos, hits, "
        f"case when total = 0 then 0.0 else least(1.0, pos / total) end as progress from ({_POS})",
        "ordered_hits",
    ),
)
def progress_curve(spark, sf_dir):
    return A.progress_curve(fx.ordered_hits(spark, sf_dir), "l_suppkey", _ORDER, None)


@register(
    "tail_ring",
    with_ctes(
        "select l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, hit, "
        "cast(count(*) over (partition by l_suppkey) - rn + 1 as integer) as ring_pos from "
        f"(select *, row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_partkey desc) as rn "
        "from ordered_hits where hit) where rn <= 32",
        "ordered_hits",
    ),
)
def tail_ring(spark, sf_dir):
    return A.tail_ring(fx.ordered_hits(spark, sf_dir), "l_suppkey", _ORDER)


_U64_FOUND = f"case when seq % 13 = 0 then {U64} - 1 - found when seq % 17 <> 0 then found end"


@register(
    "last_found",
    with_ctes(
        "select job_id, cast(coalesce(arg_max(f, seq) filter (where f is not null and type in ('checkpoint', 'completed')), 0) "
        f"as decimal(20,0)) as last_found from (select *, {_U64_FOUND} as f from worker_log) group by job_id",
        "worker_log",
    ),
)
def last_found(spark, sf_dir):
    """Every 13th value is above 2^63, every 17th report has none."""
    found, seq = F.col("found").cast("decimal(20,0)"), F.col("seq")
    top = F.lit(U64).cast("decimal(20,0)") - 1 - found
    u64 = F.when(seq % 13 == 0, top.cast("decimal(20,0)")).when(seq % 17 != 0, found)
    return A.last_found(fx.worker_log(spark, sf_dir).withColumn("found", u64))


_GORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
_GORDER_SQL = ", ".join(_GORDER)
GLOBAL_K = 1000


@register(
    "global_cadence",
    f"""with g as (select {_GORDER_SQL}, l_returnflag = 'R' as hit,
                count(*) over w as pos, count(*) filter (where l_returnflag = 'R') over w as hits,
                count(*) over () as total
         from lineitem window w as (order by {_GORDER_SQL} rows between unbounded preceding and current row))
    select {_GORDER_SQL}, cast(hits / {GLOBAL_K} as bigint) as epoch, pos as cursor, hits as found,
           least(1.0, pos / total) as progress, false as final
    from g where hit and hits % {GLOBAL_K} = 0
    union all
    select {", ".join(f"null as {c}" for c in _GORDER)}, cast(floor(count(*) filter (where l_returnflag = 'R') / {GLOBAL_K}) + 1 as bigint),
           count(*), count(*) filter (where l_returnflag = 'R'), 1.0, true from lineitem""",
)
def global_cadence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*_GORDER, (F.col("l_returnflag") == "R").alias("hit"))
    return A.global_cadence(li, _GORDER, GLOBAL_K)
