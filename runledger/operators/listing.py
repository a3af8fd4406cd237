"""Ledger listing: P1-P6, L1-L3, J4, J5, W3, U1.

Listing is filter -> order -> limit, which Spark plans as
TakeOrderedAndProject: every task keeps only its top rows, so a page costs
one scan and no full sort.  Recent events per job use a row_number filter,
which Spark turns into a partial WindowGroupLimit before the shuffle, so a
hot job sends at most ``n`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scalar import epoch_micros, is_terminal
from runledger.operators.ordered import global_running_sums
from runledger.schemas import (
    DEFAULT_EVENT_LIMIT,
    DEFAULT_PAGE_LIMIT,
    JOB_VIEW_COLUMNS,
    MAX_LIMIT,
    RECOVERY_STATES,
    UPDATE_WHITELIST,
)


def clamp_limit(n: int | None, default: int) -> int:
    """L2: <= 0 or > 200 -> default."""
    if n is None or n <= 0 or n > MAX_LIMIT:
        return default
    return int(n)


def job_view(jobs: DataFrame) -> DataFrame:
    """Public projection of typed ledger rows."""
    return jobs.select(*JOB_VIEW_COLUMNS)


def job_lookup(jobs: DataFrame, job_id, id_col: str = "id") -> DataFrame:
    """The job with this id; an empty result is "not found"."""
    return jobs.filter(F.col(id_col) == F.lit(job_id))


def jobs_by_state(jobs: DataFrame, state: str | None) -> DataFrame:
    """Optional equality filter; empty / None = all."""
    return jobs.filter(F.col("state") == state) if state else jobs


def jobs_in_states(jobs: DataFrame, states: list[str] | None = None, created: str = "created_at") -> DataFrame:
    """State IN (...) oldest first; an empty list gives no rows."""
    states = list(RECOVERY_STATES if states is None else states)
    if not states:
        return jobs.limit(0)
    return jobs.filter(F.col("state").isin(*states)).orderBy(F.col(created).asc())


def terminal_flag(jobs: DataFrame) -> DataFrame:
    """P5: terminal flag per job."""
    return jobs.withColumn("terminal", is_terminal("state"))


def redact_updates(updates) -> F.Column:
    """Keep only whitelisted keys of an update map."""
    keep = F.array(*[F.lit(k) for k in UPDATE_WHITELIST])
    return F.map_filter(updates, lambda k, v: F.array_contains(keep, k))


def jobs_page(
    jobs: DataFrame,
    limit: int | None = None,
    state: str | None = None,
    cursor=None,
    faithful: bool = False,
    id_col: str = "job_id",
    created: str = "created_at",
) -> DataFrame:
    """L1 (+J4): one page newest first, with ``next_cursor`` on every row.

    ``cursor`` is the id of the last row of the previous page.  Its seek key
    is a scalar subquery, run once and pushed into the scan as a filter.
    Default mode seeks on ``(created, id)``, so ties never drop rows.
    ``faithful=True`` seeks on ``created`` alone, as the ledger does: rows
    that tie with the cursor row are skipped.  An unknown cursor yields an
    empty page in both modes.
    """
    n = clamp_limit(limit, DEFAULT_PAGE_LIMIT)
    df = jobs_by_state(jobs, state)
    if cursor is not None:
        row = jobs.filter(F.col(id_col) == F.lit(cursor))
        cc = row.select(created).scalar()
        if faithful:
            df = df.filter(F.col(created) < cc)
        else:
            ci = row.select(id_col).scalar()
            df = df.filter((F.col(created) < cc) | ((F.col(created) == cc) & (F.col(id_col) < ci)))
    top = df.orderBy(F.col(created).desc(), F.col(id_col).desc()).limit(n + 1)
    w = Window.orderBy(F.col(created).desc(), F.col(id_col).desc())
    # At most n + 1 rows here, so the unpartitioned window is over a bounded set.
    ranked = top.withColumn("_rn", F.row_number().over(w))
    more = F.max("_rn").over(Window.partitionBy(F.lit(1))) > n
    nxt = F.max(F.when(F.col("_rn") == n, F.col(id_col))).over(Window.partitionBy(F.lit(1)))
    return (
        ranked.withColumn("next_cursor", F.when(more, nxt))
        .filter(F.col("_rn") <= n)
        .withColumnRenamed("_rn", "page_rank")
    )


def recent_events(
    events: DataFrame, limit: int | None = None, key: str = "job_id", order: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Newest n events per job (n clamped: <= 0 or > 200 -> 25).

    ``order`` lists the columns of the log's total order (newest = largest).
    """
    n = clamp_limit(limit, DEFAULT_EVENT_LIMIT)
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("event_rank", F.row_number().over(w)).filter(F.col("event_rank") <= n)


def job_detail(
    jobs: DataFrame, events: DataFrame, limit: int | None = None, key: str = "job_id", order: tuple[str, ...] = ("id",)
) -> DataFrame:
    """One row per job with the list of its newest events (at most ``limit``), newest first."""
    recent = recent_events(events, limit, key, order)
    fields = [c for c in recent.columns if c not in (key, "event_rank")]
    listed = recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("event_rank", *fields))).alias("_events"))
    events_col = F.coalesce("_events", F.array().cast(listed.schema["_events"].dataType))
    slim = F.transform(events_col, lambda e: F.struct(*[e[c].alias(c) for c in fields])).alias("events")
    return jobs.join(listed, key, "left").select(*jobs.columns, slim)


def numbered_pages(jobs: DataFrame, limit: int | None = None, id_col: str = "job_id", created: str = "created_at") -> DataFrame:
    """All pages of the listing at once: page_no and page_rank of every row, newest first.

    The position along the one global order comes from range partitions and
    their totals, not from a walk or an unpartitioned window.
    """
    n = clamp_limit(limit, DEFAULT_PAGE_LIMIT)
    placed = global_running_sums(
        jobs.withColumn("_age", -epoch_micros(created)).withColumn("_back", -F.col(id_col)), ["_age", "_back"], {"_pos": F.lit(1)}
    )
    page = F.floor((F.col("_pos") - 1) / n).cast("bigint")
    return placed.select(*jobs.columns, (page + 1).alias("page_no"), (F.col("_pos") - page * n).alias("page_rank"))


def page_union(pages: list[DataFrame], id_col: str = "job_id") -> DataFrame:
    """Union of pages, one row per id, with the number of times it was seen (must be 1)."""
    u = pages[0]
    for p in pages[1:]:
        u = u.unionByName(p)
    return u.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_seen"))


def page_violations(union: DataFrame, jobs: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Ids that pages hold twice or more, or not at all."""
    j = jobs.select(id_col).join(union, id_col, "full_outer").withColumn("n_seen", F.coalesce("n_seen", F.lit(0).cast("bigint")))
    return j.filter(F.col("n_seen") != 1)


def walk_pages(jobs: DataFrame, limit: int, faithful: bool = False, id_col: str = "job_id", most: int | None = None) -> list[DataFrame]:
    """The pages a client sees that follows next_cursor to the end (or ``most`` pages); one small action per page."""
    pages, cursor = [], None
    while most is None or len(pages) < most:
        page = jobs_page(jobs, limit, cursor=cursor, faithful=faithful, id_col=id_col).withColumn("page_no", F.lit(len(pages) + 1))
        pages.append(page)
        row = page.select("next_cursor").first()
        cursor = None if row is None else row["next_cursor"]
        if cursor is None:
            break
    return pages
