"""W8, the lock's rules over the requests of all holders.

One lock per key, with state (holder, expiry), replays its requests in order:

* an acquire succeeds while nobody holds the lock, after the hold has expired
  (strictly after), and for the holder itself, whose hold it extends;
* a refresh extends the hold of its own holder until it expires, and else fails;
* a release ends the hold of its own holder at once, and else fails.

A request that fails leaves no trace.

The replay is not one long fold.  Requests of *one* holder at most a TTL apart,
up to a release, form a chain.  Whichever acquire of a chain gets the lock, the
holder keeps it to the chain's end, since every later request of the chain comes
in time.  So an acquire knows by itself when the hold that it opens would end,
and only the acquires that do open one are to be found: the first of the key,
then always the first one after the end of the hold before.  Chains are plain
per-holder windows with map-side combined totals; what is left is one short row
per acquire, sorted by key and time, and a jump per hold.

A key with more than ``hot_rows`` acquires is cut into ranges of its own order by a range
exchange, which cuts by rows, not by the clock.  A range is a function of the hold that comes in: for runs
of its acquires it says with which end the last hold that starts in the range leaves it.
Those runs, one per end that crosses a border (as many as holders compete there), are followed from range to
range; then every range replays its own rows from the hold that really comes in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.scalar import epoch_micros, seconds_between
from runledger.operators import ordered

HOT_ROWS = 2_000_000
RANGE_ROWS = 200_000
BATCH_ROWS = 200_000
_FIRST = -(1 << 62)


def _opening_acquires(touches: DataFrame, ttl_seconds: int, key: str, holder: str, ts: str, seq: str, hot: bool) -> DataFrame:
    """One row per acquire: what its hold would be if it opened one.

    ``_at`` and ``_end`` place it and the end of that hold in one order: twice the micros, and
    one more for an expiry, which comes after all requests of its instant.
    """
    keys, order = [key, holder], [ts, seq]
    seen = touches.select(*keys, *order, "op")
    lagged = ordered.shifted(seen, keys, order, None, [ts, "op"], "prev_", levels=0, hot=hot)
    late = F.col("prev_" + ts).isNull() | (seconds_between("prev_" + ts, ts) > ttl_seconds)
    new = late | F.coalesce(F.col("prev_op") == "release", F.lit(False))
    one = F.lit(1).cast("bigint")
    rows = ordered.running_sums(
        lagged, keys, order, None, {"_chain": F.when(new, 1).otherwise(0).cast("bigint"), "_rn": one}, levels=0, hot=hot
    )
    chains = rows.groupBy(*keys, "_chain").agg(
        F.max("_rn").alias("_last_rn"),
        F.max(ts).alias("last_touch"),
        F.bool_or(F.col("op") == "release").alias("released"),
        F.max(F.when(F.col("op") == "release", F.col(seq))).alias("_end_seq"),
    )
    chains = chains.withColumnsRenamed({c: c + "_c" for c in [*keys, "_chain"]})
    # Chains that no acquire belongs to open nothing.
    mine = rows.filter(F.col("op") == "acquire").select(*keys, *order, "_chain", "_rn")
    same = mine[key].eqNullSafe(chains[key + "_c"]) & mine[holder].eqNullSafe(chains[holder + "_c"])
    joined = mine.join(chains, same & (mine["_chain"] == chains["_chain_c"]))
    end = F.when(F.col("released"), 2 * epoch_micros("last_touch")).otherwise(
        2 * (epoch_micros("last_touch") + ttl_seconds * 1_000_000) + 1
    )
    return joined.select(
        *keys,
        *order,
        "last_touch",
        "released",
        (F.col("_last_rn") - F.col("_rn") + 1).alias("touches"),
        (2 * epoch_micros(ts)).alias("_at"),
        F.col(seq).cast("bigint").alias("_at_seq"),
        end.alias("_end"),
        F.coalesce(F.col("_end_seq"), F.lit(0)).cast("bigint").alias("_end_seq"),
    )


def _before(group: np.ndarray, at: np.ndarray, seq: np.ndarray, g2: np.ndarray, at2: np.ndarray, seq2: np.ndarray) -> np.ndarray:
    """Number of the first of the sorted places (group, at, seq) behind each place (g2, at2, seq2)."""
    n = len(at)
    flag = np.concatenate([np.zeros(n, np.int8), np.ones(len(at2), np.int8)])
    order = np.lexsort((flag, np.concatenate([seq, seq2]), np.concatenate([at, at2]), np.concatenate([group, g2])))
    rank = np.cumsum(order < n)
    out = np.empty(n + len(at2), np.int64)
    out[order] = rank
    return out[n:]


def next_openers(group: np.ndarray, at: np.ndarray, seq: np.ndarray, end: np.ndarray, end_seq: np.ndarray) -> np.ndarray:
    """For every acquire the number of the one that opens the next hold if it opens one (len: none in its group).

    Rows are sorted by (group, at, seq).
    """
    n = len(at)
    nxt = _before(group, at, seq, group, end, end_seq)
    stays = (nxt < n) & (group[np.minimum(nxt, n - 1)] == group) if n else np.zeros(0, bool)
    return np.where(stays, nxt, n)


def _opened(nxt: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The acquires that open a hold, following the jumps of all groups at once."""
    out = np.zeros(len(nxt) + 1, bool)
    now = first[first < len(nxt)]
    while len(now):
        out[now] = True
        now = nxt[now]
        now = now[now < len(nxt)]
    return out[:-1]


def _leaving(nxt: np.ndarray) -> np.ndarray:
    """For every acquire the last one of its group that opens a hold if it opens one (pointer doubling)."""
    n = len(nxt)
    to = np.where(nxt < n, nxt, np.arange(n))
    while True:
        then = to[to]
        if (then == to).all():
            return to
        to = then


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups (rows come sorted by ``names``) of about ``BATCH_ROWS`` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(held)
        last = np.flatnonzero(_group_numbers(table, names) != _group_numbers(table, names)[-1])
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _group_numbers(table: pa.Table, names: list[str]) -> np.ndarray:
    """0, 1, ... along the rows, one more where a column of ``names`` changes (nulls equal each other)."""
    new = np.zeros(table.num_rows, bool)
    for c in names:
        column = pa.concat_arrays(table.column(c).chunks)
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def _places(table: pa.Table) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in ("_at", "_at_seq", "_end", "_end_seq")]


def _replayed(acquires: DataFrame, groups: list[str]) -> DataFrame:
    """The acquires that open a hold; each group starts behind the place (``_in``, ``_in_seq``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, groups):
            g = _group_numbers(table, groups)
            at, seq, end, end_seq = _places(table)
            head = np.flatnonzero(np.diff(g, prepend=-1))
            came, came_seq = (table.column(c).to_numpy()[head] for c in ("_in", "_in_seq"))
            first = _before(g, at, seq, g[head], came, came_seq)
            first = np.where((first < len(g)) & (g[np.minimum(first, len(g) - 1)] == g[head]), first, len(g))
            opened = _opened(next_openers(g, at, seq, end, end_seq), first)
            yield from table.filter(pa.array(opened)).to_batches()

    by = [F.col(c) for c in groups]
    dealt = acquires.repartition(*by).sortWithinPartitions(*by, "_at", "_at_seq")
    return dealt.mapInArrow(run, acquires.schema)


def _range_functions(acquires: DataFrame, key: str) -> DataFrame:
    """Per range of a key: runs of acquires (up to ``_at``, ``_at_seq``) and the end with which the last hold
    that starts in the range leaves it, whichever acquire of the run opens the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, [key, "_range"]):
            g = _group_numbers(table, [key, "_range"])
            at, seq, end, end_seq = _places(table)
            out = _leaving(next_openers(g, at, seq, end, end_seq))
            last = np.ones(len(g), bool)
            last[:-1] = (g[1:] != g[:-1]) | (end[out[1:]] != end[out[:-1]]) | (end_seq[out[1:]] != end_seq[out[:-1]])
            rows = np.flatnonzero(last)
            picked = table.select([key, "_range", "_at", "_at_seq"]).take(pa.array(rows))
            yield from (
                picked.append_column("_end", pa.array(end[out[rows]], pa.int64()))
                .append_column("_end_seq", pa.array(end_seq[out[rows]], pa.int64()))
                .to_batches()
            )

    kept = acquires.select(key, "_range", "_at", "_at_seq", "_end", "_end_seq")
    dealt = kept.repartition(key, "_range").sortWithinPartitions(key, "_range", "_at", "_at_seq")
    return dealt.mapInArrow(run, kept.schema)


def _entered(functions: DataFrame, key: str) -> DataFrame:
    """(key, range, _in, _in_seq): the ranges in which holds start, and the end that comes into each."""
    kind = functions.schema[key].dataType.simpleString()

    def follow(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_at", "ascending"), ("_at_seq", "ascending")])
        at, seq, end, end_seq = _places(table)
        none = np.zeros(len(at), np.int64)
        nxt = _before(none, at, seq, none, end, end_seq)  # the run that the end falls into
        out, now, came, came_seq = [], 0, _FIRST, 0
        while now < len(at):
            out.append((now, came, came_seq))
            came, came_seq, now = int(end[now]), int(end_seq[now]), int(nxt[now])
        rows = pa.array([r[0] for r in out], pa.int64())
        some = table.select([key, "_range"]).take(rows)
        return some.append_column("_in", pa.array([r[1] for r in out], pa.int64())).append_column(
            "_in_seq", pa.array([r[2] for r in out], pa.int64())
        )

    schema = f"`{key}` {kind}, _range int, _in bigint, _in_seq bigint"
    return functions.groupBy(key).applyInArrow(follow, schema)


def lock_holds(
    touches: DataFrame,
    ttl_seconds: int,
    key: str = "lease_key",
    holder: str = "holder",
    ts: str = "ts",
    seq: str = "seq",
    hot_rows: int | None = None,
    range_rows: int | None = None,
) -> DataFrame:
    """Holds (key, holder, hold_no, from_ts, last_touch, touches, until_ts, released) of a request log.

    ``touches`` has an ``op`` column (acquire, refresh, release); ``seq`` breaks ties of ``ts``.  Holds of a key
    never overlap.  ``hold_no`` counts a holder's holds of the key; a released hold ends at its release.
    """
    most = HOT_ROWS if hot_rows is None else hot_rows
    size = RANGE_ROWS if range_rows is None else range_rows
    hot_holder = ordered.has_hot_key(touches, [key, holder])
    acquires = _opening_acquires(touches, ttl_seconds, key, holder, ts, seq, hot_holder)
    start = {"_in": F.lit(_FIRST), "_in_seq": F.lit(0).cast("bigint")}
    counts = touches.filter(F.col("op") == "acquire").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > most).collect()  # at most rows / hot_rows keys
    if not large:
        opened = _replayed(acquires.withColumns(start), [key])
    else:
        names = touches.sparkSession.createDataFrame([(r[key],) for r in large], f"hot_key {touches.schema[key].dataType.simpleString()}")
        is_hot = acquires[key].eqNullSafe(names["hot_key"])
        cold = acquires.join(F.broadcast(names), is_hot, "left_anti")
        ranges = max(2, -(-sum(r["_n"] for r in large) // size))
        mine = acquires.join(F.broadcast(names), is_hot, "left_semi").repartitionByRange(ranges, key, "_at", "_at_seq")
        # Range bounds are sampled: the rows are written once, so that all passes see the same ranges.
        fixed = ordered.pinned(mine.withColumn("_range", F.spark_partition_id()))
        came = _entered(_range_functions(fixed, key), key).withColumnsRenamed({key: "_key_r", "_range": "_range_r"})
        placed = fixed.join(came, fixed[key].eqNullSafe(came["_key_r"]) & (fixed["_range"] == came["_range_r"]))
        opened = _replayed(placed.drop("_key_r", "_range_r"), [key, "_range"]).drop("_range")
        opened = opened.unionByName(_replayed(cold.withColumns(start), [key]))
    until = F.when(F.col("released"), F.col("last_touch")).otherwise(
        F.col("last_touch") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    )
    numbered = ordered.running_sums(
        opened, [key, holder], ["_at", "_at_seq"], None, {"hold_no": F.lit(1).cast("bigint")},
        levels=0, hot=hot_holder,
    )
    return numbered.select(
        key, holder, "hold_no", F.col(ts).alias("from_ts"), "last_touch", "touches",
        until.cast(touches.schema[ts].dataType).alias("until_ts"), "released",
    )
