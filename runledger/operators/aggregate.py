"""Resumable aggregations and their checks: A4-A7, J11, W4, W5, W11, A9.

Word count and matrix product are plain hash aggregates (partial aggregation
map-side, so a hot word or hot cell is combined before the shuffle).
Fingerprints are distributive -- a sum of per-row hashes mod 2^64 -- so two
runs agree iff their tables agree regardless of partitioning or order.
Cadence snapshots need running counts along an order per key; they use the
bucketed running sums of ``ordered`` so one huge key is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.scalar import U64, u64_fingerprint
from runledger.operators import ordered
from runledger.schemas import RECENT_RING_CAP

TOKEN_PATTERN = r"[^\p{L}]+"


def tokenize(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lower-cased letter runs of the whole text; empty tokens dropped."""
    return docs.select(*keep, F.explode(F.split(F.lower(F.col(text)), TOKEN_PATTERN)).alias("word")).filter(
        F.col("word") != ""
    )


def word_count(tokens: DataFrame, word: str = "word") -> DataFrame:
    """A4: count per word."""
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias("n"))


def count_fingerprint(counts: DataFrame, key: str = "word", value: str = "n") -> DataFrame:
    """A5: order-free fingerprint of a (key, count) table, plus its size."""
    h = u64_fingerprint(F.concat(F.col(key).cast("string"), F.lit(":"), F.col(value).cast("string")))
    return counts.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col(value)).cast("bigint").alias("total"),
        F.pmod(F.sum(h), F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias("fingerprint"),
    )


def total_check(tokens: DataFrame, counts: DataFrame, value: str = "n") -> DataFrame:
    """The counts add up to the number of tokens."""
    a = tokens.select(F.lit("t").alias("_s"), F.lit(1).cast("bigint").alias("_v"))
    b = counts.select(F.lit("c").alias("_s"), F.col(value).cast("bigint").alias("_v"))
    both = a.unionByName(b).agg(
        F.coalesce(F.sum(F.when(F.col("_s") == "t", F.col("_v"))), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.coalesce(F.sum(F.when(F.col("_s") == "c", F.col("_v"))), F.lit(0)).cast("bigint").alias("sum_counts"),
    )
    return both.withColumn("ok", F.col("n_tokens") == F.col("sum_counts"))


def matrix_product(a: DataFrame, b: DataFrame, hot_rows: int = 1_000_000) -> DataFrame:
    """C = A . B in coordinate form; cells wrap modulo 2^64.

    ``a``: (i, k, v), ``b``: (k, j, v).  Equi-join on k and a hash aggregate
    on (i, j); partial sums are combined map-side.  A k with more than
    ``hot_rows`` rows of A (at most rows / hot_rows of them, so the set is
    broadcast) is salted: A's rows are dealt out by i, and B's rows of that k
    are repeated once per salt.  Sums are decimals, so no cell overflows.
    """
    dealt = a.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = F.broadcast(dealt.select("k", F.ceil(F.col("_n") / F.lit(float(hot_rows))).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = a.join(hot, "k", "left").select(
        "i", "k", F.pmod(F.xxhash64("i"), salts).cast("int").alias("_salt"), F.col("v").cast("decimal(20,0)").alias("av")
    )
    right = b.join(hot, "k", "left").select(
        "k", "j", F.col("v").cast("decimal(20,0)").alias("bv"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt")
    )
    cell = F.sum((F.col("av") * F.col("bv")).cast("decimal(38,0)"))
    wrapped = F.pmod(cell, F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)")
    return left.join(right, ["k", "_salt"]).groupBy("i", "j").agg(wrapped.alias("c"))


TILE = 128
_BAND = 512  # tiles of one band: packed together they still are one window partition of bounded size
_HELD_CELLS = 4_000_000
_PAIRS = 1_000_000


def _tiles(m: DataFrame, row: str, col: str, tile: int) -> DataFrame:
    """Blocks of a matrix: (tile row, tile column, cells), the place of a cell within its block as row * tile + column."""
    at = (F.pmod(row, F.lit(tile)) * tile + F.pmod(col, F.lit(tile))).cast("int")
    placed = m.select(
        F.floor(F.col(row) / tile).cast("bigint").alias("tr"),
        F.floor(F.col(col) / tile).cast("bigint").alias("tc"),
        F.struct(at.alias("at"), F.col("v").cast("bigint").alias("v")).alias("cell"),
    )
    return placed.groupBy("tr", "tc").agg(F.collect_list("cell").alias("cells"))


def _packed(tiles: DataFrame, shared: str, along: str, tile: int) -> DataFrame:
    """Neighbouring tiles of one ``shared`` tile, packed until they hold tile^2 cells: (k, band, tiles).

    A full tile stays alone; of a sparse matrix a pack holds as many cells as a full tile, so the number of
    packs follows the cells, not the area.  A pack has less than 2 * tile^2 cells.
    """
    band = F.floor(F.col(along) / _BAND).alias("band")
    before = Window.partitionBy("k", "band").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.size("cells")).over(before), F.lit(0))
    placed = tiles.select(F.col(shared).alias("k"), band, F.col(along).alias("t"), "cells")
    packs = placed.select("*", F.floor(filled / (tile * tile)).alias("pack"))
    return packs.groupBy("k", "band", "pack").agg(F.collect_list(F.struct("t", "cells")).alias("tiles"))


def _products(x: tuple, y: tuple, tile: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, product) cells of two packs, given as arrays (outer coordinate, k within the tile, value).

    Full packs are multiplied as arrays; sparse ones by the cells that share k, so the work follows the
    multiplications.  A step holds a bounded number of cells.
    """
    (i, ki, a), (j, kj, b) = x, y
    order = np.argsort(kj, kind="stable")
    j, kj, b = j[order], kj[order], b[order]
    first = np.searchsorted(kj, np.arange(tile + 1))
    each = np.diff(first)[ki]
    rows, ri = np.unique(i, return_inverse=True)
    cols, cj = np.unique(j, return_inverse=True)
    area = len(rows) * len(cols)
    if area <= 4 * tile * tile and len(rows) <= 4 * tile and len(cols) <= 4 * tile and area * tile < 8 * each.sum():
        left, right = np.zeros((len(rows), tile), np.uint64), np.zeros((tile, len(cols)), np.uint64)
        np.add.at(left, (ri, ki), a)
        np.add.at(right, (kj, cj), b)
        has_left, has_right = np.zeros(left.shape, np.float32), np.zeros(right.shape, np.float32)
        has_left[ri, ki], has_right[kj, cj] = 1, 1
        r, c = np.nonzero((has_left @ has_right) > 0)
        yield rows[r], cols[c], (left @ right)[r, c]  # unsigned, so products and sums wrap
        return
    ends = np.cumsum(each)
    lo, done = 0, 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(ends, done + _PAIRS, side="right")))
        n = each[lo:hi]
        mine = np.repeat(np.arange(lo, hi), n)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + first[ki[mine]]
        yield i[mine], j[other], a[mine] * b[other]
        lo, done = hi, int(ends[hi - 1])


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Cells (place ..., value) with equal places added up, in the order of their places."""
    *places, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort(places[::-1])
    places, value = [p[order] for p in places], value[order]
    new = np.ones(len(value), bool)
    new[1:] = np.any([p[1:] != p[:-1] for p in places], axis=0)
    heads = np.flatnonzero(new)
    return (*(p[heads] for p in places), np.add.reduceat(value, heads) if len(heads) else value)


def _slices(values: np.ndarray, heads: np.ndarray) -> pa.Array:
    """One binary value per slice of ``values``."""
    ends = (np.append(heads, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _joined(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all slices, and how many each has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw.view(dtype) if len(raw) else np.zeros(0, dtype), np.diff(ends) // size


def matrix_product_tiles(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """J11 by blocks: C = A . B, cells wrap modulo 2^64.

    ``a``: (i, k, v), ``b``: (k, j, v), one row per cell, no null coordinates.  Both become blocks of ``tile`` x ``tile`` cells,
    and neighbouring sparse blocks one pack of as many cells as a full block; packs that share k meet and are multiplied,
    full ones as arrays, sparse ones by their cells.  The products of one place are added up: in the task first, then after
    one shuffle of the cells of each place.  That moves tile^2 cells per product of full blocks instead of one
    row per multiplication (tile^3), and never a cell that no multiplication gives.  A pack, and what a task holds,
    is bounded.  A cell is in the result if some k has both factors, as in ``matrix_product``.
    """

    def pack(tiles: pa.Array, k_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat = tiles.flatten()
        cells = flat.field("cells")
        flat_cells = cells.flatten()
        at = flat_cells.field("at").to_numpy().astype(np.int64)
        base = np.repeat(flat.field("t").to_numpy() * tile, cells.value_lengths().to_numpy())
        k, outer = (at // tile, at % tile) if k_first else (at % tile, at // tile)
        return base + outer, k, flat_cells.field("v").to_numpy().view(np.uint64)

    def emit(held: list) -> pa.RecordBatch:
        i, j, v = held[0]
        tr, tc = i // tile, j // tile
        tr, tc, at, v = _summed([(tr, tc, (i - tr * tile) * tile + (j - tc * tile), v)])
        new = np.ones(len(v), bool)
        new[1:] = (tr[1:] != tr[:-1]) | (tc[1:] != tc[:-1])
        heads = np.flatnonzero(new)
        columns = [pa.array(tr[heads]), pa.array(tc[heads]), _slices(at.astype(np.int32), heads), _slices(v, heads)]
        return pa.RecordBatch.from_arrays(columns, ["tr", "tc", "at", "cells"])

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (pack(batch.column(c).slice(r, 1), c == 1) for c in (0, 1))
                for cells in _products(x, y, tile):
                    held.append(cells)
                    n += len(cells[0])
                    if n >= _HELD_CELLS:
                        held = [_summed(held)]
                        n = len(held[0][0])
                        if n > _HELD_CELLS // 2:
                            yield emit(held)
                            held, n = [], 0
        if n:
            yield emit([_summed(held)])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell_rows(cells: tuple) -> pa.RecordBatch:
            tr, tc, at, v = cells
            columns = [pa.array(tr * tile + at // tile), pa.array(tc * tile + at % tile), pa.array(v.view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["i", "j", "c"])

        held = None  # the last place, which may go on in the next batch
        for batch in batches:
            at, sizes = _joined(batch.column(2), np.int32)
            v, _ = _joined(batch.column(3), np.uint64)
            part = (*(np.repeat(batch.column(c).to_numpy(), sizes) for c in (0, 1)), at.astype(np.int64), v)
            cells = _summed([part] if held is None else [held, part])
            if not len(cells[0]):
                continue
            last = (cells[0] == cells[0][-1]) & (cells[1] == cells[1][-1])
            held = tuple(c[last] for c in cells)
            if not last.all():
                yield cell_rows(tuple(c[~last] for c in cells))
        if held is not None:
            yield cell_rows(held)

    left = _packed(_tiles(a, "i", "k", tile), "tc", "tr", tile).select("k", F.col("tiles").alias("x"))
    right = _packed(_tiles(b, "k", "j", tile), "tr", "tc", tile).select("k", F.col("tiles").alias("y"))
    pairs = left.join(right, "k").select("x", "y")
    blocks = pairs.mapInArrow(multiplied, "tr bigint, tc bigint, at binary, cells binary")
    dealt = blocks.repartition("tr", "tc").sortWithinPartitions("tr", "tc")
    signed = dealt.mapInArrow(added, "i bigint, j bigint, c bigint")
    wide = F.col("c").cast("decimal(20,0)")
    whole = F.when(F.col("c") < 0, wide + F.lit(str(U64)).cast("decimal(20,0)")).otherwise(wide)
    return signed.select("i", "j", whole.cast("decimal(20,0)").alias("c"))


def matrix_fingerprint(c: DataFrame, value: str = "c") -> DataFrame:
    """Number of cells and the sum of cells mod 2^64 (pmod, so negatives wrap)."""
    return c.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.pmod(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)").alias("sum_cells"),
    )


def _positions(rows: DataFrame, key: str, order: Sequence[str], bucket: F.Column | None, hit: str, hot: bool | None) -> DataFrame:
    """Running row position and hit count per key, with the key's totals."""
    if hot is None:
        hot = ordered.has_hot_key(rows, [key])
    run = ordered.running_sums(
        rows,
        [key],
        order,
        bucket,
        {"pos": F.lit(1).cast("bigint"), "hits": F.col(hit).cast("bigint")},
        levels=0,
        hot=hot,
    )
    if hot:
        totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(hit)).alias("total_hits"))
        return run.join(totals.withColumnRenamed(key, "_k"), run[key].eqNullSafe(F.col("_k"))).drop("_k")
    w = Window.partitionBy(key)
    return run.select("*", F.count(F.lit(1)).over(w).alias("total"), F.count_if(F.col(hit)).over(w).alias("total_hits"))


def _progress(pos: F.Column, total: F.Column) -> F.Column:
    # One IEEE division, so both engines give the same double; no rounding.
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), pos / total))


def cadence_snapshots(
    rows: DataFrame, key: str, order: Sequence[str], bucket: F.Column | None, k: int, hit: str = "hit", hot: bool | None = None
) -> DataFrame:
    """A snapshot at every k-th hit of a key, plus one final snapshot.

    Snapshot: epoch (1, 2, ...), cursor (rows consumed), found (hits so far),
    progress = min(1, cursor / total).  The final snapshot always follows, so
    when the hit total is a multiple of k the last two carry the same count
    with epochs e and e + 1 (D13).  A key's last row gives both.
    """
    p = _positions(rows, key, order, bucket, hit, hot)

    def snapshot(when, epoch, progress, final):
        fields = [epoch.cast("bigint").alias("epoch"), F.col("pos").alias("cursor"), F.col("hits").alias("found")]
        return F.when(when, F.struct(*fields, progress.alias("progress"), F.lit(final).alias("final")))

    every = snapshot(F.col(hit) & (F.col("hits") % k == 0), F.col("hits") / k, _progress(F.col("pos"), F.col("total")), False)
    last = snapshot(F.col("pos") == F.col("total"), F.floor(F.col("hits") / k) + 1, F.lit(1.0), True)
    return p.select(key, F.explode(F.filter(F.array(every, last), lambda x: x.isNotNull())).alias("s")).select(key, "s.*")


def resumed_snapshots(
    rows: DataFrame, key: str, attempt: str, order: Sequence[str], bucket: F.Column | None, k: int, hit: str = "hit", hot: bool | None = None
) -> DataFrame:
    """W4 for jobs that resume: the cadence and the epochs begin anew in every attempt.

    A snapshot at every k-th hit of an attempt; cursor and found go on over the whole job.  The job's last row
    gives the final snapshot of its last attempt.  The counts within an attempt are running sums of their own, so
    an attempt border inside or between buckets resets them alike.
    """
    if hot is None:
        hot = ordered.has_hot_key(rows, [key])
    p = _positions(rows, key, order, bucket, hit, hot)
    p = ordered.running_sums(p, [key, attempt], order, bucket, {"run_hits": F.col(hit).cast("bigint")}, levels=0, hot=hot)

    def snapshot(when, epoch, progress, final):
        fields = [epoch.cast("bigint").alias("epoch"), F.col("pos").alias("cursor"), F.col("hits").alias("found")]
        return F.when(when, F.struct(*fields, progress.alias("progress"), F.lit(final).alias("final")))

    every = snapshot(F.col(hit) & (F.col("run_hits") % k == 0), F.col("run_hits") / k, _progress(F.col("pos"), F.col("total")), False)
    last = snapshot(F.col("pos") == F.col("total"), F.floor(F.col("run_hits") / k) + 1, F.lit(1.0), True)
    found = F.explode(F.filter(F.array(every, last), lambda x: x.isNotNull()))
    return p.select(key, attempt, found.alias("s")).select(key, attempt, "s.*")


def progress_curve(
    rows: DataFrame, key: str, order: Sequence[str], bucket: F.Column | None, hit: str = "hit", hot: bool | None = None
) -> DataFrame:
    """Progress of every row: min(1, position / total), 0 when total is 0."""
    p = _positions(rows, key, order, bucket, hit, hot)
    return p.withColumn("progress", _progress(F.col("pos"), F.col("total"))).drop("total", "total_hits")


def tail_ring(rows: DataFrame, key: str, order: Sequence[str], hit: str = "hit", cap: int = RECENT_RING_CAP) -> DataFrame:
    """The last ``cap`` hits of each key, oldest first (ring_pos 1..n).

    ``row_number() <= cap`` is planned as a partial WindowGroupLimit before the
    shuffle, so each task forwards at most ``cap`` rows per key.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    last = rows.filter(F.col(hit)).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return last.withColumn("ring_pos", (n - F.col("_rn") + 1).cast("int")).drop("_rn")


def last_found(wlog: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """The last reported `found` (u64) of each job's log; none -> 0.

    A report without the field does not count.
    """
    seen = F.col("type").isin("checkpoint", "completed") & F.col("found").isNotNull()
    last = F.max_by(F.when(seen, F.col("found")), F.when(seen, F.col(seq))).cast("decimal(20,0)")
    return wlog.groupBy(key).agg(F.coalesce(last, F.lit(0).cast("decimal(20,0)")).alias("last_found"))


def global_cadence(rows: DataFrame, order: Sequence[str], k: int, hit: str = "hit") -> DataFrame:
    """W4 for one global order: a snapshot at every k-th hit plus a final one.

    Positions come from ``ordered.global_running_sums`` (range partitions and
    per-partition offsets), never from an unpartitioned window.
    """
    run = ordered.global_running_sums(
        rows, order, {"pos": F.lit(1), "hits": F.col(hit).cast("bigint")}
    )
    tot = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(hit)).alias("total_hits"))
    t = tot.first()
    total, total_hits = int(t["total"]), int(t["total_hits"])
    snaps = run.filter(F.col(hit) & (F.col("hits") % k == 0)).select(
        *order,
        (F.col("hits") / k).cast("bigint").alias("epoch"),
        F.col("pos").alias("cursor"),
        F.col("hits").alias("found"),
        _progress(F.col("pos"), F.lit(total)).alias("progress"),
        F.lit(False).alias("final"),
    )
    spark = rows.sparkSession
    final = spark.range(1).select(
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order],
        F.lit(total_hits // k + 1).cast("bigint").alias("epoch"),
        F.lit(total).cast("bigint").alias("cursor"),
        F.lit(total_hits).cast("bigint").alias("found"),
        F.lit(1.0).alias("progress"),
        F.lit(True).alias("final"),
    )
    return snaps.unionByName(final)
