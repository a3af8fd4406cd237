"""Exact substring deduplication: every byte in a ``LENGTH``-byte string that starts twice goes.

Strings are compared by a hash-compared suffix sort, dealt out so that equal
strings meet in one task:

* Each start of a ``LENGTH``-byte window has an anchor: the leftmost smallest
  hash of the ``GRAM``-byte strings inside the window.  Equal windows have
  equal anchors at equal offsets.  The starts that share an anchor make one
  segment; there is about one per 170 bytes.
* A segment is described by the anchor's hash (its key) and two 64-bit
  polynomial hashes of its bytes.  Keys that occur once are unique text and go
  no further, which is most of a corpus.  Where a whole segment occurs twice
  all its windows do.  These counts are aggregates with map-side combining, so
  a passage in a third of all documents costs one row per map task.
* Keys with several distinct segments get their bytes: one representative per
  distinct segment.  A task concatenates them and sorts the suffixes at the
  window starts: by their first eight bytes, then, where those tie, by a
  mergesort whose comparisons take the common extension of two suffixes from
  prefix polynomial hashes by binary search.  Neighbours with a common extension of
  ``LENGTH`` are repeated windows; their bytes are compared, so a hash
  collision removes nothing at this step.
* A key with more than ``VARIANTS`` distinct segments is too large for one
  task: its windows are counted by 128-bit hashes instead, with map-side
  combining.

Three removals rest on two 64-bit hashes alone, their bytes are not compared:
whole repeated segments (key and two polynomial hashes), copies of a text (two
xxhash64 values) and the windows of keys beyond ``VARIANTS``.

Copies of one text are folded to one class first: each byte of a repeated
text of at least ``LENGTH`` bytes repeats, and one copy stands for all of them
towards other texts.  Results belong to classes, so a document's result does not
depend on its place.

Texts travel at most twice, keyed by class (to fetch segments, to cut); while
the classes concerned are within the checked bound, their 16-byte keys are
broadcast first and only the texts concerned travel.  Texts go to Python in
Arrow batches of about ``BATCH_BYTES``, since JVM and worker both hold a batch
more than once; documents without a cut, and copies, don't go there to be cut.

Defined cases: null and empty texts and texts shorter than ``LENGTH`` keep all
bytes; repeated rows are copies of each other; a text longer than ``BUFFER`` is worked on alone, memory follows
it; an empty table gives an empty
result.  Only ``doc_id`` and ``text`` are read.  Removing bytes may cut inside a
character, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.workers import send_package
from runledger.session import scratch_path

LENGTH = 400
GRAM = 200
VARIANTS = 4000
BUFFER = 300_000
SORT_BYTES = 600_000
BATCH_BYTES = 4_000_000
BROADCAST_ROWS = 500_000
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_U = np.uint64


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i < n."""
    inverse = _U(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hashes:
    """Prefix polynomial hashes of a buffer, for two bases or the first only."""

    def __init__(self, bases: int = 2):
        self.bases, self.size = (_B1, _B2)[:bases], 0
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []

    def load(self, data: np.ndarray) -> None:
        if len(data) + 1 > self.size:
            self.size = max(len(data) + 1, BUFFER + 1)
            self.tables = [_powers(b, self.size) for b in self.bases]
        raw = data.astype(np.uint64) + _U(1)
        self.prefix = []
        for p, _ in self.tables:
            h = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(raw * p[: len(raw)], out=h[1:])
            self.prefix.append(h)

    def between(self, a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of data[a:b], the same wherever those bytes stand."""
        h, inverse = self.prefix[which], self.tables[which][1]
        return (h[b] - h[a]) * inverse[a]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i + w] for every i, in linear time."""
    n = len(x)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def segments_of(g: np.ndarray, valid: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of the maximal runs of valid window starts with one anchor."""
    m = sliding_min(g, w)
    n = len(m)
    edge = np.ones(n, bool)
    edge[1:] = (m[1:] != m[:-1]) | (valid[1:n] != valid[: n - 1])
    first = np.flatnonzero(edge)
    last = np.concatenate([first[1:], [n]]) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return first, first, first
    # positions of the values that are some window's minimum, in (value, position) order
    values, rank = np.unique(m[first], return_inverse=True)
    at = np.searchsorted(values, g)
    hit = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == g)
    span = _U(len(g) + 1)
    places = np.sort(at[hit].astype(np.uint64) * span + hit.astype(np.uint64))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rank = rank.astype(np.uint64)
    for turn in range(100):
        if turn == 3:  # dense ties: every remaining start on its own
            counts = last - first + 1
            base = np.repeat(first - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            rank = np.repeat(rank, counts)
            first = base + np.arange(len(base))
            last = first
        pos = (places[np.searchsorted(places, rank * span + first.astype(np.uint64))] - rank * span).astype(np.int64)
        out.append((pos, first, np.minimum(last, pos)))
        more = last > pos
        if not more.any():
            break
        first, last, rank = pos[more] + 1, last[more], rank[more]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def text_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text and the class (c1, c2): two 64-bit hashes of the text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("c1"), F.xxhash64(F.lit(1), t).alias("c2"))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs inside hand rows to Python in batches of ``BATCH_BYTES`` and at most one row more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-suffix-{name}")
    with _small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLASS = ["c1", "c2"]


def _few(side: DataFrame) -> bool:
    return side.count() <= BROADCAST_ROWS


def _matched(texts: DataFrame, side: DataFrame) -> DataFrame:
    """Texts joined with their class's row of ``side``; if that has few rows, other texts don't travel."""
    if _few(side):
        texts = texts.join(F.broadcast(side.select(*_CLASS)), _CLASS, "left_semi")
    return texts.join(side, _CLASS)


def _ranges(a: np.ndarray, b: np.ndarray) -> list[dict]:
    """Union of the half-open ranges [a, b), sorted."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(a)]]) - 1
    return [{"a": int(x), "b": int(y)} for x, y in zip(a[starts], b[ends], strict=True)]


_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_SEGMENT = "c1 bigint, c2 bigint, key bigint, s1 bigint, s2 bigint, n int, ws int, we int, own array<struct<a:bigint,b:bigint>>"


def segment_rows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per distinct segment of a text: key, hashes, how often in the text, first place;
    where more than once, also the bytes that all its places cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        gram = min(GRAM, length)
        for batch in batches:
            c1, c2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            held: list[bytes] = []
            rows: list[int] = []
            for i, t in enumerate(batch.column(0)):
                raw = t.as_buffer().to_pybytes()
                if len(raw) < length:
                    continue
                if held and sum(map(len, held)) + len(raw) > BUFFER:
                    yield from emit(hashes, held, np.array(rows), c1, c2, gram)
                    held, rows = [], []
                held.append(raw)
                rows.append(i)
            if held:
                yield from emit(hashes, held, np.array(rows), c1, c2, gram)

    def emit(hashes, held, rows, c1, c2, gram) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(x) for x in held])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(held), np.uint8)
        hashes.load(data)
        n = len(data) - length + 1
        g = _mixed(hashes.between(np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1)))
        valid = np.zeros(n, bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            valid[a : b - length + 1] = True
        pos, ws, we = segments_of(g, valid, length - gram + 1)
        doc = np.searchsorted(edges, ws, side="right") - 1
        shape = _mixed(((pos - ws) * 4096 + (we - ws)).astype(np.uint64) + _U(1))
        s1 = _mixed(hashes.between(ws, we + length, 0) + shape)
        s2 = _mixed(hashes.between(ws, we + length, 1) ^ shape)
        order = np.lexsort((ws, s2, s1, doc))
        pos, ws, we, doc, s1, s2 = (x[order] for x in (pos, ws, we, doc, s1, s2))
        new = np.ones(len(ws), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.concatenate([first, [len(ws)]]))
        base = edges[doc]
        own: list[list[dict] | None] = [None] * len(first)
        for k in np.flatnonzero(counts > 1):
            some = slice(first[k], first[k] + counts[k])
            own[k] = _ranges(ws[some] - base[some], we[some] + length - base[some])
        signed = lambda x: pa.array(x.view(np.int64), pa.int64())
        at = rows[doc[first]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(c1[at], pa.int64()),
                pa.array(c2[at], pa.int64()),
                signed(g[pos[first]]),
                signed(s1[first]),
                signed(s2[first]),
                pa.array(counts, pa.int32()),
                pa.array((ws - base)[first], pa.int32()),
                pa.array((we - base)[first], pa.int32()),
                pa.array(own, _RANGES),
            ],
            ["c1", "c2", "key", "s1", "s2", "n", "ws", "we", "own"],
        )

    return texts.select("text", "c1", "c2").mapInArrow(run, _SEGMENT)


class SuffixSort:
    """Sorts suffixes at given places of a buffer by their first ``length`` bytes."""

    def __init__(self, length: int):
        self.length, self.hashes = length, Hashes(1)

    def _less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before y; equal ones keep the order of their places."""
        same = self.window[x] == self.window[y]
        out = x < y
        odd = np.flatnonzero(~same)
        a, b = self.places[x[odd]], self.places[y[odd]]
        low, high = np.zeros(len(odd), np.int64), np.full(len(odd), self.length)
        while (low < high - 1).any():  # data[a:a+low] is common, data[a:a+high] is not
            mid = (low + high) // 2
            eq = self.hashes.between(a, a + mid) == self.hashes.between(b, b + mid)
            low, high = np.where(eq, mid, low), np.where(eq, high, mid)
        out[odd] = self.data[a + low] < self.data[b + low]
        return out

    def sort(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Numbers of ``places`` in suffix order; every place has ``length`` bytes after it."""
        self.data, self.places = data, places
        self.hashes.load(data)
        self.window = self.hashes.between(places, places + self.length)
        head = np.zeros(len(places), np.uint64)
        for k in range(8):
            head = head << _U(8) | data[places + k]
        order = np.argsort(head, kind="stable")
        h = head[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(h)]]))
        width = 1
        while width < size.max(initial=0):
            live = np.flatnonzero(size[group] > width)
            order[live] = self._merged(order, live, start[group[live]], size[group[live]], width)
            width *= 2
        return order

    def _merged(self, order, at, start, size, width):
        """One level of the mergesort: runs of ``width`` inside each group of equal heads are merged in pairs."""
        inside = at - start
        pair = inside // (2 * width) * (2 * width)
        right = (inside - pair) >= width
        left_n = np.minimum(width, size - pair)
        right_n = np.minimum(2 * width, size - pair) - left_n
        base = start + pair
        other = np.where(right, base, base + left_n)
        low, high = np.zeros(len(at), np.int64), np.where(right, left_n, right_n)
        mine = order[at]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            before = self._less(order[other[open_] + mid], mine[open_])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
            open_ = open_[low[open_] < high[open_]]
        target = base + np.where(right, inside - pair - left_n, inside - pair) + low
        out = np.empty_like(mine)
        out[np.searchsorted(at, target)] = mine
        return out

    def repeated(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which places start a string of ``length`` bytes that starts at another place too."""
        order = self.sort(data, places)
        out = np.zeros(len(places), bool)
        twin = np.flatnonzero(self.window[order[1:]] == self.window[order[:-1]])
        if not len(twin):
            return out
        x, y = order[twin], order[twin + 1]
        true = self._same_bytes(places[x], places[y])
        out[x[true]] = True
        out[y[true]] = True
        for w in np.unique(self.window[x[~true]]):  # a collision: by the bytes themselves
            seen: dict[bytes, list[int]] = {}
            for k in np.flatnonzero(self.window == w):
                seen.setdefault(data[places[k] : places[k] + self.length].tobytes(), []).append(int(k))
            for ks in seen.values():
                out[ks] = len(ks) > 1
        return out

    def _same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Byte comparison of the windows at a and b; runs along one diagonal are compared once."""
        order = np.lexsort((a, b - a))
        x, d = a[order], (b - a)[order]
        new = np.ones(len(x), bool)
        new[1:] = (d[1:] != d[:-1]) | (x[1:] > x[:-1] + self.length)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(x)]]) - 1
        good = np.ones(len(x), bool)
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            p, q, k = int(x[i]), int(x[j]) + self.length, int(d[i])
            if not np.array_equal(self.data[p:q], self.data[p + k : q + k]):
                for m in range(i, j + 1):
                    p = int(x[m])
                    good[m] = np.array_equal(self.data[p : p + self.length], self.data[p + k : p + k + self.length])
        out = np.empty_like(good)
        out[order] = good
        return out


def _flags_to_ranges(flags: np.ndarray, length: int) -> list[dict]:
    starts = np.flatnonzero(flags)
    return _ranges(starts, starts + length)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, variants: int = VARIANTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts with classes, classes that are copies, byte ranges to remove by class)."""
    texts = text_classes(docs)
    # null ids sort first, as no id; the smallest id names the copy that stands for its class
    copies = _written(
        texts.groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1"),
        "copies",
    )
    marks = F.broadcast(copies) if _few(copies) else copies
    alone = (
        texts.filter(F.octet_length("text") >= length)
        .join(marks, _CLASS, "left")
        .filter(F.col("copies").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id")))
        .select("text", "c1", "c2")
    )
    rows = _written(segment_rows(alone, length), "segments")
    # Unique text ends here: the count needs the keys only.
    keys = rows.groupBy("key").agg(F.sum("n").alias("total")).filter("total > 1").select("key")
    occ = _written(rows.join(keys, "key", "left_semi"), "repeated")
    first = F.struct("c1", "c2", "ws", "we").alias("first")
    distinct = _written(occ.groupBy("key", "s1", "s2").agg(F.sum("n").alias("n"), F.min(first).alias("first")), "distinct")
    variety = distinct.groupBy("key").agg(F.count("*").alias("variants")).filter("variants > 1")
    whole = distinct.filter("n > 1").select("key", "s1", "s2")
    asked = distinct.join(variety, "key").select(
        "first.c1", "first.c2", "first.ws", "first.we", "key", "s1", "s2", (F.col("n") > 1).alias("whole"),
        (F.col("variants") > variants).alias("hot"),
    )
    by_text = asked.groupBy("c1", "c2").agg(F.collect_list(F.struct("ws", "we", "key", "s1", "s2", "whole", "hot")).alias("asked"))
    by_text = _written(by_text, "asked")
    given = _matched(alone, by_text).select("text", "asked")
    sent = _written(_segment_bytes(given, length), "bytes")
    part = _sorted_ranges(sent.filter("not hot"), length).unionByName(_hot_ranges(sent.filter("hot"), length))
    part = _written(part, "ranges")
    # ranges of window starts -> of bytes, for every place of the segment
    partly = occ.join(part, ["key", "s1", "s2"]).select(
        "c1", "c2", F.transform("ranges", lambda r: F.struct((r["a"] + F.col("ws")).alias("a"), (r["b"] + F.col("ws")).alias("b"))).alias("r")
    )
    entire = F.array(F.struct(F.col("ws").cast("long").alias("a"), (F.col("we") + length).cast("long").alias("b")))
    fully = occ.join(whole, ["key", "s1", "s2"]).select("c1", "c2", F.coalesce("own", entire).alias("r"))
    ranges = (
        partly.unionByName(fully).groupBy("c1", "c2").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("ranges"))
    )
    return texts, copies, ranges


def _segment_bytes(given: DataFrame, length: int) -> DataFrame:
    """The bytes of the asked segments; of hot keys also, per window, two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for t, asked in zip(batch.column(0), batch.column(1), strict=True):
                raw = t.as_buffer().to_pybytes()
                out: dict[str, list] = {k: [] for k in ("key", "s1", "s2", "whole", "hot", "bytes", "h")}
                for s in asked.as_py():
                    part = raw[s["ws"] : s["we"] + length]
                    windows = None
                    if s["hot"]:
                        hashes.load(np.frombuffer(part, np.uint8))
                        a = np.arange(len(part) - length + 1)
                        pair = [_mixed(hashes.between(a, a + length, w)).view(np.int64) for w in (0, 1)]
                        windows = np.stack(pair, 1).tolist()
                    for k in ("key", "s1", "s2", "whole", "hot"):
                        out[k].append(s[k])
                    out["bytes"].append(None if s["hot"] else part)
                    out["h"].append(windows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(out[k], pa.int64()) for k in ("key", "s1", "s2")],
                        *[pa.array(out[k], pa.bool_()) for k in ("whole", "hot")],
                        pa.array(out["bytes"], pa.binary()),
                        pa.array(out["h"], pa.list_(pa.list_(pa.int64()))),
                    ],
                    ["key", "s1", "s2", "whole", "hot", "bytes", "h"],
                )

    return given.mapInArrow(
        run, "key bigint, s1 bigint, s2 bigint, whole boolean, hot boolean, bytes binary, h array<array<bigint>>"
    )


_FOUND = "key bigint, s1 bigint, s2 bigint, ranges array<struct<a:bigint,b:bigint>>"


def _sorted_ranges(sent: DataFrame, length: int) -> DataFrame:
    """Byte ranges (from the segment's first byte) of repeated windows, by suffix sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter = SuffixSort(length)
        held: list[tuple[int, int, int, bool, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > SORT_BYTES and row[0] != last:
                    yield solve(sorter, held)
                    held, size = [], 0
                held.append(row)
                last = row[0]
                size += len(row[4])
        if held:
            yield solve(sorter, held)

    def solve(sorter: SuffixSort, held) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in held), np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(r[4]) for r in held])])
        counts = np.diff(edges) - length + 1
        at = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(edges[:-1] - at[:-1], counts) + np.arange(at[-1])
        found = sorter.repeated(data, places)
        out: dict[str, list] = {k: [] for k in ("key", "s1", "s2", "ranges")}
        for (key, s1, s2, whole, _), a, b in zip(held, at[:-1].tolist(), at[1:].tolist(), strict=True):
            if not whole and found[a:b].any():
                out["key"].append(key)
                out["s1"].append(s1)
                out["s2"].append(s2)
                out["ranges"].append(_flags_to_ranges(found[a:b], length))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(out[k], pa.int64()) for k in ("key", "s1", "s2")], pa.array(out["ranges"], _RANGES)],
            ["key", "s1", "s2", "ranges"],
        )

    ordered = sent.select("key", "s1", "s2", "whole", "bytes").repartition("key").sortWithinPartitions("key", "s1", "s2")
    return ordered.mapInArrow(run, _FOUND)


def _hot_ranges(sent: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many distinct segments: windows are counted by their hashes."""
    windows = sent.select("key", "s1", "s2", "whole", F.posexplode("h").alias("o", "w")).select(
        "key", "s1", "s2", "whole", "o", F.col("w")[0].alias("h1"), F.col("w")[1].alias("h2")
    )
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("k")).filter("k > 1").select("h1", "h2")
    start = F.col("o").cast("long")
    return (
        windows.filter("not whole")
        .join(twice, ["h1", "h2"])
        .groupBy("key", "s1", "s2")
        .agg(F.collect_list(F.struct(start.alias("a"), (start + length).alias("b"))).alias("ranges"))
    )


def remove_repeated(docs: DataFrame, length: int = LENGTH, variants: int = VARIANTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the bytes that are kept."""
    send_package(docs.sparkSession)
    texts, copies, ranges = repeated_ranges(docs, length, variants)
    marks = F.broadcast(copies) if _few(copies) else copies
    ranges = _written(ranges.join(marks, _CLASS, "left_anti"), "cuts")  # copies go whole
    marked = texts.join(marks.select("c1", "c2", F.lit(True).alias("copied")), _CLASS, "left")
    if _few(ranges):  # only texts that are cut travel
        known = F.broadcast(ranges.select(*_CLASS))
        plain = marked.join(known, _CLASS, "left_anti")
        cut = marked.join(known, _CLASS, "left_semi").join(ranges, _CLASS)
    else:
        plain = marked.filter("copied")
        cut = marked.filter("copied is null").join(ranges, _CLASS, "left")
    return _uncut(plain, length).unionByName(_cut(cut))


def _uncut(plain: DataFrame, length: int) -> DataFrame:
    """Documents that go whole, as copies of at least ``length`` bytes do, or stay whole."""
    size = F.octet_length("text").cast("long")
    gone = F.col("copied").isNotNull() & (size >= length)
    return plain.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("n_bytes"),
        F.when(gone, size).otherwise(0).alias("n_removed"),
        gone.cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"),
    )


def _cut(cut: DataFrame) -> DataFrame:
    """Documents without the bytes of their ``ranges`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for doc_id, t, cuts in zip(*batch.columns, strict=True):
                raw = t.as_buffer().to_pybytes()
                gone: list[dict] = []
                if cuts.is_valid:
                    both = np.array([(r["a"], r["b"]) for r in cuts.as_py()])
                    gone = _ranges(both[:, 0], both[:, 1])
                at, pieces = 0, []
                for r in gone:
                    pieces.append(raw[at : r["a"]])
                    at = r["b"]
                pieces.append(raw[at:])
                left = b"".join(pieces)
                out.append((doc_id.as_py(), len(raw), len(raw) - len(left), len(gone), left))
                size += len(left)
                if size > BATCH_BYTES:
                    yield rows(out)
                    out, size = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        *numbers, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int64()) for x in numbers], pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return cut.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

