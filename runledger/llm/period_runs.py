"""Periodic runs of words by seed and extend along diagonals.

A run is a stretch of words with smallest period q, at least ``max(SHORTEST, 2 * q)``
words long, that no neighbouring word extends keeping the period.  Words q apart
agree along a run, so it is a stretch of matches on the diagonal of lag q.

* Seeds.  With ``SHORTEST = 12`` a run of period q matches itself q words on along at
  least ``max(12 - q, q)`` words: at least ``GRAM = 6`` whatever q is, and at least k where
  q >= k.  Occurrences of 6-grams in one document give the lags 1 to 11; the lags k to
  2k - 1 (k = 12, 24, ...) are found from k-grams, so a long period does not
  depend on short, frequent grams.  Grams are numbered exactly: 6-grams by
  their words, longer ones by the numbers of their halves.  A gram that occurs
  once in its document has no number and is gone from all longer grams.
* Pairs.  Occurrences of a k-gram at most k / 2 apart lie in one run of a smaller
  period; such a cluster is one arithmetic progression, and its inner lags are
  multiples of that period.  Between two clusters each
  diagonal is entered once, at the first occurrence of one of them.  Fewer than five later
  clusters start within 2k words, so the pairs of a document
  are at most proportional to its words on each of the log2(words) levels: a
  document of one word, or of one line repeated, costs no more than any other.
* Extension.  From a pair, the matches are followed in both directions by the numbers of
  ever shorter grams, then by words.  Pairs of one diagonal that an earlier
  extension has covered are dropped before: per lag, the furthest covered word is kept.
* A stretch found at several lags belongs to the smallest (the others are
  its multiples).

All documents of a batch are worked on together as arrays.  Work is per
row: no shuffle.  Memory follows the batch and the longest single text.  Defined cases: null
and empty texts have no words and no runs; repeated rows are judged each; an empty
table gives an empty result.  Only the text and key columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm import text as T
from runledger.llm.workers import send_package

SHORTEST = 12
GRAM = 6
BATCH_BYTES = 2_000_000


def word_arrays(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words, their numbers, where each text's words begin among them and the end)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    words, edges = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    solid = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    if not solid.all():
        words = words.filter(pa.array(solid))
        edges = np.concatenate([[0], np.cumsum(solid)])[edges]
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), edges


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each distinct row that occurs twice or more, -1 for the others; and how many."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), 0
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = False
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(order))) > 1
    number = np.where(twice, np.cumsum(twice) - 1, -1)
    out = np.empty(len(order), np.int64)
    out[order] = number[np.cumsum(new) - 1]
    return out, int(twice.sum())


def gram_levels(w: np.ndarray, doc: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """Per level l, the number of the gram of ``gram * 2**l`` words at each place, -1 where it
    leaves its document or occurs once in it."""
    n = len(w)
    base = np.full(n, -1, np.int64)
    if n < gram:
        return [base]
    # a hash finds the candidates, their words decide
    h = doc[: n - gram + 1].astype(np.uint64)
    for j in range(gram):
        h = (h ^ w[j : n - gram + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    s = h[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    at = np.sort(order[twin])
    at = at[doc[at] == doc[at + gram - 1]]
    base[at], count = _numbered(doc[at], *[w[at + j] for j in range(gram)])
    levels = [base]
    size = gram
    while count:
        prev = levels[-1]
        at = np.flatnonzero(prev[: n - size] >= 0)
        at = at[prev[at + size] >= 0]
        at = at[doc[at] == doc[at + size]]
        found, count = _numbered(prev[at], prev[at + size])
        if count:
            here = np.full(n, -1, np.int64)
            here[at] = found
            levels.append(here)
            size *= 2
    return levels


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, first[owner] + 0, 1, ...) with ``count`` entries per owner."""
    owner = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, first[owner] + inside


def cluster_pairs(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of pairs of equal grams with lags from ``size`` to ``2 * size - 1``; each diagonal
    between two clusters of occurrences is entered at the first occurrence of one of them."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    if not len(at):
        return at, at
    name = names[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] - at[:-1] > size // 2)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    count = last - first + 1
    places, lags = [], []
    step = 1
    while True:
        x = np.arange(len(first) - step)
        y = x + step
        near = (name[first[x]] == name[first[y]]) & (at[first[y]] - at[last[x]] < 2 * size)
        if not near.any():
            break
        x, y = x[near], y[near]
        owner, j = _expand(first[y], count[y])
        i = first[x][owner]
        places.append(at[i])
        lags.append(at[j] - at[i])
        owner, i = _expand(first[x], count[x])
        j = first[y][owner]
        places.append(at[i])
        lags.append(at[j] - at[i])
        step += 1
    if not places:
        return at[:0], at[:0]
    place, lag = np.concatenate(places), np.concatenate(lags)
    keep = (lag >= size) & (lag < 2 * size)
    return place[keep], lag[keep]


def short_lag_pairs(names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of pairs of equal grams with lags up to ``most``; the first of neighbouring pairs on a diagonal."""
    places, lags = [], []
    at = np.flatnonzero(names >= 0)
    for q in range(1, most + 1):
        some = at[at + q < len(names)]
        same = some[names[some] == names[some + q]]
        if len(same):
            head = np.ones(len(same), bool)
            head[1:] = same[1:] != same[:-1] + 1
            places.append(same[head])
            lags.append(np.full(int(head.sum()), q))
    if not places:
        return at[:0], at[:0]
    return np.concatenate(places), np.concatenate(lags)


class Extender:
    """Follows matches on diagonals; the furthest covered place of each diagonal is kept."""

    def __init__(self, w: np.ndarray, doc: np.ndarray, levels: list[np.ndarray], gram: int):
        self.w, self.doc, self.levels, self.gram = w, doc, levels, gram

    def _right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree inside a document (i < j)."""
        n, out = len(self.w), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], self.gram << level
            live = np.arange(len(i))
            while len(live):  # more than once only at the highest level
                b = np.minimum(j[live] + out[live], n - 1)
                a = i[live] + out[live]
                same = (j[live] + out[live] < n) & (names[a] >= 0) & (names[a] == names[b])
                live = live[same]
                out[live] += size
        live = np.arange(len(i))
        while len(live):
            a, b = i[live] + out[live], np.minimum(j[live] + out[live], n - 1)
            same = (j[live] + out[live] < n) & (self.w[a] == self.w[b]) & (self.doc[j[live]] == self.doc[b])
            live = live[same]
            out[live] += 1
        return out

    def _left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i and before j agree inside a document (i < j)."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, size = self.levels[level], self.gram << level
            live = np.arange(len(i))
            while len(live):
                a = i[live] - out[live] - size
                b = np.maximum(j[live] - out[live] - size, 0)
                at = np.maximum(a, 0)
                same = (a >= 0) & (names[at] >= 0) & (names[at] == names[b])
                live = live[same]
                out[live] += size
        live = np.arange(len(i))
        while len(live):
            a, b = i[live] - out[live] - 1, j[live] - out[live] - 1
            at = np.maximum(a, 0)
            same = (a >= 0) & (self.w[at] == self.w[b]) & (self.doc[at] == self.doc[i[live]])
            live = live[same]
            out[live] += 1
        return out

    def stretches(self, place: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, matches, lag) of the maximal matching stretches through the pairs."""
        order = np.lexsort((place, lag, self.doc[place] if len(place) else place))
        place, lag = place[order], lag[order]
        diagonal = np.ones(len(place), bool)
        diagonal[1:] = (lag[1:] != lag[:-1]) | (self.doc[place[1:]] != self.doc[place[:-1]])
        diagonal = np.cumsum(diagonal) - 1
        furthest = np.full(diagonal[-1] + 1 if len(place) else 0, -1, np.int64)
        starts, sizes, lags = [], [], []
        left = np.arange(len(place))
        while len(left):  # each turn extends the first open pair of every diagonal
            head = np.ones(len(left), bool)
            head[1:] = diagonal[left[1:]] != diagonal[left[:-1]]
            now = left[head]
            i, q = place[now], lag[now]
            back, on = self._left(i, i + q), self._right(i, i + q)
            starts.append(i - back)
            sizes.append(back + on)
            lags.append(q)
            furthest[diagonal[now]] = i + on
            left = left[~head]
            left = left[place[left] >= furthest[diagonal[left]]]
        if not starts:
            return place, place, lag
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(lags)


def find_runs(w: np.ndarray, edges: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of all runs; ``w``: word numbers, ``edges``: documents."""
    gram = shortest // 2
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    levels = gram_levels(w, doc, gram)
    found = [short_lag_pairs(levels[0], 2 * gram - 1)]
    found += [cluster_pairs(names, gram << level) for level, names in enumerate(levels) if level]
    place, lag = np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])
    start, match, lag = Extender(w, doc, levels, gram).stretches(place, lag)
    length = match + lag
    keep = length >= np.maximum(shortest, 2 * lag)
    start, length, lag = start[keep], length[keep], lag[keep]
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.ones(len(start), bool)  # of one stretch the smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[new], length[new], lag[new]
    d = doc[start] if len(start) else start
    rows = np.stack([d, start - edges[d] if len(d) else start, length, lag], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``BATCH_BYTES`` bytes (a longer text stands alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = size = 0
    for i, s in enumerate(sizes.tolist()):
        if i > first and size + s > BATCH_BYTES:
            yield first, i
            first, size = i, 0
        size += s
    if len(sizes):
        yield first, len(sizes)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per document: key, n_words, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text's words joined by one space without the repetitions of any run (all words of a run
    behind its first period)."""
    send_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _batches(batch.column(1)):
                part = batch.slice(a, b - a)
                words, w, edges = word_arrays(part.column(1))
                rows = find_runs(w, edges, shortest)
                cut = np.zeros(len(w) + 1, np.int64)  # how many runs drop each word
                np.add.at(cut, edges[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
                np.add.at(cut, edges[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
                kept = np.cumsum(cut[:-1]) == 0
                at = np.concatenate([[0], np.cumsum(kept)])[edges]
                left = pa.ListArray.from_arrays(pa.array(at, pa.int32()), words.filter(pa.array(kept)))
                per = np.searchsorted(rows[:, 0], np.arange(b - a + 1))
                spans = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans),
                        pc.binary_join(left, " "),
                    ],
                    [key, "n_words", "runs", "collapsed"],
                )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def planted_text(doc_id: Column, text: Column) -> Column:
    """The words that the query judges: where crc32(doc_id) ends in 0, the words behind a place
    that depends on the id repeat the words there with a period that depends on it too."""
    h = F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        kept = F.slice(w, 1, a + p)
        tail = F.transform(F.sequence(a + p, n - 1), lambda i: F.element_at(w, a + (i - a) % p + 1))
        return F.array_join(F.when(a + p < n, F.concat(kept, tail)).otherwise(w), " ")

    # bound once, so that the words are split once per row
    planted = T.bind(T.words(text), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, planted).otherwise(text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), ""
    )
    return found.withColumn("longest_run", longest).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest_run.s")).alias("start"),
        F.col("longest_run.length").alias("length"),
        (-F.col("longest_run.p")).alias("period"),
        F.floor(F.col("longest_run.length") * 1000 / -F.col("longest_run.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"),
    )


