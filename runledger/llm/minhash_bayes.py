"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document gets the 128-bit hash of its words (its class: copies share
   it), the size of its set of 5-word shingles and a MinHash signature of
   ``HASHES`` values.  Copies are folded to one node, named by the smallest
   doc_id; partial aggregation does most of it before the shuffle.
2. Signatures are cut into bands; nodes with an equal band share a bucket.  At
   Jaccard 0.75, 32 bands of 4 values miss a pair with probability 5e-6.
   Buckets with the same members are folded.
3. Inside a bucket signatures are compared in batches.  After each batch the
   posterior of the similarity (uniform prior, so a Beta distribution) says
   how likely it is to reach the threshold; below ``MISS`` the pair is pruned.
4. Survivors are verified exactly, on the full shingle sets.
5. Links make components (large-star / small-star).

No bucket's pairs are all emitted.  Round one emits, per bucket, a maximum
spanning tree of the surviving pairs (at most members - 1 of them).  Its verified
links are turned into components.  Round two takes the buckets whose members
still lie in several components and tests the surviving pairs *across*
components, which are the only ones that can still matter, where the members
are: their shingle sets come along, and only links come out.  So every
candidate pair is linked through others, tested, or pruned.  Large buckets are
dealt out in blocks of about ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles;
in round one, hub members join every block.  Between the steps tables are written to the session's checkpoint
folder, so an executor that is lost costs only its own tasks.

Defined cases: null texts and texts without words have an empty set and link
with nothing; fewer than five words are one shingle; rows that share a doc_id
are one document, linked by any of its texts: further texts get ids of this module's own (at
least 2^62), tied to the doc_id; rows without a doc_id take the
component of their copies and link nothing; an empty table gives an empty
result.  Only ``doc_id`` and ``text`` are read.  Copies of one text are confirmed by a
128-bit hash of its words, and sets are compared as 64-bit hashes of their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.text import free_name, lower_ascii, text_or_empty, words
from runledger.llm.workers import send_package
from runledger.session import scratch_path

WORDS = 5
HASHES = 128
BANDS = 32
BATCH = 32
PERCENT = 75
MISS = 1e-6
BLOCK = 512
BLOCK_SHINGLES = 1_000_000
HUBS = 4
BROADCAST_NODES = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Shingle sets as sorted 64-bit hashes; word hashes are cached, bounded."""

    def __init__(self, most: int = 100_000):
        self.cache: dict[bytes, int] = {}
        self.most = most

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        if not words:
            return np.zeros(0, np.uint64)
        get = self.cache.get
        found = list(map(get, words))
        if None in found:
            if len(self.cache) > self.most:
                self.cache.clear()
            for w in set(words):
                if w not in self.cache:
                    self.cache[w] = xxhash.xxh3_64_intdigest(w)
            found = list(map(self.cache.__getitem__, words))
        h = np.array(found, np.uint64)
        k = min(WORDS, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out = out * _MIX + h[j : len(h) - k + 1 + j]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def words_of(text: str | None) -> list[bytes]:
    """Words of the A-Z lower-cased text; bytes.split() cuts at ASCII white space."""
    return text.encode().lower().split() if text else []


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(shingles), 4096):
        part = (_MULTIPLIERS[:, None] * shingles[None, a : a + 4096]) >> np.uint64(32)
        np.minimum(best, part.min(1).astype(np.uint32), out=best)
    return best


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest equal values among n for which similarity >= percent still has posterior >= miss.

    With a uniform prior, P(J >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


class Bayes:
    """Sequential comparison of one signature with many."""

    def __init__(self, percent: int = PERCENT, miss: float = MISS):
        self.bounds = [(a, a + BATCH, least_matches(a + BATCH, percent, miss)) for a in range(0, HASHES, BATCH)]
        self.percent = percent

    def matches(self, sig: np.ndarray, size: int, sigs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Equal values with each row of ``sigs``; -1 where the pair is pruned."""
        out = np.full(len(sigs), -1, np.int64)
        # the smaller set over the larger bounds the similarity
        alive = np.flatnonzero(100 * np.minimum(size, sizes) >= self.percent * np.maximum(size, sizes))
        got = np.zeros(len(alive), np.int64)
        for a, b, least in self.bounds:
            got = got + (sigs[alive, a:b] == sig[a:b]).sum(1)
            stay = got >= least
            alive, got = alive[stay], got[stay]
            if not len(alive):
                return out
        out[alive] = got
        return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, c1, c2, sig): set size, 128-bit class and signature of every document."""
    send_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sizes, c1, c2, sigs = [], [], [], []
                for t in part.column(1).to_pylist():
                    words = words_of(t)
                    s = shingler.hashes(words)
                    d = xxhash.xxh3_128_digest(b" ".join(words))
                    sizes.append(len(s))
                    c1.append(int.from_bytes(d[:8], "little", signed=True))
                    c2.append(int.from_bytes(d[8:], "little", signed=True))
                    sigs.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(c1, pa.int64()),
                        pa.array(c2, pa.int64()),
                        pa.array(sigs, pa.binary()),
                    ],
                    ["doc_id", "n", "c1", "c2", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, c1 bigint, c2 bigint, sig binary")


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-minhash-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, size, node): members of every band bucket of two or more, equal buckets folded."""
    width = 4 * HASHES // BANDS
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width)))
    )
    bands = nodes.select("node", F.explode(keys).alias("bucket"))
    shared = (
        bands.groupBy("bucket")
        .agg(
            F.count("*").alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .filter("size > 1")
        .groupBy("size", "x", "y")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "size")
    )
    return bands.join(shared, "bucket").select("bucket", "size", "node")


def _n_blocks(size, shingles):
    by_size, by_weight = F.ceil(size / F.lit(float(BLOCK))), F.ceil(shingles / F.lit(float(BLOCK_SHINGLES)))
    return F.greatest(by_size, by_weight).cast("long")


def _blocks(n_blocks, node):
    return F.pmod(F.xxhash64(node, F.lit(7)), n_blocks)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[list]]:
    """Runs of rows with equal first ``n_keys`` columns, as column lists."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        if not columns or not columns[0]:
            continue
        keys = list(zip(*columns[:n_keys], strict=True))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            rest = [c[a:b] for c in columns[n_keys:]]
            if key == keys[a] and held is not None:
                for old, new in zip(held, rest, strict=True):
                    old.extend(new)
            else:
                if held is not None:
                    yield held
                key, held = keys[a], rest
    if held is not None:
        yield held


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a = [min(p) for p in pairs]
    b = [max(p) for p in pairs]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), HASHES)


def spanning_pairs(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Round one: per bucket block, a maximum spanning forest of the pairs that are not pruned."""
    top = Window.partitionBy("bucket").orderBy(F.desc("copies"), "node")
    blocks = _n_blocks(F.col("size"), F.lit(0))  # signatures only: the shingles weigh nothing here
    hubs = (
        members.filter(F.col("size") > BLOCK)
        .withColumn("rank", F.row_number().over(top))
        .filter(F.col("rank") <= HUBS)
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    )
    columns = ["bucket", "block", "node", "n", "sig"]
    dealt = (
        members.withColumn("block", _blocks(blocks, F.col("node"))).select(*columns).unionByName(hubs.select(*columns))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = Bayes(percent, miss)
        out: list[tuple[int, int]] = []
        for node, n, sig in _groups(batches, 2):
            nodes, first = np.unique(np.array(node, np.int64), return_index=True)
            if len(nodes) < 2:
                continue
            sigs, sizes = _matrix([sig[i] for i in first]), np.array(n, np.int64)[first]
            best, parent = np.full(len(nodes), -1, np.int64), np.full(len(nodes), -1, np.int64)
            outside = np.ones(len(nodes), bool)
            at = 0
            for _ in range(len(nodes) - 1):
                outside[at] = False
                rest = np.flatnonzero(outside)
                got = bayes.matches(sigs[at], int(sizes[at]), sigs[rest], sizes[rest])
                better = got > best[rest]
                best[rest[better]], parent[rest[better]] = got[better], at
                at = int(rest[best[rest].argmax()])
                if best[at] >= 0:
                    out.append((int(nodes[parent[at]]), int(nodes[at])))
            if len(out) > 20_000:
                yield _pairs_batch(out)
                out = []
        if out:
            yield _pairs_batch(out)

    ordered = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that still lie in several components: + label, minor
    (not in the bucket's largest component), n_blocks."""
    known = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    parts = known.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.sum("n").alias("shingles"))
    split = (
        parts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max_by("label", "k").alias("main"), F.sum("shingles").alias("shingles"))
        .filter("parts > 1")
    )
    live = known.join(split.select("bucket", "main", "shingles"), "bucket")
    return live.select(
        "bucket", "node", "label", "n", "sig", (F.col("label") != F.col("main")).alias("minor"),
        _n_blocks(F.col("size"), F.col("shingles")).alias("n_blocks"),
    )


def crossing_links(live: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """Round two: links across components that share a bucket, verified where they meet.

    Every member is a target in one block; members outside the largest
    component also go to every block as probes.  Within a block two components
    need one link only, so a probe that finds one tests no more of them.
    """
    full = live.join(sets, "node")
    columns = ["bucket", "block", "probe", "node", "label", "n", "sig", "minor", "s"]
    targets = full.withColumn("block", _blocks(F.col("n_blocks"), F.col("node"))).withColumn("probe", F.lit(False))
    probes = (
        full.filter("minor")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .withColumn("probe", F.lit(True))
    )
    dealt = targets.select(*columns).unionByName(probes.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bayes = Bayes(percent, miss)
        out: list[tuple[int, int]] = []
        for probes_, node, label, n, sigs, minor, sets_ in _probe_groups(batches):
            joined: dict[int, int] = {}  # components that met in this block
            for p_node, p_label, p_n, p_sig, p_set in probes_:
                open_ = np.flatnonzero((label != p_label) & (~minor | (node > p_node)) & (node != p_node))
                if not len(open_):
                    continue
                got = bayes.matches(p_sig, p_n, sigs[open_], n[open_])
                stay = got >= 0
                for k in open_[stay][np.argsort(-got[stay], kind="stable")].tolist():
                    a, b = _root(joined, p_label), _root(joined, int(label[k]))
                    if a != b and similar(p_set, np.frombuffer(sets_[k], np.uint64), percent):
                        joined[max(a, b)] = min(a, b)
                        out.append((p_node, int(node[k])))
            if len(out) > 20_000:
                yield _pairs_batch(out)
                out = []
        if out:
            yield _pairs_batch(out)

    ordered = dealt.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "probe")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _root(joined: dict[int, int], x: int) -> int:
    while x in joined:
        x = joined[x]
    return x


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two shingle sets reach the similarity, by exact integers."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _probe_groups(batches: Iterator[pa.RecordBatch]):
    """For each (bucket, block): its targets as arrays, with its probes a bounded number at a time."""
    key, targets, probes = None, None, []

    def done():
        node, label, n, sig, minor, sets = targets
        return (
            probes,
            np.array(node, np.int64),
            np.array(label, np.int64),
            np.array(n, np.int64),
            _matrix(sig),
            np.array(minor, bool),
            sets,
        )

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for bucket, block, probe, node, label, n, sig, minor, s in zip(*columns, strict=True):
            if (bucket, block) != key:
                if key is not None and probes and targets[0]:
                    yield done()
                key, targets, probes = (bucket, block), ([], [], [], [], [], []), []
            if probe:
                probes.append((node, label, n, np.frombuffer(sig, np.uint32), np.frombuffer(s, np.uint64)))
                if len(probes) >= 512 and targets[0]:
                    yield done()
                    probes = []
            else:
                for store, x in zip(targets, (node, label, n, sig, minor, s), strict=True):
                    store.append(x)
    if key is not None and probes and targets[0]:
        yield done()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): full shingle sets (sorted 64-bit hashes) of the wanted nodes."""
    wanted = wanted.withColumnRenamed("node", "doc_id")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingler.hashes(words_of(t)).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sets, pa.binary())], ["node", "s"]
                )

    return texts.mapInArrow(run, "node bigint, s binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity, by exact integers."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(i) for i in range(4)]
            for a, b, sa, sb in zip(*columns, strict=True):
                x = np.frombuffer(sa.as_buffer(), np.uint64)
                y = np.frombuffer(sb.as_buffer(), np.uint64)
                if similar(x, y, percent):
                    out.append((a.as_py(), b.as_py()))
            yield _pairs_batch(out)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating large and small stars."""
    e = _written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .filter("v <> m")
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = _written(small, "cc")
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).collect()[0])
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        last = state


#: Ids of this module's own, for further texts of a repeated doc_id: larger than any doc_id it is given.
_SURROGATE = 1 << 62


def _words_key(text: str = "text") -> F.Column:
    """The words of a text as one string, '' without any; texts with the same words are copies."""
    return F.array_join(words(lower_ascii(text_or_empty(F.col(text)))), " ")


def _single_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Where doc_ids repeat with different words: rows (doc_id, text) in which every id has one text,
    and (doc_id, of_id) for the ids that were made up.  None where no id repeats so.

    The words with the smallest hash keep the doc_id.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    repeated = _written(named.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return None
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_NODES else repeated
    key = F.struct(F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), "w").alias("b"))
    marked = named.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").withColumn("w", _words_key())
    marked = marked.filter("w <> ''").withColumn("key", key)
    first = marked.groupBy("doc_id").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    several = _written(first.filter("first <> last").select(F.col("doc_id").alias("of_id"), "first"), "several")
    if several.isEmpty():
        return None
    further = (
        marked.join(several, marked["doc_id"] == F.col("of_id"))
        .filter("key <> first")
        .select((F.lit(_SURROGATE) + F.pmod(F.xxhash64("of_id", "key"), F.lit(_SURROGATE))).alias("doc_id"), "of_id", "key", "text")
    )
    further = _written(further, "further")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(several) if several.count() <= BROADCAST_NODES else several, F.col("doc_id") == F.col("of_id"), "left"
    )
    # rows of such an id stay if they have its first words (or none)
    w = F.when(F.col("of_id").isNotNull(), _words_key())
    stays = F.col("of_id").isNull() | (w == "") | (F.struct(F.xxhash64(w), F.xxhash64(F.lit(1), w)) == F.struct("first.a", "first.b"))
    rows = mine.filter(stays).select("doc_id", "text").unionByName(further.select("doc_id", "text"))
    return rows, further.select("doc_id", "of_id").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_copies (rows with the same words)."""
    return _classified(docs, percent, miss).drop("own")


def _classified(docs: DataFrame, percent: int, miss: float) -> DataFrame:
    """``near_duplicates`` with ``own``: the id that a row's words have of their own (made up for further words of an id)."""
    split = _single_texts(docs)
    if split is None:
        return _linked(docs, None, percent, miss).withColumn("own", F.col("doc_id"))
    rows, made_up = split
    made_up = _written(made_up, "made-up")
    found = _linked(rows, made_up.select(F.col("doc_id").alias("a"), F.col("of_id").alias("b")), percent, miss)
    found = found.withColumnRenamed("doc_id", "own").join(made_up, F.col("own") == F.col("doc_id"), "left").drop("doc_id")
    doc_id = F.coalesce("of_id", "own")
    kept = F.coalesce(doc_id == F.col("component_id"), F.col("component_id").isNull())
    return found.select(doc_id.alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"), "n_copies", "own")


def _linked(docs: DataFrame, ties: DataFrame | None, percent: int, miss: float) -> DataFrame:
    """``near_duplicates`` of documents whose ids have one text each; ``ties`` (a, b): ids that are one document."""
    sigs = _written(signatures(docs), "signatures")
    classes = _written(
        sigs.filter("n > 0")
        .groupBy("c1", "c2")
        .agg(
            F.min("doc_id").alias("node"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("sig").alias("sig"),
        ),
        "classes",
    )
    nodes = classes.filter("node is not null").select("node", "copies", "n", "sig")
    groups = buckets(nodes)
    members = _written(groups.join(nodes, "node").select("bucket", "size", "node", "copies", "n", "sig"), "members")
    first = _written(spanning_pairs(members, percent, miss), "first")
    sets = _written(shingle_sets(docs, _ends(first)), "sets")
    links = verified(first, sets, percent)
    if ties is not None:
        of = sigs.filter("n > 0").select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "node"), ["c1", "c2"]).select("doc_id", "node")
        a = of.select(F.col("doc_id").alias("a"), F.col("node").alias("node_a"))
        b = of.select(F.col("doc_id").alias("b"), F.col("node").alias("node_b"))
        tied = ties.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        links = links.unionByName(tied.filter("a <> b")).distinct()
    links = _written(links, "links")
    labels = components(links)
    live = _written(unresolved(members, labels), "unresolved")
    if not live.isEmpty():
        more = live.select("node").distinct().join(sets.select("node"), "node", "left_anti")
        all_sets = sets.unionByName(_written(shingle_sets(docs, more), "sets"))
        found = _written(crossing_links(live, all_sets, percent, miss), "second")
        labels = components(links.unionByName(found))
    named = classes.join(labels, "node", "left").select(
        "c1", "c2", F.coalesce("label", "node").alias("component"), "copies"
    )
    rows = sigs.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the one with the smallest doc_id; all columns as they were.

    Of rows without a doc_id, one of each text stays, if no document with a
    doc_id has the same words; those without words all stay.
    """
    found = _classified(docs, options.get("percent", PERCENT), options.get("miss", MISS)).filter("kept")
    # of an id with several texts the one that has the id as its own stays
    ids = found.filter("doc_id is not null and own = doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = _written(ids.select(F.col("doc_id").alias("kept_id"), "n"), "kept")
    left = docs.join(ids.filter("n = 1").select("kept_id"), docs["doc_id"] == F.col("kept_id"), "left_semi")
    several = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    several = _written(several.select(F.col("doc_id").alias("several_id")), "several-rows")
    if not several.isEmpty():  # rows that repeat a doc_id: one of them stays, the same in every run
        left = left.join(several, F.col("doc_id") == F.col("several_id"), "left_anti")
        left = left.unionByName(_one_each(docs.join(several, F.col("doc_id") == F.col("several_id"), "left_semi")))
    nameless = docs.filter(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return left
    key = free_name(docs, "words_key")
    joined = _words_key()
    keyed = nameless.withColumn(key, F.when(joined != "", F.xxhash64(joined)))
    named = docs.filter(F.col("doc_id").isNotNull()).select(F.xxhash64(joined).alias(key)).distinct()
    once = keyed.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(named, key, "left_anti")
    rest = once.drop(key).unionByName(keyed.filter(F.col(key).isNull()).drop(key))
    return left.unionByName(rest)


def _one_each(rows: DataFrame) -> DataFrame:
    """Of each doc_id the row whose words have the smallest hash; of rows with the same words the smallest text."""
    place = free_name(rows, "place")
    w = _words_key()
    order = [(w == "").cast("int"), F.xxhash64(w), F.xxhash64(F.lit(1), w), text_or_empty(F.col("text")), F.col("text").isNull()]
    ranked = rows.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return ranked.filter(F.col(place) == 1).drop(place)
