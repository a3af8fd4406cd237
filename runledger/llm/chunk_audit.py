"""Source divergence audit by chunk factorization.

How far the term distributions of the sources of one language lie apart, and which terms a source
overuses.  Terms are runs of letters (ASCII and every non-ASCII character, A-Z
lower-cased); they never contain ASCII white space, so a text's terms are those of
its white-space chunks.

* Chunks are counted per document by blocks of at most ``BLOCK_BYTES`` of text: one
  row per distinct chunk of a block with its number of documents, and one row with the (document, chunk,
  count) triples, packed.
* Every globally distinct chunk is tokenized once, after its documents are added up with map-side
  combining.  The documents of a term's chunks, added up, bound the term's own from above; terms below
  ``min_docs`` end here, and with them nearly all distinct chunks of a large corpus.
* The terms left are joined back to the blocks that hold their chunks.  A very
  frequent chunk sends one short row per block, whatever the number of its documents.
* There the terms meet the triples of the block again, and distinct documents and
  occurrences per language, source and term are counted; blocks share no document, so both add up.
  This is the only move of the triples, and a group is one block, bounded by construction.
  Terms in fewer than ``min_docs`` documents of a language go.  What is left is
  the vocabulary of each language times its sources.
* Distances between sources are sums over block matrices: terms are cut into buckets, sources into
  tiles, and a task computes the absolute differences of two tiles over one
  bucket densely.  Terms that neither tile has add the difference of the smoothed zero counts.

All arithmetic is on integers (decimals where 64 bits would not do).

Defined cases: null text, lang and source count as ''; every row is a document, also where rows or
ids repeat; a group without terms takes part with counts of 0; a language without kept terms has
distances of 0 and no term rows; an empty table gives an empty result.  Only ``lang``, ``source`` and
``text`` are read.  Very long texts make blocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm import text as T
from runledger.llm.workers import send_package
from runledger.session import scratch_path

MIN_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
BLOCK_BYTES = 32_000_000
SLICE = 500_000
BROADCAST_ROWS = 100_000
BUCKET_TERMS = 512
TILE_SOURCES = 256
_NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(chunk: Column) -> Column:
    return F.array_remove(F.split(T.lower_ascii(chunk), _NO_TERM), "")


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-audit-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _groups(docs: DataFrame) -> DataFrame:
    blank = F.lit("")
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), blank).alias("lang"),
        F.coalesce(F.col("source").cast("string"), blank).alias("source"),
        T.text_or_empty(F.col("text")).alias("text"),
    )


def _sums(key: np.ndarray, value: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values (or how often each occurs)."""
    if value is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    if value is None:
        return key[first], np.diff(np.append(first, len(key)))
    return key[first], np.add.reduceat(value, first) if len(first) else value


def _packed(x: np.ndarray) -> bytes:
    """Numbers >= 0 in the narrowest width that holds them, byte by byte position, so that codecs find the zeros."""
    size = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w - (w == 8))
    planes = np.ascontiguousarray(x.astype(f"<u{size}")).view(np.uint8).reshape(-1, size)
    return bytes([size]) + planes.T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def _slices(edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of owners that have about ``SLICE`` entries together (an owner of more stands alone)."""
    a, last = 0, len(edges) - 1
    while a < last:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + SLICE, side="right")) - 1)
        yield a, b
        a = b


_BLOCKS = (
    "block bigint, cid int, chunk string, docs bigint, pairs binary, n binary, grp binary, "
    "langs array<string>, sources array<string>"
)


def chunk_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Chunk counts of the documents, by blocks.

    Rows with ``cid`` >= 0: the distinct chunks of a block and how many of its documents hold each.  One row
    with ``cid`` -1 (and the number of chunks as ``docs``): packed arrays of the (document, chunk) pairs as steps
    from pair to pair, of their counts and of the documents' groups, and the groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in _cut(batch, block_bytes):
                n = part.column(2).nbytes
                if held and size + n > block_bytes:
                    yield from emit(block, held)
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += n
        if held:
            yield from emit(block, held)

    def emit(block: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, source, text = (table.column(k).chunk(0) for k in range(3))
        parts = pc.ascii_split_whitespace(text)
        coded = parts.flatten().dictionary_encode()
        edges = parts.offsets.to_numpy().astype(np.int64)
        n_chunks = len(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        del parts, held[:], table, text
        found = []
        for a, b in _slices(edges):
            doc = np.repeat(np.arange(a, b, dtype=np.int64), np.diff(edges[a : b + 1]))
            found.append(_sums(doc * max(n_chunks, 1) + at[edges[a] : edges[b]]))
        key, n = (np.concatenate(x) for x in zip(*found, strict=True))
        docs = np.bincount(key % max(n_chunks, 1), minlength=n_chunks)
        langs, sources = lang.dictionary_encode(), source.dictionary_encode()
        both = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary)
        both += sources.indices.to_numpy(zero_copy_only=False)
        groups, grp = np.unique(both, return_inverse=True)
        pack = lambda x: pa.array([_packed(x)], pa.binary())
        names = lambda d, at: pa.array([d.dictionary.take(pa.array(at)).to_pylist()], pa.list_(pa.string()))
        schema = ["block", "cid", "chunk", "docs", "pairs", "n", "grp", "langs", "sources"]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.array([-1], pa.int32()),
                pa.array([None], pa.string()),
                pa.array([n_chunks], pa.int64()),
                *map(pack, (np.diff(key, prepend=0), n, grp)),
                names(langs, groups // max(len(sources.dictionary), 1)),
                names(sources, groups % max(len(sources.dictionary), 1)),
            ],
            schema,
        )
        for a in range(0, n_chunks, 50_000):
            some = coded.dictionary.slice(a, 50_000)
            none = [pa.nulls(len(some), t) for t in [pa.binary()] * 3 + [pa.list_(pa.string())] * 2]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), block), pa.int64()),
                    pa.array(np.arange(a, a + len(some)), pa.int32()),
                    some.cast(pa.string()),
                    pa.array(docs[a : a + len(some)], pa.int64()),
                    *none,
                ],
                schema,
            )

    return _groups(docs).mapInArrow(run, _BLOCKS)


def _cut(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most about ``most`` bytes of text (a longer text stands alone)."""
    size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, s in enumerate(size.tolist()):
        if i > first and total + s > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += s
    if len(size):
        yield batch.slice(first, len(size) - first)


_COUNTED = "lang string, source string, term string, documents bigint, n bigint"


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _count_block(asked: pa.Table, triples: pa.Table) -> pa.Table:
    """Distinct documents and occurrences of a block's terms, by language and source."""
    columns = ["lang", "source", "term", "documents", "n"]
    if not len(asked):
        return pa.table([pa.array([], k) for k in [pa.string()] * 3 + [pa.int64()] * 2], columns)
    unpack = lambda c: _unpacked(triples.column(c)[0].as_py())
    key, n, grp, n_chunks = np.cumsum(unpack("pairs")), unpack("n"), unpack("grp"), triples.column("docs")[0].as_py()
    cid = asked.column("cid").to_numpy().astype(np.int64)
    order = np.argsort(cid, kind="stable")
    coded = _one(asked.column("term")).dictionary_encode()
    term_of = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    n_terms = len(coded.dictionary)
    at = np.searchsorted(cid[order], np.arange(n_chunks + 1))
    found = []
    for a, b in _slices(np.searchsorted(key, np.arange(len(grp) + 1) * n_chunks)):
        lo, hi = np.searchsorted(key, [a * n_chunks, b * n_chunks])
        doc, pair = key[lo:hi] // n_chunks, key[lo:hi] % n_chunks
        count = at[pair + 1] - at[pair]  # chunks without terms did not come back
        owner = np.repeat(np.arange(len(pair)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        # chunks of a document that share a term count it once
        each, total = _sums(doc[owner] * n_terms + term_of[at[pair[owner]] + inside], n[lo:hi][owner])
        where = grp[each // n_terms] * n_terms + each % n_terms
        row, occurrences = _sums(where, total)
        found.append((row, _sums(where)[1], occurrences))
    rows, documents, occurrences = (np.concatenate(x) for x in zip(*found, strict=True))
    row, documents = _sums(rows, documents)
    _, occurrences = _sums(rows, occurrences)
    name = lambda c: pa.array(triples.column(c)[0].as_py(), pa.string()).take(pa.array(row // n_terms))
    said = coded.dictionary.cast(pa.string()).take(pa.array(row % n_terms))
    return pa.table([name("langs"), name("sources"), said, pa.array(documents, pa.int64()), pa.array(occurrences, pa.int64())], columns)


def _near(df: DataFrame) -> DataFrame:
    """A broadcast hint where the rows are few; beyond the bound the planner's own choice."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def counted_terms(docs: DataFrame, min_docs: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, term, documents, n): distinct documents and occurrences.

    Complete for the terms that stand in ``min_docs`` documents; others may be missing.
    """
    send_package(docs.sparkSession)
    blocks = _written(chunk_blocks(docs, block_bytes), "blocks")
    chunks = blocks.filter("cid >= 0")
    distinct = chunks.groupBy("chunk").agg(F.sum("docs").alias("docs"))
    said = _written(distinct.select("chunk", F.explode(terms_of(F.col("chunk"))).alias("term"), "docs"), "said")
    # a chunk may hold a term more than once: its documents then count more than once, the bound stays a bound
    enough = _written(said.groupBy("term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("term"), "enough")
    of_chunk = _written(said.select("chunk", "term").join(_near(enough), "term"), "of-chunk")
    asked = chunks.select("block", "cid", "chunk").join(_near(of_chunk), "chunk").select("block", "cid", "term")
    triples = blocks.filter("cid < 0").select(F.col("block").alias("home"), "docs", "pairs", "n", "grp", "langs", "sources")
    parts = asked.groupBy("block").cogroup(triples.groupBy("home")).applyInArrow(_count_block, _COUNTED)
    return parts.groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(kept terms: lang, term, documents; counts: lang, source, term, documents, n > 0 of the kept terms)."""
    counted = _written(counted_terms(docs, min_docs, block_bytes), "counted")
    # a document has one source, so the sources' documents add up to the language's
    kept = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= min_docs)
    kept = _written(kept, "kept")
    return kept, counted.join(_near(kept.select("lang", "term")), ["lang", "term"], "left_semi")


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * v)), exactly; null where there are no terms."""
    wide = (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.when(v > 0, (total + SMOOTHING * v).cast("decimal(20,0)"))
    return F.lit(1) + F.call_function("div", wide, below)


def _distances(parts: pa.Table) -> pa.Table:
    """Sums of absolute differences between the sources of two tiles, over the terms of one bucket."""
    head = parts.filter(pc.is_null(parts.column("term")))
    rows = parts.filter(pc.is_valid(parts.column("term")))
    source, tile = head.column("source").to_pylist(), head.column("tile").to_numpy()
    at = {s: i for i, s in enumerate(source)}
    zero = head.column("p").to_numpy()
    coded = _one(rows.column("term")).dictionary_encode()
    term, seen = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    who = np.array([at[s] for s in rows.column("source").to_pylist()], np.int64)
    p = rows.column("p").to_numpy()
    order = np.argsort(term, kind="stable")
    term, who, p = term[order], who[order], p[order]
    total = np.zeros((len(source), len(source)), np.int64)
    for a in range(0, seen, 1024):
        width = min(1024, seen - a)
        lo, hi = np.searchsorted(term, [a, a + width])
        dense = np.repeat(zero[:, None], width, 1)
        dense[who[lo:hi], term[lo:hi] - a] = p[lo:hi]
        for i in range(len(source)):
            total[i] += np.abs(dense - dense[i]).sum(1)
    one, two = parts.column("tile_a")[0].as_py(), parts.column("tile_b")[0].as_py()
    pair = (tile[:, None] == one) & (tile[None, :] == two)
    i, j = np.nonzero((pair | pair.T) & ~np.eye(len(source), dtype=bool))
    names = pa.array(source, pa.string())
    return pa.table(
        [
            pa.array([parts.column("lang")[0].as_py()] * len(i), pa.string()),
            names.take(pa.array(i)),
            names.take(pa.array(j)),
            pa.array(total[i, j], pa.int64()),
            pa.array(np.full(len(i), seen), pa.int64()),
            pa.array(np.abs(zero[i] - zero[j]), pa.int64()),
        ],
        ["lang", "source", "item", "f", "seen", "apart"],
    )


def audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES,
    bucket_terms: int = BUCKET_TERMS, tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair``, the distance to each other source of the language;
    ``term``, the ``top`` terms that the source uses more than its language does."""
    kept, counts = term_counts(docs, min_docs, block_bytes)
    counts = _written(counts.select("lang", "source", "term", "n"), "counts")
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    spoken = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        _groups(docs).select("lang", "source").distinct()
        .join(spoken, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    groups = _written(groups, "groups")
    shares = counts.join(_near(groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("v")))

    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("v").alias("lang_v"))
    spread = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(_near(whole), "lang")
    usual = spread.select("lang", "term", _share(F.col("lang_n"), F.col("lang_total"), F.col("lang_v")).alias("q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = (
        shares.join(usual, ["lang", "term"])
        .filter("p > q")
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
    )

    sizes = _near(
        groups.groupBy("lang").agg(
            F.ceil(F.max("v") / bucket_terms).alias("buckets"), F.ceil(F.count("*") / tile_sources).alias("tiles")
        )
    )
    place = F.struct(F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    zeros = (
        groups.join(sizes, "lang")
        .withColumn("p", F.coalesce(_share(F.lit(0).cast("long"), F.col("total"), F.col("v")), F.lit(0)))
        .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.greatest(F.col("buckets"), F.lit(1)) - 1)))
        .select("lang", "bucket", "tiles", tile.alias("tile"), "source", F.lit(None).cast("string").alias("term"), "p")
    )
    cells = shares.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), "tiles", tile.alias("tile"), "source", "term", "p"
    )
    dealt = zeros.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "bucket", "tile", "source", "term", "p", place.alias("t")).select(
        "lang", "bucket", "t.tile_a", "t.tile_b", "tile", "source", "term", "p"
    )
    sums = dealt.groupBy("lang", "bucket", "tile_a", "tile_b").applyInArrow(
        _distances, "lang string, source string, item string, f bigint, seen bigint, apart bigint"
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (
        sums.groupBy("lang", "source", "item")
        .agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"), F.max("apart").alias("apart"))
        .join(_near(whole.select("lang", "lang_v")), "lang")
        .select(
            "lang", "source", F.lit("pair").alias("part"), "item",
            (F.col("f") + (F.col("lang_v") - F.col("seen")) * F.col("apart")).alias("value"),
        )
        .withColumn("rank", F.row_number().over(order))
    )
    return pairs.unionByName(over)
