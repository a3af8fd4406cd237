"""Benchmark decontamination by a prefix-filtered set join (built-in expressions only).

Every item window (``window`` consecutive words; a shorter item is one window)
is the set of its positioned shingles.  An exact occurrence holds all of them,
so at containment 1 the necessary prefix is one shingle: the rarest, by the
number of times it stands in the documents.  Documents are read twice: once
to count the benchmark's shingles, once to find prefix shingles.  A find
carries the item-sized stretch of words around it; the join with the windows
checks position and length bounds and then compares the words themselves.

Documents are never exploded into all their shingles and their texts are never
shuffled: a shingle is first tested inside the row, against a bitmap of the
benchmark's hashes.  The bitmap is built by Spark in blocks of 4 kB and is a
literal of the plan (named once or twice in it), 4 kB to 2 MB long (``BITS``)
whatever the benchmark; it only ever lets too much through.  What passes is joined with the windows by its
hash, so there is one scan to count and one to find for a benchmark of any
size.  A benchmark side is broadcast where it has been counted: at most
``chunk`` rows and ``BROADCAST_BYTES``; beyond that the join shuffles finds.
A window's items are joined last, once per document and window.

Defined cases: null texts have no words; an item without words has no
windows; equal items are all reported; a null item_id is not reported as an
item but its words count as hits; repeated document rows give one row each;
the work on a very long text is in proportion to its words;
empty tables work on either side.  Only ``doc_id``, ``text`` and ``item_id``
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.text import alnum_words, bind, free_name, sha256_hex, text_or_empty

WINDOW = 13
SHINGLE = 5
CHUNK = 40_000
BROADCAST_BYTES = 64 << 20
#: least and greatest size of the bitmap, as powers of two (bits); about 32 bits a hash between them
BITS = (15, 24)
BLOCK = 15


def _shingle(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(w, at + k) for k in range(size)])


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words): each item's windows, as strings and distinct."""
    w = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), alnum_words(text_or_empty(F.col("text"))).alias("w")
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = F.transform(starts, lambda i: F.slice(F.col("w"), i, window))
    return w.select("item_id", F.explode(each).alias("words")).distinct()


def numbered_windows(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(wid, words, size, s): the distinct windows, written once so that their numbers stay."""
    numbered = windows.select("words").distinct().withColumn("wid", F.monotonically_increasing_id())
    return _written(
        windows.sparkSession,
        numbered.withColumn("size", F.size("words")).withColumn("s", F.least(F.lit(shingle), F.col("size"))),
    )


def _shingles(w: Column, s: int) -> Column:
    """(h, i) of every ``s``-word shingle of the words, in order."""
    return F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (s - 1), F.lit(0))),
        lambda _, i: F.struct(_shingle(w, i, s).alias("h"), i.alias("i")),
    )


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(wid, h, off): each window once per shingle."""
    at = F.lit(None).cast("array<struct<h:bigint,i:int>>")
    for s in range(1, shingle + 1):
        at = F.when(F.col("s") == s, _shingles(F.col("words"), s)).otherwise(at)
    return windows.select("wid", F.inline(at)).withColumnRenamed("i", "off")


def bitmap(hashes: DataFrame) -> bytes:
    """The column ``h`` as a bitmap of bounded size: bit ``h mod 2^k`` is set.

    Spark builds blocks of 2^15 bits; at most 2^(24 - 15) blocks come to the driver.
    """
    least, greatest = BITS
    bits = min(greatest, max(least, (32 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    blocks = (
        hashes.select(F.shiftright(at, BLOCK).alias("block"), at.bitwiseAND(F.lit((1 << BLOCK) - 1)).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    )
    size = 1 << (BLOCK - 3)
    out = bytearray(1 << (bits - 3))
    for block, part in blocks.collect():
        out[block * size : (block + 1) * size] = part
    return bytes(out)


def _in_bitmap(bits: bytes):
    """A test of a struct's ``h`` against the bitmap; most bytes are zero and need no second look."""
    literal, mask = F.lit(bits), F.lit(8 * len(bits) - 1)

    def test(e: Column) -> Column:
        at = e["h"].bitwiseAND(mask)
        byte = F.substring(literal, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
        number = F.conv(F.hex(byte), 16, 10).cast("long")
        return (byte != F.lit(b"\x00")) & (F.getbit(number, at.bitwiseAND(F.lit(7)).cast("int")) == 1)

    return test


def _sizes(windows: DataFrame) -> list[int]:
    """The shingle sizes in use: at most ``shingle`` numbers."""
    return sorted(r["s"] for r in windows.select("s").distinct().collect())


def _passing(w: Column, sizes: list[int], test) -> Column:
    """(h, i) of the words' shingles that pass the test."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.filter(F.concat(none, *[_shingles(w, s) for s in sizes]), test)


def _finds(text: Column, sizes: list[int], test, window: int) -> Column:
    """(n_words, finds): array of (h, i, lo, ctx): shingles of the text that pass the test,
    their word position, and the words from position ``lo`` that any window around them needs."""

    def around(w: Column):
        def one(e: Column) -> Column:
            lo = F.greatest(e["i"] - (window - 1), F.lit(0))
            return F.struct(
                e["h"].alias("h"), e["i"].alias("i"), lo.alias("lo"), F.slice(w, lo + 1, 2 * window - 1).alias("ctx")
            )

        return one

    def body(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.transform(_passing(w, sizes, test), around(w)).alias("finds")
        )

    return bind(alnum_words(text_or_empty(text)), body)


def prefixes(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Of each window's shingles the rarest in the documents: windows + (h, off)."""
    shingles = window_shingles(windows, shingle)
    test, sizes = _in_bitmap(bitmap(shingles.select("h").distinct())), _sizes(windows)
    passing = bind(
        alnum_words(text_or_empty(F.col("text"))), lambda w: F.transform(_passing(w, sizes, test), lambda e: e["h"])
    )
    counts = docs.select(F.explode(passing).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    best = (
        shingles.join(counts, "h", "left")
        .groupBy("wid")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "h", "off")).alias("best"))
    )
    return windows.join(best, "wid").select("wid", "words", "size", "best.h", "best.off")


def _sized_side(df: DataFrame, width: Column, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has been found to be small."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, chunk: int = CHUNK
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items (sorted strings), row_key (hash of doc_id
    and text), contaminated."""
    spark = docs.sparkSession
    pairs = item_windows(benchmark, window)
    windows = numbered_windows(pairs, shingle)
    # The chosen prefixes are the result of a pass over the documents: written once.
    chosen = _written(spark, prefixes(docs, windows, shingle))
    members = pairs.filter("item_id is not null").join(windows, "words").select(F.col("wid").alias("of"), "item_id")
    key = F.xxhash64("doc_id", "text").alias("row_key")
    row = docs.select("doc_id", "text", key, F.monotonically_increasing_id().alias("rid"))
    test = _in_bitmap(bitmap(chosen.select("h").distinct()))
    found = row.select("doc_id", "row_key", "rid", _finds(F.col("text"), _sizes(windows), test, window).alias("f")).select(
        "doc_id", "row_key", "rid", F.col("f.n_words").alias("n_words"), F.explode_outer("f.finds").alias("e")
    )
    # Rows without a find or a window match nothing; keys of their own spread them where a join shuffles.
    probe = F.coalesce(F.col("e.h"), F.col("rid"))
    start = F.col("e.i") - F.col("off")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    same = F.slice("e.ctx", F.greatest(start - F.col("e.lo") + 1, F.lit(1)), F.col("size")) == F.col("words")
    prefix = _sized_side(chosen, 64 + F.length(F.concat_ws(" ", "words")), chunk)
    hits = (
        found.join(prefix, (probe == F.col("h")) & fits & same, "left")
        .select("rid", "doc_id", "row_key", "n_words", "wid", F.struct(start.alias("a"), (start + F.col("size")).alias("b")).alias("x"))
        .repartition("rid")
        .groupBy("rid", "wid")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "row_key", "n_words")],
            F.collect_set(F.when(F.col("wid").isNotNull(), F.col("x"))).alias("at"),
        )
    )
    names = _sized_side(members, 32 + F.length("item_id"), chunk)
    out = hits.join(names, F.coalesce(F.col("wid"), -1 - F.col("rid")) == F.col("of"), "left")
    spans = out.groupBy("rid").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("row_key").alias("row_key"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("at")))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], x["b"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )
    return spans.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "row_key"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _written(spark, df: DataFrame) -> DataFrame:
    from runledger.session import scratch_path

    path = scratch_path(spark, "llm-prefixes")
    df.write.parquet(path)
    return spark.read.parquet(path)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    key = free_name(docs, "row_key")
    bad = contamination(docs, benchmark, **options).filter("contaminated").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        sha256_hex(F.concat_ws(",", "items")).alias("items_sha256"),
        "contaminated",
    )
