"""Token ids in binary shards, compressed per document with a shared dictionary.

A zstandard dictionary is trained on the serialized ids of a bounded sample of
short documents (``sample_docs``, ``sample_chars``).  Documents are dealt out
by ranges of doc_id, sorted inside each range, encoded, and every document is
compressed on its own, so that one short document can be read without its
neighbours.  A shard is a self-describing byte string:

    magic "IDZ1" | dictionary sha256 (32) | documents n (u32)
    | offsets (n + 1) x u64 | doc_id n x i64 | doc_id is null n x u8 | ids n x u32 | zstandard frames

Shards are kept in Parquet rows (part, seq, start_in_part, n_ids, blob), so
they are written with Spark's commit protocol to whatever store the session
uses, and a lost executor only repeats its own range.  The dictionary lies
beside them under its hash, which the reader checks.

The first id of a document among all documents is its range's total so far
(one number per range, summed over at most as many rows as there are
ranges) plus its place in the range.

Defined cases: null and empty texts hold the end id only; rows with a null
doc_id come first; repeated rows are all written, in the order of their
texts' hashes; a very long text is encoded and compressed alone; only ``doc_id`` and ``text`` are read; an empty
table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm.forced_bpe import loaded, small_batches, text_groups, tokenizer_path
from runledger.llm.text import bounded_sample
from runledger.llm.workers import send_package

MAGIC = b"IDZ1"
END_ID = 2
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 4096
DICT_BYTES = 32_768
SHARD_BYTES = 8_000_000


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from at most ``sample_docs`` documents of at most ``sample_chars`` characters
    (by the order of their ids' hashes); b'' where the sample is too small to train on."""
    import zstandard

    short = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars)
    texts = sorted(r["text"] for r in bounded_sample(short, ["doc_id", "text"], sample_docs).collect())
    rows = [x for x in loaded(path).encode_batch(texts) if x]
    try:
        return zstandard.train_dictionary(DICT_BYTES, rows).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def pack(entries: list[tuple[int | None, int, bytes]], dict_hash: bytes) -> bytes:
    """A shard of (doc_id, number of ids, frame)."""
    n = len(entries)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(e[2]) for e in entries], out=offsets[1:])
    ids = np.array([e[0] or 0 for e in entries], "<i8")
    nulls = np.array([e[0] is None for e in entries], "u1")
    counts = np.array([e[1] for e in entries], "<u4")
    head = MAGIC + dict_hash + struct.pack("<I", n)
    return b"".join([head, offsets.tobytes(), ids.tobytes(), nulls.tobytes(), counts.tobytes(), *[e[2] for e in entries]])


def unpack(blob: bytes) -> tuple[bytes, np.ndarray, list[int | None], np.ndarray, memoryview]:
    """(dictionary sha256, offsets, doc_ids, counts, frames) of a shard."""
    if blob[:4] != MAGIC:
        raise ValueError("not a shard")
    dict_hash, (n,) = blob[4:36], struct.unpack_from("<I", blob, 36)
    at = 40
    offsets = np.frombuffer(blob, "<u8", n + 1, at)
    at += 8 * (n + 1)
    ids = np.frombuffer(blob, "<i8", n, at).tolist()
    at += 8 * n
    nulls = np.frombuffer(blob, "u1", n, at)
    at += n
    counts = np.frombuffer(blob, "<u4", n, at)
    at += 4 * n
    return dict_hash, offsets, [None if z else i for i, z in zip(ids, nulls, strict=True)], counts, memoryview(blob)[at:]


def read_document(blob: bytes, k: int, dictionary: bytes) -> np.ndarray:
    """The ids of the k-th document of a shard, without touching the others."""
    import zstandard

    dict_hash, offsets, _, counts, frames = unpack(blob)
    if hashlib.sha256(dictionary).digest() != dict_hash:
        raise ValueError("another dictionary")
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    raw = zstandard.ZstdDecompressor(**known).decompress(
        bytes(frames[int(offsets[k]) : int(offsets[k + 1])]), max_output_size=4 * int(counts[k])
    )
    return np.frombuffer(raw, "<u4")


def write_shards(docs: DataFrame, target: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Encodes every document and writes ``target``/shards and ``target``/dictionary."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    send_package(spark)
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(
        f"{target}/dictionary"
    )
    last = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        bpe = loaded(path)
        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdCompressor(level=3, **known)
        part = TaskContext.get().partitionId()
        seq = start = size = total = 0
        entries: list[tuple[int | None, int, bytes]] = []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "start_in_part": pa.array([start], pa.int64()),
                    "n_ids": pa.array([total], pa.int64()),
                    "blob": pa.array([pack(entries, digest)], pa.binary()),
                }
            )

        for batch in small_batches(batches):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_groups(texts):
                for doc_id, coded in zip(ids[a:b], bpe.encode_batch(texts[a:b]), strict=True):
                    frame = press.compress(coded + last)
                    entries.append((doc_id, len(coded) // 4 + 1, frame))
                    size += len(frame)
                    total += len(coded) // 4 + 1
                    if size >= SHARD_BYTES:
                        yield shard()
                        seq, start, size, total, entries = seq + 1, start + total, 0, 0, []
        if entries:
            yield shard()

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    ordered.mapInArrow(run, "part int, seq int, start_in_part bigint, n_ids bigint, blob binary").write.parquet(
        f"{target}/shards"
    )


def read_shards(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document, from the files."""
    send_package(spark)
    (row,) = spark.read.parquet(f"{target}/dictionary").collect()
    dictionary, digest = bytes(row["dictionary"]), bytes.fromhex(row["sha256"])
    shards = spark.read.parquet(f"{target}/shards")
    # One row per range of doc_id; that number is a setting of the session, so it is small.
    ends = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = ends.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
    placed = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start_in_part")).alias("at"), "blob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        press = zstandard.ZstdDecompressor(**known)
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, offsets, ids, counts, frames = unpack(blob.as_py())
                if found != digest:
                    raise ValueError("a shard was written with another dictionary")
                edges = offsets.tolist()
                starts = at + np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)]).astype(np.int64)
                for a in range(0, len(ids), 1000):
                    some = range(a, min(a + 1000, len(ids)))
                    raw = [
                        press.decompress(bytes(frames[edges[k] : edges[k + 1]]), max_output_size=4 * int(counts[k]))
                        for k in some
                    ]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(ids[some.start : some.stop], pa.int64()),
                            "start": pa.array(starts[some.start : some.stop], pa.int64()),
                            "n_tokens": pa.array([len(x) // 4 for x in raw], pa.int64()),
                            "ids": pa.array(raw, pa.binary()),
                        }
                    )

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
