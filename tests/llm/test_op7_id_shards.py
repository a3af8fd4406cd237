import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from runledger.llm import id_shards as S
from runledger.llm.forced_bpe import tokenizer_path
from runledger.session import scratch_path


def expected(texts, ids):
    library = Tokenizer.from_file(tokenizer_path())
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0))
    start, out = 0, []
    for i in order:
        got = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        out.append((ids[i], start, len(got), zlib.crc32(np.array(got, "<u4").tobytes())))
        start += len(got)
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_round_trip(spark, documents):
    texts = [f"text number {i} " + "word " * (i % 40) for i in range(200)] + [None, "", "x" * 20_000]
    ids = [*range(500, 300, -1), None, 7, -3]
    target = scratch_path(spark, "shards")
    S.write_shards(documents(texts, ids=ids), target)
    got = sorted((tuple(r) for r in S.digest(S.read_shards(spark, target)).collect()), key=key)
    assert got == sorted(expected(texts, ids), key=key)


def test_one_document_is_read_alone(spark, documents, monkeypatch):
    texts = [f"some words {i} and more words of the kind" for i in range(60)]
    target = scratch_path(spark, "shards")
    S.write_shards(documents(texts), target)
    (meta,) = spark.read.parquet(f"{target}/dictionary").collect()
    dictionary = bytes(meta["dictionary"])
    library = Tokenizer.from_file(tokenizer_path())
    for row in spark.read.parquet(f"{target}/shards").collect():
        blob = bytes(row["blob"])
        for k, doc_id in enumerate(S.unpack(blob)[2]):
            assert S.read_document(blob, k, dictionary).tolist() == [*library.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        with pytest.raises(ValueError):
            S.read_document(blob, 0, dictionary + b"x")
        with pytest.raises(ValueError):
            S.unpack(b"none" + blob)


def test_repeated_rows_and_empty_table(spark, documents):
    target = scratch_path(spark, "shards")
    S.write_shards(documents(["b", "a", "a"], ids=[1, 1, 1]), target)
    rows = sorted(S.read_shards(spark, target).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, 2, 4] and len({bytes(r["ids"]) for r in rows}) == 2
    empty = scratch_path(spark, "shards")
    S.write_shards(documents(["x"]).limit(0), empty)
    assert S.read_shards(spark, empty).count() == 0
