import hashlib
import random

import numpy as np
import pytest

from runledger.llm import suffix_dedup as S


def brute(texts, length):
    raws, seen = [(t or "").encode() for t in texts], {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fixture():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(300)) for _ in range(6)]

    def doc():
        out = ""
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, 200)
            out += rng.choice(base)[i : i + rng.randint(0, 120)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        return out

    texts = [doc() for _ in range(250)] + [None, "", "a" * 500, "a" * 300, "ab" * 100, base[0], base[0], base[1], "q" * 99, "q" * 100]
    return texts + [texts[5]] * 4


@pytest.mark.parametrize("variants", [2000, 2])
def test_removal_equals_brute_force(documents, variants):
    texts = fixture()
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(S.remove_repeated(documents(texts), 100, variants)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 100)


def test_sorted_suffixes_and_collisions(monkeypatch):
    rng = random.Random(4)
    for _ in range(40):
        raw = bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 400))) + b"a" * rng.randint(0, 60) + b"abc" * rng.randint(0, 30)
        data, places = np.frombuffer(raw, np.uint8), np.arange(len(raw) - 19)
        order = S.SuffixSort(20).sort(data, places)
        assert order.tolist() == sorted(places.tolist(), key=lambda i: (raw[i : i + 20], i))
        seen = [raw[i : i + 20] for i in places]
        want = [seen.count(x) > 1 for x in seen]
        assert S.SuffixSort(20).repeated(data, places).tolist() == want
    weak = S.SuffixSort(20)
    real = weak.hashes.between
    monkeypatch.setattr(weak.hashes, "between", lambda a, b, which=0: real(a, b, which) & np.uint64(1))  # nearly all collide
    got = weak.repeated(data, places)
    assert not (got & ~np.array(want)).any()  # a collision removes nothing


def test_anchors_cover_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 50, 3000, dtype=np.uint64)  # many ties
    valid = np.ones(3000 - 40 + 1, bool)
    valid[1000:1100] = False
    pos, first, last = S.segments_of(g, valid, 40)
    seen = {}
    for p, a, b in zip(pos, first, last, strict=True):
        for s in range(a, b + 1):
            seen[s] = p
    assert sorted(seen) == np.flatnonzero(valid).tolist()
    assert all(p == s + int(g[s : s + 40].argmin()) for s, p in seen.items())


def test_repeats_inside_one_document_and_empty_table(documents):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefgh ") for _ in range(450))
    texts = [part + "1" + part, "".join(rng.choice("abcdefgh ") for _ in range(2000))]
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(S.remove_repeated(documents(texts))).collect()}
    assert [got[0], got[1]] == brute(texts, 400) and got[0][1] == 900
    assert S.remove_repeated(documents(["x"]).limit(0)).count() == 0


def test_texts_beyond_the_buffers(documents):
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(80_000))
    assert len(long) > max(S.BUFFER, 400_000)
    other = "x" + long[S.BUFFER - 500 : S.BUFFER + 700] + "y" + long[:450] + "é" + " ".join(rng.choice(words) for _ in range(70_000))
    texts = [long, other, long[5000:5390], "zz" + long[-401:] + "z"]
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(S.remove_repeated(documents(texts))).collect()}
    assert [got[i] for i in range(4)] == brute(texts, 400) and got[0][1] > 2000


def test_texts_reach_python_in_small_batches(spark):
    from pyspark.sql import functions as F

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 150).alias("text"))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(texts):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "n": [b.num_rows]})

        return texts.mapInArrow(run, "bytes bigint, n bigint")

    rows = S._written(sizes(docs.select("text")), "sizes").collect()  # 28,800,000 bytes in one task
    assert sum(r["n"] for r in rows) == 3000
    assert max(r["bytes"] for r in rows) < 2 * S.BATCH_BYTES
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("few", [500_000, -1])
def test_only_single_texts_go_to_python_to_be_cut(documents, monkeypatch, few):
    texts = fixture()
    given, real = [], S._cut

    def seen(cut):
        given.extend(r["doc_id"] for r in cut.select("doc_id").collect())
        return real(cut)

    monkeypatch.setattr(S, "_cut", seen)
    monkeypatch.setattr(S, "BROADCAST_ROWS", few)
    got = {r["doc_id"]: tuple(r)[1:] for r in S.digest(S.remove_repeated(documents(texts), 100)).collect()}
    want = brute(texts, 100)
    assert [got[i] for i in range(len(texts))] == want
    once = {i for i, t in enumerate(texts) if texts.count(t) == 1}
    cut = {i for i in once if want[i][1]}
    assert sorted(given) == sorted(cut if few > 0 else once - {i for i in once if texts[i] in ("", None)})
