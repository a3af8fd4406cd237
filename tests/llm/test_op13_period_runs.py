import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from runledger.llm import period_runs as R


def brute(words, shortest=12):
    """All runs by walking every diagonal."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j
    return sorted((s, size, q) for (s, size), q in found.items())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(doc_id, text):
    words = split(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def random_words(rng):
    kind = rng.random()
    letters = "ab" if kind < 0.3 else "abcd" if kind < 0.6 else "abcdefghijkl"
    out = []
    for _ in range(rng.randint(0, 8)):
        root = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 24, 30, 47, 60]))]
        n = rng.randint(1, 4 * len(root) + 3)
        out += [root[i % len(root)] for i in range(n)]
        out += [rng.choice(letters) for _ in range(rng.randint(0, 4))]
    return out


def numbers(docs):
    ids = {}
    w = np.array([ids.setdefault(x, len(ids)) for d in docs for x in d], np.int64)
    return w, np.concatenate([[0], np.cumsum([len(d) for d in docs])])


@pytest.mark.parametrize("shortest", [12, 4])
def test_runs_equal_every_diagonal(shortest):
    rng = random.Random(9)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(20)]
        w, edges = numbers(docs)
        got = [[] for _ in docs]
        for d, *run in R.find_runs(w, edges, shortest).tolist():
            got[d].append(tuple(run))
        assert got == [brute(d, shortest) for d in docs]


def test_nested_powers():
    a, b = ["a"] * 13, ["b"]
    for words in (
        (a + b) * 20, (a + b + a + ["c"]) * 9, ["a"] * 400, (["a", "b"] * 30 + ["a"]) * 5, ((a + b) * 4 + ["c"]) * 6,
        list("abaababaabaababaababaabaababaabaab" * 5), (["x"] * 100 + ["y"]) * 4 + (["x"] * 90 + ["y"]) * 4,
    ):
        w, edges = numbers([words, words[3:], []])
        got = R.find_runs(w, edges)
        assert [tuple(r[1:]) for r in got.tolist() if r[0] == 0] == brute(words)
        assert [tuple(r[1:]) for r in got.tolist() if r[0] == 1] == brute(words[3:])


def test_pairs_stay_proportional_to_the_words():
    for words in (["a"] * 20_000, (["a"] * 199 + ["b"]) * 100, ["a", "b", "c"] * 7000, (["a"] * 500 + ["b"] + ["a"] * 500 + ["c"]) * 20):
        w, edges = numbers([words])
        doc = np.zeros(len(w), np.int64)
        levels = R.gram_levels(w, doc)
        for level, names in enumerate(levels):
            if level:
                assert len(R.cluster_pairs(names, 6 << level)[0]) <= 10 * len(w)
        assert len(levels) <= 14


def test_query_rows(documents):
    rng = random.Random(10)
    texts = [" ".join(random_words(rng)) for _ in range(150)]
    texts += [None, "", " \t\n", "one", " x  y\x1cz " * 9, "a \n" * 300, "same same", "same same", "w" * 5000]
    texts += [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(4000))]
    ids = [i * 7 for i in range(len(texts) - 1)] + [None]
    docs = documents(texts, ids=ids)
    found = R.periodic_runs(docs.withColumn("text", R.planted_text(docs["doc_id"], docs["text"])))
    got = {r["doc_id"]: tuple(r)[1:] for r in R.digest(found).collect()}
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids)
    for i, t in zip(ids, texts, strict=True):
        assert got[i] == expected(i, t), (i, t)
    assert R.digest(R.periodic_runs(docs.limit(0))).count() == 0


def test_a_text_longer_than_a_batch(documents, monkeypatch):
    monkeypatch.setattr(R, "BATCH_BYTES", 300)
    rng = random.Random(11)
    texts = [" ".join(random_words(rng)) for _ in range(40)] + ["ab cd ef " * 400, None]
    got = {r["doc_id"]: r["runs"] for r in R.periodic_runs(documents(texts)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(r) for r in got[i]] == brute(split(t))
