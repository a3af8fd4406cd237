import random
from math import comb

import numpy as np
import pytest

from runledger.llm import minhash_bayes as M


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [(len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def groups(n=220, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    bases = [[rng.choice(vocab) for _ in range(rng.randint(3, 150))] for _ in range(12)]
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append((" " if rng.random() < 0.5 else "\n").join(x.upper() if rng.random() < 0.1 else x for x in w))
    return texts + [None, "", "  ", "one", "ONE", "one two", "Ünï cöde", "ünï cöde"]


@pytest.mark.parametrize("block", [512, 16])
def test_components_equal_brute_force(documents, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)  # 16: buckets are dealt out in blocks
    texts = groups()
    got = {r["doc_id"]: r for r in M.near_duplicates(documents(texts)).collect()}
    want = brute(texts)
    assert len({w[1] for w in want}) < len(texts) - 100
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == want


def test_chain_of_links_crosses_spanning_pairs(documents):
    """a-b-c-...: neighbours are near, ends are not; one component."""
    rng = random.Random(1)
    w = [f"v{i}" for i in range(200)]
    texts = []
    for k in range(30):
        w = list(w)
        w[5 * k] = f"z{k}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    assert {r["component_id"] for r in M.near_duplicates(documents(texts)).collect()} == {0}


def test_one_of_each_group_stays(documents):
    texts = groups(60)
    docs = documents(texts)
    out = M.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i, w in enumerate(brute(texts)) if w[2]]


def test_repeated_ids_nulls_and_empty_table(documents):
    t = " ".join(f"w{i}" for i in range(60))
    docs = documents([t, t, t + " end", "other words here", None, t], ids=[5, 5, 3, 9, None, None])
    rows = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in M.near_duplicates(docs).collect())
    assert rows == sorted(
        [("5", "3", False), ("5", "3", False), ("3", "3", True), ("9", "9", True), ("None", "None", True), ("None", "3", False)]
    )
    assert sorted(r["doc_id"] for r in M.drop_near_duplicates(documents([t, t], ids=[4, 4])).collect()) == [4]
    left = M.drop_near_duplicates(documents([t, t.upper(), "a b", "A  b", "c", None, ""], ids=[4, None, None, None, 5, None, None]))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["4", "5", "None", "None", "None"]
    assert left.columns == documents(["x"]).columns
    assert M.near_duplicates(documents(["x"]).limit(0)).count() == 0


def test_an_id_with_several_texts_is_linked_by_each(documents):
    words_ = lambda k: " ".join(f"{k}{i}" for i in range(40))
    a, b, c, d = map(words_, "abcd")
    docs = documents([b, a, b, c, c + " x", d, d.upper(), a], ids=[3, 5, 5, 7, 8, 9, 9, 11])
    rows = sorted((r["doc_id"], r["component_id"], r["kept"], r["n_shingles"]) for r in M.near_duplicates(docs).collect())
    # 5 is a copy of 3 by one text and of 11 by the other
    assert rows == sorted(
        [(3, 3, True, 36), (5, 3, False, 36), (5, 3, False, 36), (7, 7, True, 36), (8, 7, False, 37), (9, 9, True, 36), (9, 9, True, 36)]
        + [(11, 3, False, 36)]
    )
    left = sorted((r["doc_id"], r["text"]) for r in M.drop_near_duplicates(docs).collect())
    assert left == [(3, b), (7, c), (9, d.upper())]
    both = documents([a, b, "", None], ids=[5, 5, 5, 6])
    one = M.drop_near_duplicates(both).collect()
    assert sorted(r["doc_id"] for r in one) == [5, 6]
    assert {r["text"] for r in one} == {r["text"] for r in M.drop_near_duplicates(both.repartition(7)).collect()}


def test_a_set_of_more_shingles_than_a_signature_step(documents):
    w = [f"w{i}" for i in range(9000)]
    docs = documents([" ".join(w), " ".join(w[:8000] + ["x"] * 3), " ".join(w[3000:])])
    assert [r["component_id"] for r in M.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 0, 2]


def test_pruning_keeps_the_chosen_miss_probability():
    for n in (32, 64, 96, 128):
        m = M.least_matches(n)
        tail = lambda k: sum(comb(n + 1, j) * 0.75**j * 0.25 ** (n + 1 - j) for j in range(k + 1))
        assert tail(m) >= M.MISS > tail(m - 1)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1 << 62, 3000, dtype=np.uint64)
    got = (M.signature(np.unique(x[:2000])) == M.signature(np.unique(x[500:2500]))).mean()
    assert abs(got - 0.6) < 0.15
