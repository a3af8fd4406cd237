import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from runledger.llm import forced_bpe as B


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(B.tokenizer_path())


@pytest.fixture(scope="module")
def bpe():
    return B.FragmentBpe(B.tokenizer_path())


ODD = list("ab'strevlmd  \n\t1²٣é中ñ!?\x1c\x00ᲊ\U0001f600́\x85　") + ["<|endoftext|>", "'s", "'re", "'ll", "  ", " '"]


def test_random_texts_equal_the_library(bpe, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) for _ in range(4000)]
    ids, edges = bpe.encode(texts)
    for t, a, b, back in zip(texts, edges, edges[1:], bpe.decode(ids, edges), strict=False):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, t
        assert back == library.decode(want, skip_special_tokens=False) == t


def test_every_known_character(bpe, library):
    texts = ["a" + chr(c) + "1 " + chr(c) + "!" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    ids, edges = bpe.encode(texts)
    for t, a, b in zip(texts, edges, edges[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_endless_words_and_small_table(bpe, library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_FRAGMENTS", 50)  # the table is emptied again and again
    rng = random.Random(2)
    texts = ["x" * 5000, "ab" * 3000, "".join(rng.choice("abcdeé") for _ in range(20_000)), "中" * 900, " " * 4000 + "x", "\n" * 999]
    for group in ([t] for t in texts):
        ids, edges = bpe.encode(group)
        assert ids.tolist() == library.encode(group[0], add_special_tokens=False).ids
        assert bpe.decode(ids, edges) == group


def test_cuts_never_split_a_token(bpe):
    inside = bpe.inside.reshape(256, 256)
    for raw in bpe.token_bytes[:-1]:
        assert all(inside[a, b] for a, b in zip(raw, raw[1:], strict=False))
    assert b"".join(bpe.fragments(["héllo wörld中"])) == "héllo wörld中".encode()
    assert not inside.all()


def test_fragment_table():
    rng = np.random.default_rng(0)
    table = B.FragmentTable()
    low, high = rng.integers(0, 1 << 40, 50_000, dtype=np.uint64), rng.integers(0, 4, 50_000, dtype=np.uint64)
    keys = np.unique(np.stack([low, high], 1), axis=0)
    table.add(keys[:, 0], keys[:, 1], np.arange(len(keys), dtype=np.int32))
    assert (table.find(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    assert (table.find(keys[:, 0] + np.uint64(1 << 50), keys[:, 1]) == -1).all()


def test_documents(documents, library):
    texts = ["a b", None, "", "café <|endoftext|> 12", "x" * 3000]
    docs = documents(texts)
    coded = B.encode_decode(docs)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    rows = {r["doc_id"]: r for r in B.digest(coded).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert B.encode_decode(docs.limit(0)).count() == 0
