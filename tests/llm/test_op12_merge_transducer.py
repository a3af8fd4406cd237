import codecs
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from runledger.llm import merge_transducer as M

RANKS = M.load_ranks(M.ranks_path())
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MACHINE = M.Transducer(M.ranks_path())
ODD = [
    "", " ", "  ", "\n\n a", "a  b", "a \n b", "it's we'll 'S ''s 're'r 'l 'll' x", "don't", "' s 'sabc", "'s's", "x's 's", "<|endoftext|>",
    "日本語 テスト", "é́ é", "  x", "1² ½x", "👩‍👩‍👧 🏳️‍🌈", "\x00\x1c\x1f\x85", " 　a", "ſ'ſ 'ſ", "aaaa" * 50, "-" * 300,
    " " * 500, "\t\t\t x", "ab" * 400, "\U0010ffff͸﷐",
]


def check(machine, library, texts):
    ids, edges = machine.encode(texts)
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == library.encode_ordinary(t), t
    assert machine.decode(ids, edges) == texts


def test_equals_the_library_on_odd_texts():
    check(MACHINE, LIBRARY, ODD)
    check(MACHINE, LIBRARY, ["".join(ODD), *reversed(ODD)])


def test_equals_the_library_on_random_texts():
    rng = random.Random(5)
    tokens = [t.decode("utf-8", "ignore") for t in rng.sample(list(RANKS), 3000)]
    kinds = ["abcde", "aA '-.", " \n\t", "étñß", "漢字かな", "01²"]
    texts = []
    for _ in range(1500):
        out = ""
        for _ in range(rng.randint(0, 8)):
            pick = rng.random()
            out += rng.choice(tokens) if pick < 0.6 else "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(1, 12)))
        texts.append(out)
    check(MACHINE, LIBRARY, texts)
    small = M.Transducer(M.ranks_path(), most_transitions=50)  # forgets after every batch
    for i in range(0, 300, 30):
        check(small, LIBRARY, texts[i : i + 30])


def test_other_vocabulary():
    path = M.ranks_path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("multi", pat_str=P.PATTERN, mergeable_ranks=M.load_ranks(path), special_tokens={})
    check(M.Transducer(path), library, [*ODD, "Привет, мир! こんにちは世界 " * 5])


def test_neighbours_are_those_that_encode_to_themselves():
    rng = random.Random(6)
    tokens = list(RANKS.items())
    for _ in range(3000):
        (a, i), (b, j) = rng.choice(tokens), rng.choice(tokens[:400])
        parts = MACHINE.merges.merge(a + b)
        assert MACHINE.merges.follows(i, j) == (parts == [a, b])


def test_tokens_that_do_not_merge_are_given_for_whole_pieces_only(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"xyz": 258, b"yz": 259}  # xyz: no way to it but yz
    ranks |= {b"pqr": 260}  # no merge leads to it
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine = M.Transducer(str(path))
    assert machine.whole == {260}
    check(machine, library, ["pqr", "pqrx", "xpqr", "pqr pqr", "xyz xxyz abcab", "pq"])


def test_lookahead_is_bounded_and_tokens_come_out_early():
    state, emitted = M._START, []
    for byte in (b" international" * 40)[1:]:
        state, out = MACHINE.step(state, byte)
        emitted.extend(out)
        assert max(len(w) for _, w in state[1]) <= 8
    assert len(emitted) > 30


def test_table_grows(monkeypatch):
    monkeypatch.setattr(M.TransitionTable, "BITS", 4)
    check(M.Transducer(M.ranks_path()), LIBRARY, ODD)


def test_utf8_machine_equals_codecs():
    rng = random.Random(7)
    good = "aé漢👩߿ࠀ￿\U00010000\U0010ffff".encode()
    for _ in range(2000):
        data = bytes(rng.choice(good + b"\x80\xbf\xc0\xc1\xe0\xed\xf0\xf4\xf5\xff\xa0\x9f") for _ in range(rng.randint(0, 12)))
        if rng.random() < 0.3:
            data = good[: rng.randint(0, len(good))]
        mine, theirs, i = M.Utf8Stream(), codecs.getincrementaldecoder("utf-8")("replace"), 0
        got = want = ""
        while i < len(data):
            j = i + rng.randint(1, 4)
            got += mine.feed(data[i:j])
            want += theirs.decode(data[i:j])
            i = j
        assert got + mine.end() == want + theirs.decode(b"", True)


def test_streaming_decode_in_any_blocks():
    text = "naïve 漢字 👩‍👩‍👧 end" * 20
    ids, _ = MACHINE.encode([text])
    for block in (1, 2, 3, 7, 1000):
        assert "".join(MACHINE.decode_stream(ids, block)) == text


@pytest.mark.parametrize("texts", [["plain text", None, "", "same", "same", "it's 漢字", "word " * 30_000, "q" * 40_000]])
def test_query_rows(documents, texts):
    docs = documents(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in M.digest(docs).collect()}
    for i, t in enumerate(texts):
        want = LIBRARY.encode_ordinary(t or "")
        assert got[i] == (
            len(want),
            hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest(),
        )
    full = M.encode_decode(docs)
    assert set(docs.columns) < set(full.columns) and {r["decoded"] for r in full.collect()} == {t or "" for t in texts}
    assert M.digest(docs.limit(0)).count() == 0
