import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runledger.llm import chunk_audit as A

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, min_docs, top):
    """Rows (lang, source, part, item, value, rank) by the definition."""
    docs = [((lang or "", source or ""), terms(t)) for t, lang, source in rows]
    seen = defaultdict(Counter)
    for (lang, _), w in docs:
        seen[lang].update(set(w))
    kept = {lang: {t for t, n in c.items() if n >= min_docs} for lang, c in seen.items()}
    counts = {g: Counter() for g, _ in docs}
    for g, w in docs:
        counts[g].update(t for t in w if t in kept[g[0]])
    by_lang = defaultdict(Counter)
    for (lang, _), c in counts.items():
        by_lang[lang].update(c)

    def share(c, lang):
        total = sum(c.values()) + 5 * len(kept[lang])
        return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept[lang]}

    p = {g: share(c, g[0]) for g, c in counts.items()}
    q = {lang: share(c, lang) for lang, c in by_lang.items()}
    out = []
    for lang, source in counts:
        mine = p[lang, source]
        pairs = [(o, sum(abs(mine[t] - p[lang, o][t]) for t in mine)) for k, o in counts if k == lang and o != source]
        over = [(t, mine[t] - q[lang][t]) for t in mine if counts[lang, source][t] and mine[t] > q[lang][t]]
        for part, found, most in (("pair", pairs, None), ("term", over, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def fixture():
    rng = random.Random(12)
    vocab = ["The", "the", "the,", "well-known", "é", "É", "x y", "42", "$9", "naïve", "日本", "a1b", "no break"]
    vocab += [f"w{c}" for c in "abcdefghijklmnopqrstuv"]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None, "empty"])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "Ü3", None, "s4"])
        text = rng.choice([" ", "\n", " \t"]).join(rng.choice(vocab[: rng.choice([8, 20, 35])]) for _ in range(rng.randint(0, 15)))
        rows.append((rng.choice([None, "", "12 %"]) if lang == "empty" or rng.random() < 0.05 else text, lang, source))
    return rows + [("the rare one-off", "fr", "only"), (" w " * 3000, "en", "s1"), ("the", "en", "alone")] + rows[:30]


@pytest.fixture(scope="module")
def table(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return rows, df.withColumns({c: F.lit(c) for c in ("doc_id", "n", "p", "term", "block", "rank", "tile")})


@pytest.mark.parametrize(
    ("min_docs", "limits"),
    [(30, {}), (3, {"top": 7}), (8, {"block_bytes": 200, "bucket_terms": 3, "tile_sources": 2}), (10_000, {"tile_sources": 1})],
)
def test_audit_equals_brute_force(table, min_docs, limits):
    rows, df = table
    got = sorted(tuple(r) for r in A.audit(df, min_docs=min_docs, **limits).collect())
    assert got == brute(rows, min_docs, limits.get("top", 50))


def test_counts_of_documents_are_distinct_across_chunks(spark):
    rows = [("The the, THE (the) well-known", "en", "a"), ("known the", "en", "a"), ("the", "en", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    kept, counts = A.term_counts(df, min_docs=1, block_bytes=20)
    assert {(r["term"], r["documents"]) for r in kept.collect()} == {("the", 3), ("well", 1), ("known", 2)}
    assert ("en", "a", "the", 2, 5) in {(r["lang"], r["source"], r["term"], r["documents"], r["n"]) for r in counts.collect()}


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(7_999_999_999_999, 10**15 + 1, 10**7)], "n bigint, total bigint, v bigint")
    got = df.select(A._share(F.col("n"), F.col("total"), F.col("v"))).first()[0]
    assert got == 1 + 10**9 * (7_999_999_999_999 + 5) // (10**15 + 1 + 5 * 10**7)


def test_empty_table(table):
    assert A.audit(table[1].limit(0)).count() == 0


def test_slices_cover_all_owners(monkeypatch):
    monkeypatch.setattr(A, "SLICE", 10)
    edges = np.array([0, 3, 3, 9, 40, 41, 41, 50, 52])
    got = list(A._slices(edges))
    assert got[0][0] == 0 and got[-1][1] == 8 and all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))
    assert all(edges[b] - edges[a] <= 10 or b == a + 1 for a, b in got)


def test_blocks_in_small_slices_equal_large_ones(monkeypatch):
    asked = pa.table({"block": [0] * 3, "cid": [0, 1, 2], "term": ["a", "b", "a"]})
    key = np.array([0, 1, 2, 5, 8])
    triples = {"home": [0], "docs": [4], "langs": [["d", "e", "e"]], "sources": [["s", "s", "t"]]}
    triples |= {k: [A._packed(np.array(v))] for k, v in (("pairs", np.diff(key, prepend=0)), ("n", [1, 1, 1, 2, 50]), ("grp", [1, 2, 0]))}
    want = [("d", "s", "a", 1, 50), ("e", "s", "a", 1, 2), ("e", "s", "b", 1, 1), ("e", "t", "b", 1, 2)]
    for size in (1, 2, 500_000):
        monkeypatch.setattr(A, "SLICE", size)
        got = A._count_block(asked, pa.table(triples)).to_pylist()
        assert sorted(tuple(r.values()) for r in got) == want


@pytest.mark.parametrize("top", [0, 255, 256, 65_535, 65_536, 2**32, 2**62])
def test_packed_numbers(top):
    x = np.array([0, 1, top, 3], np.int64)
    assert A._unpacked(A._packed(x)).tolist() == x.tolist() and A._unpacked(A._packed(x[:0])).tolist() == []
