import hashlib
import random
import re

import pytest

from runledger.llm.decontaminate import contamination, digest, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[a : a + 13]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    hit.update(range(a, a + size))
                    found |= windows[tuple(w[a : a + size])]
        names = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fixture():
    rng = random.Random(6)
    vocab = ["the", "É", "é", "ab", "Zz"] + [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, some(rng.choice([1, 2, 4, 5, 12, 13, 14, 30]))) for i in range(25)]
    items += [(90, items[7][1]), (91, None), (92, "?! ,"), (None, some(15)), (10, items[8][1])]
    texts = []
    for _ in range(80):
        parts = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1] or ""
            parts += [w if rng.random() < 0.5 else w.upper().replace(" ", "-"), some(rng.randint(0, 20))]
        texts.append(", ".join(parts))
    return texts + [None, "", "--", some(3000), " ".join(f"u{i}" for i in range(400)) + " the", items[4][1]], items


@pytest.mark.parametrize("chunk", [40_000, 60])
def test_result_equals_brute_force(spark, documents, chunk):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in digest(contamination(documents(texts), bench, chunk=chunk)).collect()}
    want = brute(texts, items)
    assert any(w[4] for w in want) and any(w[1] and not w[4] for w in want)
    assert [got[i] for i in range(len(texts))] == want


def test_contaminated_documents_go(spark, documents):
    texts, items = fixture()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents(texts)
    out = drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i, w in enumerate(brute(texts, items)) if not w[4]]


def test_empty_tables_and_repeated_rows(spark, documents):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    docs = documents(["x a b c", "x a b c", "y"], ids=[1, 1, None])
    assert sorted(r["n_hit"] for r in contamination(docs, bench).collect()) == [0, 3, 3]
    assert [r["n_hit"] for r in contamination(docs, bench.limit(0)).collect()] == [0, 0, 0]
    assert contamination(docs.limit(0), bench).count() == 0
    odd = documents(["a b c", "clean words", None, "a b c"], ids=[None, None, None, 7])
    assert sorted(str(r["text"]) for r in drop_contaminated(odd, bench).collect()) == ["None", "clean words"]


def test_no_python_on_the_main_path(spark, documents):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    plan = contamination(documents(["x a b c"]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_plan_does_not_grow_with_the_benchmark(spark, documents):
    def lines(n):
        bench = spark.range(n).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(1, 20), x -> 'w' || (id * 31 + x))) as text")
        plan = contamination(documents(["x a b c"]), bench, chunk=10)._jdf.queryExecution().optimizedPlan()
        return plan.treeString().count("\n"), plan.treeString().count("Join")

    assert lines(3) == lines(3000)


def test_a_full_bitmap_and_a_window_of_many_items(spark, documents, monkeypatch):
    from runledger.llm import decontaminate as D

    monkeypatch.setattr(D, "BITS", (15, 15))  # 2^15 bits for more hashes than that: most shingles pass, the join decides
    shared = " ".join(f"s{i}" for i in range(13))
    items = [(i, shared) for i in range(300)] + [(1000 + i, " ".join(f"v{i * 40 + k}" for k in range(40))) for i in range(1200)]
    texts = [shared, "a " + shared + " b " + shared, items[700][1] + " and", "nothing of it", ""] + [
        " ".join(f"u{k * i}" for k in range(200)) for i in range(20)
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(texts, items)
    assert want[0][2] == 300
    for chunk in (100, 1_000_000):
        got = {r["doc_id"]: tuple(r)[1:] for r in digest(contamination(documents(texts), bench, chunk=chunk)).collect()}
        assert [got[i] for i in range(len(texts))] == want
