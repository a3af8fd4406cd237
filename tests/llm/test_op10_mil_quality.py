import numpy as np

from runledger.llm import mil_quality as Q

SF_CHECK = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    scored = Q.digest(Q.score(docs, Q.train(docs, labels)))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert len(rows) > 40 and np.mean(good) > 0.95 and np.mean(bad) < 0.2
    assert scored.count() == docs.count()


def test_gradient_steps_follow_the_loss():
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(200):
        x = rng.normal(0, 1, (rng.integers(1, 6), Q.N_PASSAGE))
        if i % 2:
            x[rng.integers(len(x)), :3] += 4  # one telling passage decides the bag
        bags.append(x)
        labels.append(float(i % 2))
    net = Q.GatedAttention().fit(bags, np.array(labels), steps=150)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    y = net.scores(np.concatenate(bags), starts)
    assert ((y > 0.5) == (np.array(labels) > 0)).mean() > 0.95


def test_passages_cover_the_whole_text():
    x, starts = Q.passages(["", " \n", "w " * 1000, "word " * 470 + "tail " * 10, "word " * 470 + "#### " * 10])
    sizes = np.diff(np.append(starts, len(x)))
    assert sizes.tolist() == [1, 1, -(-1000 // Q.PASSAGE), 10, 10]
    a, b = x[starts[3] : starts[4]], x[starts[4] :]
    assert np.allclose(a[:9], b[:9]) and not np.allclose(a[9], b[9])
    one, _ = Q.passages(["Some Words, HERE 12"])
    assert one[0, Q.N_CLASSES + 2] == 0.75 and one[0, Q.N_CLASSES + 5] == 1


def test_missing_labels_and_edge_rows(spark, documents):
    docs = documents(["good words here", None, "", "x" * 40_000], ids=[1, 2, 2, None])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = Q.digest(Q.score(docs, Q.train(docs, none))).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 and r["predicted"] == 1 for r in rows)
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (99, 0)], "doc_id bigint, quality int")
    assert all(r["score"] == 1.0 for r in Q.score(docs, Q.train(docs, one)).collect())
    assert Q.score(docs.limit(0), Q.GatedAttention()).count() == 0


def test_clashing_columns_and_no_leak(spark, documents):
    docs = documents(["some words", "other words"])
    out = Q.score(docs, Q.GatedAttention())
    assert out.columns == [*docs.columns, "score"]
    same = Q.score(documents(["some words", "some words"], ids=[3, 9], hosts=["p", "q"]), Q.GatedAttention()).collect()
    assert same[0]["score"] == same[1]["score"]


def slow_score(net, passages):
    """One bag, passage by passage and number by number."""
    import math

    p, encoded, energies = net.p, [], []
    for row in passages:
        x = [(v - m) / s for v, m, s in zip(row, net.mean, net.std, strict=True)]
        dense = lambda values, weights, j: sum(v * weights[i][j] for i, v in enumerate(values))
        h = [math.tanh(dense(x, p["W"], j) + p["b"][j]) for j in range(len(p["b"]))]
        gate = [math.tanh(dense(h, p["V"], j)) / (1 + math.exp(-dense(h, p["U"], j))) for j in range(len(p["w"]))]
        encoded.append(h)
        energies.append(sum(g * w for g, w in zip(gate, p["w"], strict=True)))
    weights = [math.exp(e - max(energies)) for e in energies]
    z = [sum(w * h[j] for w, h in zip(weights, encoded, strict=True)) / sum(weights) for j in range(len(p["c"]))]
    return 1 / (1 + math.exp(-(sum(a * c for a, c in zip(z, p["c"], strict=True)) + p["c0"][0])))


def test_scores_equal_a_slow_forward_pass(spark, documents):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text")
    net = Q.train(docs, spark.read.parquet(f"{SF_CHECK}/labels.parquet"))
    assert net.constant is None
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()][::40] + [None, "", "one", "w " * 3000]
    got = {r["doc_id"]: r["score"] for r in Q.score(documents(texts), net).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - slow_score(net, Q.passages([t or ""])[0])) < 1e-9
