import corpus_pipeline as P
from runledger.llm import queries
from runledger.llm.line_frequency import LineLimits

from . import test_op1_line_frequency as op1
from . import test_op2_minhash_bayes as op2
from . import test_op9_decontaminate as op9

SF_SMALL = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    texts, hosts, ids = [r["text"] for r in rows], [r["source"] for r in rows], [r["doc_id"] for r in rows]
    verdicts, often, normal = op1.brute(texts, hosts, LineLimits())
    left = [
        (i, "\n".join(x for x in t.split("\n") if (s, normal(x)) not in often))
        for i, t, s, v in zip(ids, texts, hosts, verdicts, strict=True)
        if v[7]
    ]
    left = [x for x, w in zip(left, op2.brute([t for _, t in left]), strict=True) if w[2]]
    left = [x for x, w in zip(left, op9.brute([t for _, t in left], items), strict=True) if not w[4]]
    got = {r["doc_id"]: r for r in P.run(spark, SF_SMALL).collect()}
    assert sorted(got) == [i for i, _ in left]
    from runledger.llm.secret_crf import base_spans

    changed = 0
    for i, t in left:
        if not base_spans(t) and got[i]["decoded"] == t:
            continue
        changed += 1
        assert "[SECRET]" in got[i]["decoded"]
        assert not base_spans(got[i]["decoded"].replace("[SECRET]", "\n"))
    assert changed < len(left) / 4


def test_stages():
    assert [f.__module__ for _, f in P.STAGES] == ["corpus_pipeline"] * 5
    assert P.ORACLE_SQL is None
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]
