import random

import corpus_pipeline as P

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 9))) for _ in range(n))


def tables(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_nulls_repeats_long_texts_and_clashing_columns(spark, documents, tmp_path):
    item = prose(100, 20)
    secret = prose(7) + " password = hunter2abcdef " + prose(77)
    rows = [
        (1, prose(1), "p"),
        (2, prose(1).upper(), "p"),  # a copy of 1
        (3, prose(3), None),
        (None, prose(4), None),  # stays: nobody has its words
        (None, prose(1), "p"),  # a copy of 1
        (4, prose(5, 60) + " " + item, "q"),  # contaminated
        (5, prose(6), "q"),  # an id with two texts: one of them stays
        (5, prose(8), "q"),
        (6, prose(9), "q"),  # a repeated row: one of them stays
        (6, prose(9), "q"),
        (7, secret, "q"),
        (8, prose(10, 60_000), "q"),
        (9, None, "q"),  # without 50 words: rejected
        (10, "", None),
        (11, " \n\t ", "q"),
    ]
    docs = documents([t for _, t, _ in rows], ids=[i for i, _, _ in rows], hosts=[s for _, _, s in rows])
    folder = tables(spark, tmp_path / "some", docs, [("a", item), (None, prose(101, 30)), ("b", None), ("c", "")])
    got = P.run(spark, folder).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3, 5, 6, 7, 8]
    decoded = {r["doc_id"]: r["decoded"] for r in got}
    for i, seeds in {1: [1], 3: [3], None: [4], 5: [6, 8], 6: [9]}.items():
        assert decoded[i] in [prose(s) for s in seeds]
    assert decoded[8] == prose(10, 60_000)
    assert "hunter2abcdef" not in decoded[7] and "[SECRET]" in decoded[7]
    assert decoded[7].startswith(prose(7)) and decoded[7].endswith(prose(77))


def test_empty_tables(spark, documents, tmp_path):
    none = documents(["x"]).limit(0)
    assert P.run(spark, tables(spark, tmp_path / "both", none, [])).count() == 0
    some = documents([prose(1), prose(2)])
    out = P.run(spark, tables(spark, tmp_path / "benchmark", some, []))
    assert sorted(r["decoded"] for r in out.collect()) == sorted([prose(1), prose(2)])
