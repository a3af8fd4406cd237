import pytest

NOISE = ["rid", "h", "e", "w", "words", "size", "items", "n", "sig", "node", "label", "block", "row_key", "removed", "copies", "pattern", "start", "key"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts, with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def make(texts, ids=None, hosts=None, parts=3):
        ids = list(range(len(texts))) if ids is None else ids
        hosts = ["a"] * len(texts) if hosts is None else hosts
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, hosts, strict=True)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return df.repartition(parts).withColumns({c: F.lit(c) for c in NOISE})

    return make
