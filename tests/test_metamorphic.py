"""Same answers under different partitioning, row order and restart points."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runledger.operators import aggregate as A
from runledger.sources.tables import table
from runledger.streaming import core as C
from runledger.streaming import ops as S

from conftest import SF_SMALL

Q = entry.queries()


@pytest.mark.parametrize("name", ["replay_state", "transition_pairs", "cadence_snapshots", "lease_overlap", "run_summary", "reconcile"])
def test_shuffle_partitions_do_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = sorted(map(tuple, Q[name](spark, SF_SMALL).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        b = sorted(map(tuple, Q[name](spark, SF_SMALL).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b


@pytest.mark.parametrize("seed", [1, 2])
def test_resume_at_random_points_equals_batch(spark, seed):
    """Kill/restart property: the stream stops at random document ids and
    restarts on the same checkpoint; the final table equals a fresh run."""
    rnd = random.Random(seed)
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    cuts = sorted(rnd.sample(range(1, 199), 2))
    src, out, ck = C.paths(spark, f"t-resume-{seed}")
    bounds = [-1] + cuts + [10**9]
    for lo, hi in zip(bounds, bounds[1:]):
        C.stage_chunks(docs.filter((F.col("doc_id") > lo) & (F.col("doc_id") <= hi)), src, "doc_id", 1)
        q = S.stream_word_count(spark.readStream.schema(docs.schema).parquet(src))
        C.run_available_now(q, out, ck, output_mode="update", foreach_batch=C.upsert_batches(out, ["word"]))
    got = A.count_fingerprint(C.read_latest(spark, out, ["word"])).first()
    want = A.count_fingerprint(A.word_count(A.tokenize(docs))).first()
    assert got == want
