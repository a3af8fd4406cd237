"""Plan shape: pruning, pushdown, partial aggregation, bounded windows."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry

Q = entry.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_scan_prunes_and_pushes(spark):
    p = _plan(Q["orphans"](spark, SF_SMALL))
    assert "l_extendedprice" not in p and "l_shipdate" not in p and "l_tax" not in p and "l_returnflag" not in p
    p = _plan(Q["tail_ring"](spark, SF_SMALL))
    assert "EqualTo(l_returnflag,R)" in p


@pytest.mark.parametrize(
    "name,most",
    [("transition_pairs", 3), ("attempts", 3), ("progress_curve", 3), ("epoch_monotonic", 3), ("cadence_snapshots", 3),
     ("lease_holds", 4), ("lease_overlap", 6), ("start_by_holder", 8), ("failover_gap", 6)],
)
def test_ordered_plans_scan_once_and_exchange_little(spark, name, most):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        p = _final(Q[name](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert p.count("FileScan parquet") <= (2 if name == "start_by_holder" else 1)
    assert p.count("Exchange hashpartitioning") <= most, p


def test_word_count_combines_map_side(spark):
    p = _plan(Q["word_count"](spark, SF_SMALL))
    assert "partial_count" in p


def test_top_k_per_key_is_partial(spark):
    for name in ("recent_events", "tail_ring", "job_detail"):
        p = _plan(Q[name](spark, SF_SMALL))
        assert "WindowGroupLimit" in p and "Partial" in p, name


def test_no_unpartitioned_window_on_big_inputs(spark):
    # Windows over whole keys are bucketed; the only unpartitioned window is
    # the page window over at most limit + 1 rows after TakeOrderedAndProject.
    for name in ("transition_pairs", "attempts", "epoch_monotonic", "cadence_snapshots", "progress_curve",
                 "lease_holds", "failover_gap", "start_by_holder", "lease_overlap"):
        p = _plan(Q[name](spark, SF_SMALL))
        assert "SinglePartition" not in p, name


def test_replay_is_hash_aggregated(spark):
    p = _plan(Q["replay_state"](spark, SF_SMALL))
    assert "ObjectHashAggregate" in p and "Window" not in p
