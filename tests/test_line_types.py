from runledger.functions import json_type
from runledger.plans import fixtures as fx
from runledger.plans.catalog import load_all

from conftest import SF_SMALL


def test_type_of_whole_objects_only(spark):
    want = {
        '{"type":"checkpoint","epoch":"x"}': "checkpoint",
        '{"type":"checkpoint","found":1.5}': "checkpoint",
        '{"epoch":1,"type":"new"}': "new",
        '{"type":"started","type":"new"}': "new",
        '{"type":"started","type":7}': None,
        '{"type":"started"} done': None,
        '{"type":"started"},{"type":"failed"}': None,
        "{'type':'started'}": None,
        '{"type":"sta': None,
        '{"type":7}': None,
        '{"type":null}': None,
        '{"epoch":1}': None,
        '["type"]': None,
        "# junk 0": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in want], "value string")
    assert {r["value"]: r["type"] for r in df.select("value", json_type("value").alias("type")).collect()} == want


def test_every_line_has_a_row(spark):
    n = fx.worker_lines(spark, SF_SMALL).count()
    rows = load_all()["line_types_all"].fn(spark, SF_SMALL).collect()
    junk = [r["type"] for r in rows if r["seq"] % 10 == 0]
    assert len(rows) == n and junk.count(None) > 0 and set(junk) == {None, "checkpoint"}
