"""Fuzz the state-file audit: any bytes give a verdict, any bit flip is caught."""

import random

from runledger.sources import blobs as B

from test_blobs import jobc

VERDICTS = {"ok", "short", "crc", "magic", "version", "recent_cap", "recent_size", "trailing"}


def test_random_bytes_always_get_a_verdict(spark):
    rnd = random.Random(5)
    blobs = [(i, bytearray(rnd.getrandbits(8) for _ in range(rnd.choice([0, 1, 3, 40, 41, 44, 73, 200])))) for i in range(300)]
    df = spark.createDataFrame(blobs, "name long, content binary")
    for kind in ("jobc", "mmul", "wcnt"):
        got = {r.verdict for r in B.audit(df, kind=kind).collect()}
        assert got <= VERDICTS and "ok" not in got


def test_every_single_bit_flip_is_detected(spark):
    ok = jobc()
    flips = []
    for i in range(len(ok) * 8):
        b = bytearray(ok)
        b[i // 8] ^= 1 << (i % 8)
        flips.append((i, b))
    df = spark.createDataFrame(flips, "name long, content binary")
    got = {r.verdict for r in B.audit(df).collect()}
    assert "ok" not in got and got <= VERDICTS


def test_round_trip_random_states(spark):
    rnd = random.Random(9)
    states = []
    for i in range(100):
        rec = tuple(rnd.getrandbits(64) for _ in range(rnd.randint(0, 32)))
        lim, nxt, fnd = (rnd.getrandbits(64) for _ in range(3))
        states.append((i, lim, nxt, fnd, rec, bytearray(jobc(lim, nxt, fnd, 1, rec))))
    df = spark.createDataFrame([(i, b) for i, *_, b in states], "name long, content binary")
    got = {r.name: r for r in B.audit(df).collect()}
    for i, lim, nxt, fnd, rec, _ in states:
        r = got[i]
        assert r.verdict == "ok" and (int(r.limit), int(r.next), int(r.found), r.recent_count) == (lim, nxt, fnd, len(rec))
