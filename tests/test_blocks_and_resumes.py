"""Block matrix product against the coordinate form; cadence restarts against a walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.operators import aggregate as A
from runledger.operators import ordered


def _matrix(spark, names, rows, cols, density, seed):
    rnd = random.Random(seed)
    cells = [(r, c, rnd.choice([0, 1, -3, 2**62, 7])) for r in rows for c in cols if rnd.random() < density]
    return spark.createDataFrame(cells, f"{names[0]} long, {names[1]} long, v long").repartition(3)


@pytest.mark.parametrize(("tile", "density"), [(4, 0.5), (16, 0.05), (128, 1.0)])
def test_blocks_equal_coordinates(spark, tile, density):
    a = _matrix(spark, "ik", range(-5, 20), range(30), density, 1)
    b = _matrix(spark, "kj", range(2, 33), [0, 1, 100, 101], density, 2)
    want = sorted((r.i, r.j, int(r.c)) for r in A.matrix_product(a, b).collect())
    assert sorted((r.i, r.j, int(r.c)) for r in A.matrix_product_tiles(a, b, tile).collect()) == want


def test_blocks_move_fewer_cells(spark):
    a, b = _matrix(spark, "ik", range(64), range(64), 1.0, 3), _matrix(spark, "kj", range(64), range(64), 1.0, 4)
    left, right = A._tiles(a, "i", "k", 32), A._tiles(b, "k", "j", 32)
    assert left.count() == 4 and left.select(F.max(F.size("cells"))).first()[0] == 32 * 32
    products = left.join(right, left["tc"] == right["tr"]).count()  # each moves one block of cells at most
    multiplications = a.join(b, "k").count()
    assert products * 32 * 32 * 30 < multiplications
    assert A.matrix_product_tiles(a, b, 32).count() == 64 * 64


def test_sparse_blocks_are_packed(spark):
    # 4,000 cells far apart: nearly each in a tile of its own, but the packs follow the cells
    a = spark.range(4000).selectExpr("id * 7919 % 40000 as i", "id * 104729 % 3000 as k", "id - 2000 as v").repartition(5)
    b = spark.range(9000).selectExpr("id % 3000 as k", "id div 3000 * 50 as j", "id * id as v")
    tiles = A._tiles(a, "i", "k", 16)
    packs = A._packed(tiles, "tc", "tr", 16)
    assert tiles.count() > 3900 and packs.count() <= 3000 // 16 * 6
    spread = packs.selectExpr("aggregate(tiles, 0, (n, t) -> n + size(t.cells)) as n").agg(F.sum("n"), F.max("n")).first()
    assert spread[0] == 4000 and spread[1] < 2 * 16 * 16
    want = sorted((r.i, r.j, int(r.c)) for r in A.matrix_product(a, b).collect())
    assert sorted((r.i, r.j, int(r.c)) for r in A.matrix_product_tiles(a, b, 16).collect()) == want and len(want) > 11000


@pytest.mark.parametrize(("cells", "spread"), [(900, 16), (900, 5000)])
def test_products_of_packs(cells, spread, monkeypatch):
    monkeypatch.setattr(A, "_PAIRS", 50)
    rnd = np.random.default_rng(cells + spread)
    x = (rnd.integers(-spread, spread, cells), rnd.integers(0, 16, cells), rnd.integers(0, 2**64, cells, np.uint64))
    y = (rnd.integers(-spread, spread, cells), rnd.integers(0, 16, cells), rnd.integers(0, 2**64, cells, np.uint64))
    parts = list(A._products(x, y, 16))
    assert (len(parts) > 1) == (spread == 5000)  # full packs as arrays, sparse ones cell by cell in steps
    want = {}
    for i, ki, v in zip(*x):
        for j, kj, w in zip(*y):
            if ki == kj:
                want[i, j] = (want.get((i, j), 0) + int(v) * int(w)) % 2**64
    i, j, c = A._summed(parts)
    assert dict(zip(zip(i, j), c.tolist())) == want and len(i) == len(want)


@pytest.mark.parametrize("hot", [False, True])
def test_cadence_restarts_in_every_attempt(spark, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(ordered, "HOT_ROWS", 5)
    rnd = random.Random(7)
    rows = [(rnd.choice(["hot"] * 4 + ["b"]), i, rnd.choice(["started"] + ["hit"] * 5 + ["miss"] * 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "job string, seq long, kind string").repartition(4)
    begun = F.when(F.col("kind") == "started", 1).otherwise(0).cast("bigint")
    df = ordered.running_sums(df, ["job"], ["seq"], ordered.bucket_of("seq", 30), {"attempt": begun}, hot=hot)
    df = df.withColumn("hit", F.col("kind") == "hit")
    got = A.resumed_snapshots(df, "job", "attempt", ["seq"], ordered.bucket_of("seq", 30), 3, hot=hot)
    want = []
    for job in ("hot", "b"):
        mine = [k for j, _, k in rows if j == job]
        attempt = hits = since = 0
        for pos, kind in enumerate(mine, 1):
            if kind == "started":
                attempt, since = attempt + 1, 0
            if kind == "hit":
                hits, since = hits + 1, since + 1
                if since % 3 == 0:
                    want.append((job, attempt, since // 3, pos, hits, False))
        want.append((job, attempt, since // 3 + 1, len(mine), hits, True))
    assert sorted((r.job, r.attempt, r.epoch, r.cursor, r.found, r.final) for r in got.collect()) == sorted(want)
