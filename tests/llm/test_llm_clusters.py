"""Exponion search equals plain k-means, with ties, few vectors and odd ones."""

import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import exponion

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters, rounds):
    """All distances, in whole numbers."""
    kept = []
    for key, v, _ in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [math.floor(1024 * float(np.float32(x))) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    cs = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cs))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                cs[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(key, nearest(v)) for key, v in kept]
    held = {k: sum(d for _, (d, c) in found if c == k) for k in range(len(cs))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((key is None, key or 0), c, d, held[c], sum(held.values()), digest[c]) for key, (d, c) in found)


def ours(df, **how):
    return sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in exponion.cluster(df, **how).collect())


def grouped(rng, n, groups, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, spread) for x in middles[rng.randrange(groups)]], 0) for i in range(n)]


@pytest.mark.parametrize("spread, groups", [(0.02, 11), (0.5, 3)])
def test_equals_plain_search(spark, spread, groups):
    rows = grouped(random.Random(groups), 400, groups, spread)
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows, 8, 10)


def test_ties_and_copies(spark):
    """Vectors on a small grid: most are as near to several centroids, and many are equal."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(2)) if j < 3 else 0.0 for j in range(64)], 0) for i in range(120)]
    assert ours(spark.createDataFrame(rows + rows[:40], SCHEMA).repartition(4)) == plain(rows + rows[:40], 8, 10)


def test_odd_vectors(spark):
    v = [0.5] * 64
    rows = [(1, v, 1), (1, v, 1), (1, [-0.3] * 64, 1), (2, None, None), (3, [], 1), (4, v[:63], 1), (5, v[:63] + [None], 1), (6, v[:63] + [math.nan], 1), (7, v[:63] + [math.inf], 1), (8, v + [1.0], 1), (None, [0.25] * 64, 1), (9, [-0.0001] * 64, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS own", "4 AS change", "5 AS cluster")
    assert ours(df) == plain(rows, 8, 10)
    assert ours(df.limit(0)) == []
    assert ours(df.where("vec_id = 3")) == []
    assert ours(df.where("vec_id = 9")) == plain([rows[-1]], 8, 10)
    with pytest.raises(Exception, match="too large"):
        ours(spark.createDataFrame([(1, [1e9] * 64, 1)], SCHEMA))


def test_bounds_hold_and_save_distances():
    """After every round the bounds enclose the true distances, and clear groups cost far fewer distances than all pairs."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-800, 800, (16, 64))
    vectors = middles[rng.integers(0, 16, 3000)] + rng.integers(-40, 40, (3000, 64))
    at = vectors[:16].copy()
    own, first, second = exponion.scan(vectors, np.arange(16), at)
    upper, lower, spent = np.sqrt(first) * (1 + 1e-9), np.sqrt(second) * (1 - 1e-9), 0
    for _ in range(6):
        sums = np.zeros((16, 65), np.int64)
        np.add.at(sums, own, np.hstack([np.ones((3000, 1), np.int64), vectors]))
        cs = exponion._moved(at, sums)
        own, upper, lower, cost = exponion.assign(vectors, own, upper, lower, cs)
        true = np.array([exponion.squared(vectors, c) for c in cs.at])
        assert (own == true.argmin(axis=0)).all()
        near = np.sort(np.sqrt(true), axis=0)
        assert (upper >= near[0]).all() and (lower <= near[1] + 1e-6).all()
        at, spent = cs.at, spent + cost
    assert spent < 6 * 3000 * 16 / 4
