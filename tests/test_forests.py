"""Forests by intervals equal walks of small random ones, with cycles, and stay linear for a long chain."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import hierarchy


def ancestors(parents, v):
    """v, its parent and so on; a cycle is walked once."""
    seen = []
    while v in parents and v not in seen:
        seen.append(v)
        v = parents[v]
    return seen


def forest(seed):
    rng = random.Random(seed)
    n = rng.choice([1, 2, 5, 30, 60])
    parents = {i: rng.choice([None, 999, rng.randrange(n), max(0, i - 1), i // 2]) for i in range(n)}
    items = [(rng.randrange(25), rng.randrange(n + 2)) for _ in range(3 * n)]
    assigned = [(rng.randrange(n), rng.randrange(6)) for _ in range(n // 2)]
    return parents, sorted(set(items)), list(dict(assigned).items())


@pytest.fixture(scope="module")
def forests():
    """Eight random forests side by side, of other ids."""
    parents, items, assigned = {}, [], []
    for seed in range(8):
        p, m, t = forest(seed)
        move = lambda x: x if x is None or x == 999 else x + 1000 * (seed + 1)  # noqa: B023,E731
        parents |= {move(v): move(u) for v, u in p.items()}
        items += [(i, move(f)) for i, f in m]
        assigned += [(move(f), x) for f, x in t]
    return parents, items, dict(assigned)


@pytest.mark.parametrize("wide, broadcast", [(16, 100_000), (0, 100_000), (0, 0)])
def test_random_forests(spark, monkeypatch, forests, wide, broadcast):
    monkeypatch.setattr(hierarchy, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(hierarchy, "WIDE", wide)
    parents, items, by = forests
    folders = spark.createDataFrame(list(parents.items()), "folder_id long, parent_id long")
    up = {v: ancestors(parents, v) for v in parents}
    want = {v: len({i for i, f in items if f in up and v in up[f]}) for v in parents}
    assert {r.folder_id: r.n_items for r in hierarchy.subtree_counts(folders, spark.createDataFrame(items, "item_id long, folder_id long")).collect()} == want
    if broadcast == 0:
        return
    live = {0, 2, 4}
    got = {r.folder_id: (r.template_id, r.n_dangling) for r in hierarchy.nearest_assignment(folders, spark.createDataFrame(list(by.items()), "folder_id long, template_id long"), spark.createDataFrame([(t,) for t in live], "template_id long")).collect()}
    for v in parents:
        found = next((k for k, a in enumerate(up[v]) if by.get(a) in live), None)
        nearer = up[v] if found is None else up[v][:found]
        assert got[v] == (None if found is None else by[up[v][found]], sum(a in by for a in nearer)), v
    under = {(a, v) for v in up for a in up[v]}
    moves = spark.createDataFrame([(a, b) for a in list(parents)[::5] for b in [*list(parents)[::3], 5]], "folder_id long, new_parent long")
    assert all(r.cycle == ((r.folder_id, r.new_parent) in under) for r in hierarchy.would_cycle(folders, moves).collect())
    root = max(parents, key=lambda v: sum(a == v for a, _ in under))
    assert sorted(r.folder_id for r in hierarchy.subtree(folders, root).collect()) == sorted(v for a, v in under if a == root)


def test_a_long_chain_is_linear(spark):
    """600 folders in one chain, and one more below each hundredth: tables have a row per folder, not one for each pair."""
    n = 600
    chain = spark.range(n).select(F.col("id").alias("folder_id"), (F.col("id") - 1).alias("parent_id"))
    folders = chain.unionByName(spark.range(0, n, 100).select((F.col("id") + n).alias("folder_id"), F.col("id").alias("parent_id")))
    assert hierarchy.closure(folders, hierarchy.WIDE * folders.count()) is None
    rows = {r.folder_id: r.last - r.first + 1 for r in hierarchy.intervals(folders).collect()}
    assert len(rows) == n + 6
    assert {k: rows[k] for k in (0, 1, 100, n - 1, n)} == {0: n + 6, 1: n + 4, 100: n - 100 + 5, n - 1: 1, n: 1}


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Counts over a flat forest use as many tasks as their pairs need, so that none grows with the input."""
    monkeypatch.setattr(hierarchy, "TASK_ROWS", 1_000)
    folders = spark.range(40).selectExpr("id AS folder_id", "CASE WHEN id = 0 THEN -1 ELSE 0 END AS parent_id")
    items = spark.range(4_000).selectExpr("id AS item_id", "1 + id % 39 AS folder_id").unionByName(spark.range(100).selectExpr("id AS item_id", "0L AS folder_id"))
    found = hierarchy.subtree_counts(folders, items)
    assert "hashpartitioning(top" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    counts = {r.folder_id: r.n_items for r in found.collect()}
    assert counts == {0: 4_000} | {k: len(range(k - 1, 4_000, 39)) for k in range(1, 40)}
