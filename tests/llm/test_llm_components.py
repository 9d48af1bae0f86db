"""Components by stars against a plain search, with hubs below and above their neighbours."""

import random

import pytest

from quire.llm import joins, simhash


def plain(edges):
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return {n: r for n, r in label.items() if n != r}


def graph():
    """A hub above 300 nodes, one below 300, one that both meet, a chain, and links at random."""
    r = random.Random(5)
    above = [(9999, n) for n in range(100, 400)]
    below = [(-7, n) for n in range(500, 800)]
    chain = [(n, n + 1) for n in range(1000, 1030)]
    loose = [(a, b) for a, b in ((r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(120)) if a != b]
    return above, below, chain, loose


@pytest.mark.parametrize("hot_rows", [10_000, 50])
def test_components_equal_a_plain_search(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(joins, "HOT_ROWS", hot_rows)
    above, below, chain, loose = graph()
    for edges in (above, [*above, *below, *chain, *loose], [*above, *below, (9999, 800), (-7, 800)], [*chain, *chain, (1000, 9)]):
        found = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert len(found) == len({x.node for x in found})
        assert {x.node: x.root for x in found} == plain(edges)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_above_its_neighbours_goes_by_broadcast(spark, monkeypatch):
    """Hot keys of the small star are found too: the join that gets them is never left to a plain shuffle."""
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    hot, real = [], simhash.by_counted_key

    def counted(rows, known, on, n):
        hot.append(known.agg({n: "max"}).first()[0])
        return real(rows, known, on, n)

    monkeypatch.setattr(simhash, "by_counted_key", counted)
    simhash.components(spark.createDataFrame(graph()[0], "a long, b long"))
    assert hot[:2] == [300, 300]
