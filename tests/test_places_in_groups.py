"""Places within groups, of which one holds half of all rows and one has no name, against a plain count."""

import pytest
from pyspark.sql import functions as F

from quire.operators import ranking, sequence


def groups(n):
    """(id, group): half of the rows in one group, a tenth without a name, the others in groups of a few rows."""
    return [(k, "a" if k % 2 else None if k % 10 == 0 else f"g{k % 97}") for k in range(n)]


@pytest.mark.parametrize("hot_rows", [10_000, 100, 1])
def test_places_equal_a_plain_count(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(ranking, "HOT_ROWS", hot_rows)
    rows, seen, wanted = groups(2000), {}, {}
    for k, g in rows:
        seen[g] = wanted[k] = seen.get(g, 0) + 1
    table = spark.createDataFrame(rows, "id long, g string").repartition(7).withColumn("x", F.lit(1))
    found = ranking.with_place_in(table, "g", ["id"])
    assert found.columns == ["id", "g", "x", "place"]
    assert {r.id: r.place for r in found.collect()} == wanted and found.count() == 2000
    names = {r.id: r.file_name for r in sequence.numbered(table.where("g IS NOT NULL"), "g", "id", 120).collect()}
    assert names == {k: f"{120 + wanted[k]:05d} {g}" for k, g in rows if g is not None}
    assert ranking.with_place_in(table.where("id < 0"), "g", ["id"]).count() == 0
