"""Similar tags: pairs against all pairs, clusters of long chains, sizes of cells."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import similarity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b):
    longest = max(len(a), len(b))
    return edits(a, b) <= (2 if longest >= 9 else 1 if longest >= 5 else 0)


def edited(r, word):
    letters = list(word)
    for _ in range(r.randrange(1, 3)):
        at, what = r.randrange(len(letters) + 1), r.randrange(3)
        if what == 0:
            letters.insert(at, r.choice("abc"))
        elif at < len(letters) and len(letters) > 1:
            letters[at : at + 1] = [r.choice("abc")] if what == 1 else []
    return "".join(letters)


def test_pairs_equal_all_pairs(spark):
    """Tags of 1 to 14 letters out of three, so that pieces repeat and shift within a tag, with edits anywhere."""
    r = random.Random(5)
    words = {"".join(r.choice("abc") for _ in range(n)) for n in range(1, 15) for _ in range(20)}
    words |= {edited(r, w) for w in sorted(words) for _ in range(2)}
    words = sorted(words)
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if close(a, b)}
    found = similarity.similar_pairs(spark.createDataFrame([(w,) for w in words], "norm string")).collect()
    assert len(want) > 500 and len(found) == len(want) and {(p.a, p.b) for p in found} == want


@pytest.mark.parametrize("shuffled", [False, True])
def test_a_chain_of_500_ends_in_a_few_rounds(spark, shuffled):
    names = [f"t{k:03d}" for k in range(500)]
    if shuffled:
        random.Random(3).shuffle(names)
    pairs = spark.createDataFrame([*zip(names, names[1:]), ("x", "y"), ("z", "z")], "a string, b string")
    roots, rounds = similarity.components(pairs)
    found = {r.norm: r.root for r in roots.collect()}
    assert rounds < 12 and roots.count() == 502
    assert found == {**dict.fromkeys(names, "t000"), "x": "x", "y": "x"}


def test_no_pairs(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert similarity.components(none)[0].count() == 0
    assert similarity.clusters(spark.createDataFrame([], "tag string, n long")).count() == 0
    assert similarity.clusters(spark.createDataFrame([(None, 2), ("", 1), ("ab", 3)], "tag string, n long")).count() == 0


def test_a_million_short_tags_make_small_cells(spark):
    letter = lambda k: F.char((97 + F.pmod(F.floor(F.col("at") / 26**k), F.lit(26))).cast("int"))
    tags = spark.range(1_000_000).select((F.col("id") * 7_654_321 % 26**5).alias("at")).select(F.concat(*(letter(k) for k in range(5))).alias("norm")).distinct()
    for side in similarity.pieces(tags):
        assert side.groupBy("piece").count().agg(F.max("count")).first()[0] < 10_000


def test_pieces_are_made_of_tags_and_not_of_the_rows_behind_them(spark):
    """The plan that cuts up tags starts from written tags: a filter on pieces cannot reach the rows that they were made of."""
    rows = spark.range(40_000, numPartitions=2).select(F.concat(F.lit("Large ring"), F.col("id") % 3).alias("tag"))
    norms = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select(similarity.normalize(F.col("tag")).alias("norm")).distinct()
    pairs = similarity.similar_pairs(norms)
    assert {(p.a, p.b) for p in pairs.collect()} == {("large ring0", "large ring1"), ("large ring0", "large ring2"), ("large ring1", "large ring2")}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Range" not in plan
