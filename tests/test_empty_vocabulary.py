"""With an empty vocabulary the first proposals stay, as ControlledVocabulary.enforce has it."""

from quire.operators import library


def test_first_six_proposals_of_each(spark):
    rows = [(i, k, f" Tag{k}") for i in (1, 2) for k in range(4 * i)]
    proposals = spark.createDataFrame(rows, "id long, pos int, tag string")
    got = library.controlled(proposals, spark.createDataFrame([], "tag string")).collect()
    assert sorted(map(tuple, got)) == [(i, f" Tag{k}", k + 1) for i in (1, 2) for k in range(min(6, 4 * i))]
