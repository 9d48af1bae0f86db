import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# Null and empty texts, ties, repeated rows, a null id, one long text, and columns whose names clash with inner ones.
ODD = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (1, "one two three four five six seven eight nine ten eleven twelve", "a"),
    (2, None, None),
    (3, "", "a"),
    (4, " \t\n ", "b"),
    (5, "line one here\nline two here\nline three here\nend of five", "b"),
    (6, "line one here\nline two here\nline three here\nend of six", "b"),
    (7, "short", "c"),
    (None, "the null id has some words of its own to count here and there", "c"),
    (8, "the quick brown fox jumps over the lazy dog and runs away. " * 3000, "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    extra = {"lang": "'en'", "n_chars": "cast(length(text) as long)", "row": "'row'", "k": "1", "h": "2", "bucket": "3", "seat": "4", "fp": "5", "tokens": "6", "block": "7", "start": "8", "f": "9", "version": "10"}
    return df.selectExpr("*", *(f"{e} AS {n}" for n, e in extra.items()))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
