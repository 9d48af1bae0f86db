"""Queries with SQL equal it on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from test_oracles import SF, same_rows  # noqa: E402

from quire.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name]))
