"""Queries that SQL can express, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from compare import duck, duck_rows, spark_rows  # noqa: E402

from seasonstar.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected = duck_rows(duck(SF_DIR), ORACLES[name])
    assert columns == expected_columns and rows == expected
