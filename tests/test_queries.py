"""Every registered query against its DuckDB statement."""

import os

import pytest
from compare import duck, duck_rows, spark_rows

import __spark_entry__ as entry_module
from seasonstar.plans.demo import Demo

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry_module.QUERIES
ORACLES = entry_module.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_columns, expected = duck_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    assert entry_module.entry(spark).columns[-1] == "PeakMonths"


def test_cleaned_text_equals_typed_sources(spark):
    demo = Demo(spark, SF_DIR)
    cleaned = {
        name: QUERIES[f"clean_{name}"](spark, SF_DIR) for name in ("spend", "nights", "visitors")
    }
    for name, frame in cleaned.items():
        typed = getattr(demo, name)
        frame = frame.select(*typed.columns)
        assert frame.exceptAll(typed).isEmpty() and typed.exceptAll(frame).isEmpty(), name
