"""Medians by counting, against Spark's own and against sorting."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from seasonstar.operators.selection import exact_median


def medians(frame, **options):
    return {r.g: (r.Values, r.Median) for r in exact_median(frame, ["g"], "v", **options).collect()}


def test_small_groups_ties_and_nulls(spark):
    groups = {
        "one": [4.0],
        "two": [1.0, 2.0],
        "ties": [5.0] * 7 + [1.0, 9.0],
        "middle ties": [1.0, 5.0, 5.0, 9.0],
        "between": [1.0] * 4 + [9.0] * 4,
        None: [3.0, 1.0, 2.0],
        "signs": [-1.5, -0.0, 0.0, 1e-300, -1e300, math.inf],
        "holes": [None, 8.0, None],
        "nothing": [None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    frame = spark.createDataFrame(rows, "g string, v double")
    expected = {}
    for g, values in groups.items():
        known = [v for v in values if v is not None]
        if known:
            expected[g] = (len(known), statistics.median(known))
    for options in ({}, {"sorted_rows": 1, "gaps": 2}):
        assert medians(frame, **options) == expected
    assert medians(frame.limit(0)) == {}
    nan = spark.createDataFrame([("x", math.nan), ("x", 1.0), ("x", 2.0)], "g string, v double")
    assert medians(nan) == {"x": (3, 2.0)} and medians(nan, sorted_rows=1, gaps=2) == {"x": (3, 2.0)}


@pytest.mark.parametrize("extra", [0, 1])
def test_one_large_group_is_narrowed(spark, tmp_path, extra):
    value = F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.exp(10 * F.sin(F.col("id") * 1.0)))
    rows = spark.range(200_000 + extra).select(
        F.when(F.col("id") % 100 == 7, "rare").otherwise("hot").alias("g"), value.alias("v")
    )
    rows.write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    expected = {r.g: (r.n, r.m) for r in frame.groupBy("g").agg(F.count("v").alias("n"), F.median("v").alias("m")).collect()}
    assert medians(frame, sorted_rows=500) == expected
