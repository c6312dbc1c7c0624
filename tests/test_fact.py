"""Dimensions, fact build and quality reports on small fixtures."""

import datetime as dt
from math import fsum
from random import Random

import pytest
from pyspark.sql import functions as F

from seasonstar.operators import dims, quality
from seasonstar.operators.fact import build_spend_detail, conform_fact, conform_fact_join_form

SPEND = (
    "RTO_Code int, Month date, Product string, Visitor_type string, Origin string, "
    "Annual_Spend_Million double, Monthly_Spend_Million double"
)
NIGHTS = (
    "RTO_Code int, Month date, Property string, Visitor_type string, Total_stay_nights bigint"
)
VISITORS = (
    "RTO_Code int, Destination string, Visitor_type string, Month date, Visitor_count bigint"
)
MAPPING = (
    "RTO_Code int, RTO2025_V1_00_NAME string, RTO2025_V1_00_NAME_ASCII string, "
    "RTO_Label_2025 string, RTO_Label_2025_ASCII string"
)


def month(year, number):
    return dt.date(year, number, 1)


def areas(spark, codes):
    rows = [(code, f"Area {code:02d}", f"Area {code:02d}", None, None) for code in codes]
    return dims.location_dim(spark.createDataFrame(rows, MAPPING))


@pytest.fixture(scope="module")
def sources(spark):
    jan, feb, apr = month(2024, 1), month(2024, 2), month(2024, 4)
    spend = [
        (1, jan, "a", "Domestic", "x", 1.0, 0.1),
        (1, jan, "b", "Domestic", "x", 1.0, 0.2),
        (1, feb, "a", "International", "x", 1.0, None),  # only NULLs in this cell
        (77, jan, "a", "Domestic", "x", 1.0, 5.0),  # area not in the dimension
    ]
    nights = [
        (1, jan, "hotel", "Domestic", 3),
        (1, jan, "motel", "Domestic", 4),
        (30, apr, "hotel", "Domestic", 5),
        (30, None, "hotel", "Domestic", 6),  # no month
    ]
    visitors = [(1, "A", "International", jan, 9), (30, "B", "Other", jan, 1)]
    return (
        spark.createDataFrame(spend, SPEND),
        spark.createDataFrame(nights, NIGHTS),
        spark.createDataFrame(visitors, VISITORS),
    )


def test_fact_keeps_missing_measures_null(spark, sources):
    locations, types = areas(spark, [1, 30, 99]), dims.enum_dim(spark)
    fact = conform_fact(*sources, locations, types)
    rows = {tuple(row)[1:4]: tuple(row)[4:] for row in fact.collect()}
    assert rows == {
        (202401, 1, 1): (pytest.approx(0.3), 7, None),
        (202402, 1, 2): (None, None, None),
        (202404, 30, 1): (None, 5, None),
        (202401, 1, 2): (None, None, 9),
    }
    other = conform_fact_join_form(*sources, locations, types)
    assert fact.exceptAll(other).isEmpty() and other.exceptAll(fact).isEmpty()
    months = dims.month_dim(*sources)
    keyed = conform_fact(*sources, locations, types, months)
    assert fact.exceptAll(keyed).isEmpty() and keyed.exceptAll(fact).isEmpty()
    assert fact.select("FactID").distinct().count() == 4


def test_fact_of_empty_sources(spark, sources):
    empty = [frame.limit(0) for frame in sources]
    assert conform_fact(*empty, areas(spark, [1]), dims.enum_dim(spark)).count() == 0
    assert dims.month_dim(*empty).count() == 0


def test_fact_build_shuffles_once(spark, sources):
    old = {
        key: spark.conf.get(key)
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fact = conform_fact(*sources, areas(spark, [1, 30]), dims.enum_dim(spark))
        plan = fact._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    cells = [line for line in plan.split("\n") if "hashpartitioning(RTO_Code" in line]
    assert len([line for line in cells if "Month" in line]) == 1
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan


def test_partitioning_does_not_change_sums(spark):
    spend = spark.range(20_000).select(
        F.lit(1).alias("RTO_Code"),
        F.lit(month(2024, 1)).alias("Month"),
        F.lit("a").alias("Product"),
        F.lit("Domestic").alias("Visitor_type"),
        F.lit("x").alias("Origin"),
        F.lit(0.0).alias("Annual_Spend_Million"),
        (F.rand(1) * 1e5).alias("Monthly_Spend_Million"),
    ).cache()
    nights = spark.createDataFrame([], NIGHTS)
    visitors = spark.createDataFrame([], VISITORS)
    locations, types = areas(spark, [1]), dims.enum_dim(spark)
    sums = {
        conform_fact(spend.repartition(n), nights, visitors, locations, types).first().SpendMillion
        for n in (1, 3, 7, 16)
    }
    spend.unpersist()
    assert len(sums) == 1


def test_month_dim_is_continuous(spark, sources):
    rows = dims.month_dim(*sources).orderBy("DateKey").collect()
    assert [row.DateKey for row in rows] == [202401, 202402, 202403, 202404]
    assert tuple(rows[2])[1:] == (month(2024, 3), 3, "March", "Q1", 2024, "Autumn")
    full = spark.createDataFrame([(month(2023, 11),), (month(2024, 12),)], "Month date")
    seasons = {row.MonthNumber: row.Season for row in dims.month_dim(full).collect()}
    assert [seasons[m] for m in range(1, 13)] == (
        ["Summer"] * 2 + ["Autumn"] * 3 + ["Winter"] * 3 + ["Spring"] * 3 + ["Summer"]
    )
    north = {r.MonthNumber: r.Season for r in dims.month_dim(full, hemisphere="north").collect()}
    assert north[7] == "Summer" and north[12] == "Winter"


def test_location_bands(spark):
    rows = {row.RTOCode: row.Island for row in areas(spark, [1, 23, 24, 40, 41, 99]).collect()}
    assert rows == {
        1: "North Island",
        23: "North Island",
        24: "South Island",
        40: "South Island",
        41: "Other",
        99: "Other",
    }


def test_row_accounting(spark):
    """38 areas with visitors in 57 of 60 slots, 31 with spend and 25 with nights in all 60."""
    months = [month(2024 + i // 12, i % 12 + 1) for i in range(30)]
    slots = [(m, kind) for m in months for kind in ("Domestic", "International")]
    spend = [(a, m, "p", k, "o", 1.0, 1.0) for a in range(1, 32) for m, k in slots]
    nights = [(a, m, "p", k, 1) for a in range(1, 26) for m, k in slots]
    visitors = [(a, "x", k, m, 1) for a in range(1, 39) for m, k in slots[:57]]
    locations = areas(spark, [*range(1, 41), 99])
    fact = conform_fact(
        spark.createDataFrame(spend, SPEND),
        spark.createDataFrame(nights, NIGHTS),
        spark.createDataFrame(visitors, VISITORS),
        locations,
        dims.enum_dim(spark),
    ).cache()
    assert tuple(quality.missing_measures(fact).first()) == (2259, 399, 759, 93)
    assert tuple(quality.areas_represented(fact, locations).first()) == (41, 38, 31, 25, 38)
    assert quality.duplicates(fact, ["DateKey", "LocationKey", "VisitorTypeKey"]).isEmpty()
    coverage = {r.RTOName: tuple(r)[2:] for r in quality.coverage_by_area(fact, locations).collect()}
    assert coverage["Area 01"] == (60, 60, 60, 57)
    assert coverage["Area 38"] == (57, 0, 0, 57)
    assert quality.fact_sample(fact, locations, dims.enum_dim(spark)).count() == 50
    fact.unpersist()


def test_spend_detail(spark, sources):
    detail = build_spend_detail(sources[0], areas(spark, [1]), dims.enum_dim(spark))
    rows = sorted(map(tuple, detail.collect()))
    assert rows == [
        (202401, 1, 1, "a", "x", 0.1),
        (202401, 1, 1, "b", "x", 0.2),
        (202402, 1, 2, "a", "x", None),
    ]


def test_month_completeness_and_gaps(spark, sources):
    named = dict(zip(("SpendData", "GuestNightData", "VisitorCountData"), sources))
    rows = [tuple(row) for row in quality.month_completeness(named).collect()]
    assert rows == [
        (month(2024, 1), "January", 2024, "Available", "Available", "Available"),
        (month(2024, 2), "February", 2024, "Available", "Missing", "Missing"),
        (month(2024, 3), "March", 2024, "Missing", "Missing", "Missing"),
        (month(2024, 4), "April", 2024, "Missing", "Available", "Missing"),
    ]
    calendar = dims.month_dim(*sources)
    gaps = quality.coverage_gaps(sources[0], calendar, areas(spark, [1, 2, 30, 99]))
    found = {}
    for row in gaps.collect():
        found.setdefault(row.RTOName, []).append(row.MonthStartDate.month)
    # Gaps and observed months make up the grid of 3 areas × 4 months; zone Other is left out.
    assert found == {"Area 01": [3, 4], "Area 02": [1, 2, 3, 4], "Area 30": [1, 2, 3, 4]}


def test_duplicates_and_orphans(spark):
    child = spark.createDataFrame(
        [(1, "a"), (1, "a"), (2, "b"), (9, "c"), (9, "d"), (None, "e")], "k int, v string"
    )
    parent = spark.createDataFrame([(1,), (1,), (2,)], "p int")
    assert [tuple(r) for r in quality.duplicates(child, ["k", "v"]).collect()] == [(1, "a", 2)]
    assert [tuple(r) for r in quality.orphans(child, "k", parent, "p").collect()] == [(9, 2)]


def test_rules_and_quarantine(spark):
    schema = (
        "RTO_Code int, Month date, Property string, Visitor_type string, Total_stay_nights bigint"
    )
    jan = month(2024, 1)
    rows = spark.createDataFrame(
        [
            (1, jan, "a", "Domestic", 0),
            (1, jan, "a", "Domestic", -1),
            (1, None, "a", "Local", 5),
            (1, jan, "a", None, None),
        ],
        schema,
    )
    rules = quality.nights_rules()
    counts = {r.Rule: r.Violations for r in quality.rule_violations(rows, rules).collect()}
    assert counts == {
        "RTO_Code present": 0,
        "Month present": 1,
        "Property present": 0,
        "Visitor_type present": 1,
        "Visitor_type in domain": 1,  # NULL passes a CHECK
        "Total_stay_nights present": 1,
        "Total_stay_nights in range": 1,
    }
    good, bad = quality.quarantine(rows, rules)
    assert good.count() == 1
    assert {tuple(r.FailedRules) for r in bad.collect()} == {
        ("Total_stay_nights in range",),
        ("Month present", "Visitor_type in domain"),
        ("Visitor_type present", "Total_stay_nights present"),
    }


def test_exact_sum(spark):
    from seasonstar.functions.numeric import exact_avg, exact_sum

    def total(values):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        return tuple(frame.agg(exact_sum(F.col("v")), exact_avg(F.col("v"))).first())

    assert total([0.1] * 10) == (1.0, 0.1)
    assert total([0.00003, -0.00003, 2.675, None]) == (2.675, 2.675 / 3)
    assert total([-1.5, -0.0000000001]) == (-1.5000000001, -1.5000000001 / 2)
    assert total([None, None]) == (None, None)
    assert total([]) == (None, None)
    assert total([9e18, 9e18]) == (1.8e19, 9e18)
    assert total([4e-11] * 1000) == (4e-8, 4e-8 / 1000)
    assert total([1e19, 1.0, -1e19])[0] == 1.0
    assert total([1e300, 1e300])[0] == 2e300
    assert total([5e-324] * 3)[0] == 1.5e-323
    assert total([float("inf"), 1.0])[0] == float("inf")
    assert total([float("nan"), 1.0])[0] != total([float("nan"), 1.0])[0]
    random = Random(5)
    mixed = [random.uniform(-1, 1) * 10.0 ** random.randint(-25, 25) for _ in range(2000)]
    assert total(mixed)[0] == fsum(mixed)
    assert total(sorted(mixed))[0] == total(sorted(mixed, key=abs))[0]


def test_series_sum(spark):
    from pyspark.sql import Window

    from seasonstar.functions.numeric import series_avg, series_sum

    def total(values):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        return tuple(frame.agg(series_sum(F.col("v")), series_avg(F.col("v"))).first())

    assert total([0.1] * 10) == (1.0, 0.1)
    assert total([None, 2.5, None]) == (2.5, 2.5)
    assert total([None]) == total([]) == (None, None)
    assert total([1e19, 1.0, -1e19])[0] == 1.0
    assert total([float("inf"), 1.0])[0] == float("inf")
    assert total([float("nan"), 1.0])[0] != total([float("nan"), 1.0])[0]
    random = Random(7)
    mixed = [random.uniform(-1, 1) * 10.0 ** random.randint(-8, 8) for _ in range(84)]
    assert total(mixed)[0] == fsum(mixed)
    frame = spark.createDataFrame([(i % 3, v) for i, v in enumerate(mixed)], "k int, v double").repartition(5)
    over = frame.select("k", series_sum(F.col("v"), Window.partitionBy("k")).alias("s")).distinct()
    assert sorted(tuple(r) for r in over.collect()) == [(k, fsum(mixed[k::3])) for k in range(3)]


def test_surrogate_key_is_unique_for_all_keys(spark):
    from seasonstar.operators.fact import MOST_TYPES, surrogate_key

    rows = [
        (month, area, kind)
        for month in (0, 202401, 202402, 999912)
        for area in (0, 1, 2, 10, 300_000_000, 2**31 - 1)
        for kind in (0, 1, 9, 10, 11, 99, 100, MOST_TYPES - 1)
    ]
    schema = "DateKey int, LocationKey int, VisitorTypeKey int"
    keys = [r.k for r in spark.createDataFrame(rows, schema).select(surrogate_key().alias("k")).collect()]
    assert None not in keys and len(set(keys)) == len(rows)
    beyond = spark.createDataFrame([(202401, 1, MOST_TYPES), (202401, -1, 1)], schema)
    assert [r.k for r in beyond.select(surrogate_key().alias("k")).collect()] == [None, None]
    usual = spark.createDataFrame([(202401, 7, 2)], schema).select(surrogate_key().alias("k"))
    assert usual.first().k == 20240100000000072
