"""The three analyses on hand-computed cells."""

import random

import pytest

from seasonstar.operators import analytics, dims

FACT = (
    "FactID bigint, DateKey int, LocationKey int, VisitorTypeKey int, "
    "SpendMillion double, GuestNights bigint, VisitorCount bigint"
)
LOCATION = "LocationKey int, RTOCode int, RTOName string, RTOLabel string, Island string"
DOM, INT = 1, 2


@pytest.fixture(scope="module")
def locations(spark):
    rows = [
        (1, 1, "Alpha", None, "North Island"),
        (2, 2, "Beta", None, "North Island"),
        (3, 3, "Gamma", None, "South Island"),
        (9, 9, "Elsewhere", None, "Other"),
    ]
    return spark.createDataFrame(rows, LOCATION)


@pytest.fixture(scope="module")
def types(spark):
    return dims.enum_dim(spark)


def fact(spark, cells):
    """cells: (date key, area, type, spend, nights, visitors)"""
    return spark.createDataFrame([(i, *cell) for i, cell in enumerate(cells)], FACT)


def test_seasonality(spark, locations):
    cells = [
        # Alpha January: 2024 total 4 (two types), 2025 total 8 → average 6; February: 2.
        (202401, 1, DOM, 3.0, None, None),
        (202401, 1, INT, 1.0, None, None),
        (202501, 1, DOM, 8.0, None, None),
        (202402, 1, DOM, 2.0, None, None),
        (202402, 1, INT, None, 5, 5),
        # Beta only in 2025: zone totals per year are averaged, not areas.
        (202501, 2, DOM, 4.0, None, None),
        (202502, 2, DOM, 4.0, None, None),
        # Gamma: zero baseline.
        (202401, 3, DOM, 0.0, None, None),
        (202402, 3, DOM, 0.0, None, None),
        # Out of scope: other zone, other year.
        (202401, 9, DOM, 50.0, None, None),
        (202601, 1, DOM, 99.0, None, None),
    ]
    rows = analytics.seasonality_index(fact(spark, cells), locations).collect()
    got = [(r.AnalysisLevel, r.RTO_or_Island, r.MonthNumber, r[5], r.SeasonalityIndex) for r in rows]
    assert got == [
        ("Island", "North Island", 1, 8.0, 145.5),  # (4 + 12) / 2; mean of 8 and 3 is 5.5
        ("Island", "North Island", 2, 3.0, 54.5),  # (2 + 4) / 2
        ("Island", "South Island", 1, 0.0, None),
        ("Island", "South Island", 2, 0.0, None),
        ("RTO", "Alpha", 1, 6.0, 150.0),
        ("RTO", "Alpha", 2, 2.0, 50.0),
        ("RTO", "Beta", 1, 4.0, 100.0),
        ("RTO", "Beta", 2, 4.0, 100.0),
        ("RTO", "Gamma", 1, 0.0, None),
        ("RTO", "Gamma", 2, 0.0, None),
    ]
    assert rows[0].MonthName == "January"


def test_seasonality_summary(spark, locations):
    cells = [
        (202401, 1, DOM, 6.0, None, None),
        (202402, 1, DOM, 2.0, None, None),
        (202401, 2, DOM, 4.0, None, None),
        (202402, 2, DOM, 4.0, None, None),
        (202401, 3, DOM, 0.0, None, None),
    ]
    profile = analytics.seasonality_profile(fact(spark, cells), locations)
    summary = analytics.seasonality_summary(profile)
    rows = {r.RTO_or_Island: r for r in summary.where("AnalysisLevel = 'RTO'").collect()}
    alpha = rows["Alpha"]
    assert (alpha.StdDevPop, alpha.StdDevSample, alpha.SpreadPoints) == (50.0, 70.71, 100.0)
    assert (alpha.PeakMonth, alpha.TroughMonth) == ("January", "February")
    # All months equal: the earliest month is both peak and trough.
    assert (rows["Beta"].PeakMonth, rows["Beta"].TroughMonth) == ("January", "January")
    assert rows["Gamma"].PeakMonth is None and rows["Gamma"].Months == 0
    top = analytics.top_seasonal_areas(summary, 1).collect()
    assert [r.RTO_or_Island for r in top] == ["Alpha"]


def test_mean_index_is_100(spark, locations):
    rng = random.Random(5)
    cells = [
        (year * 100 + m, area, kind, rng.random() * 100, None, None)
        for year in (2024, 2025)
        for m in range(1, 13)
        for area in (1, 2, 3)
        for kind in (DOM, INT)
        if rng.random() < 0.8
    ]
    profile = analytics.seasonality_profile(fact(spark, cells), locations)
    means = profile.groupBy("AnalysisLevel", "Area").avg("Index").collect()
    assert len(means) == 5
    assert all(row[2] == pytest.approx(100.0) for row in means)


def test_counter_demand(spark, locations, types):
    cells = [
        # Alpha: international 10, 20, 30, 20; mean 20; only January is strictly below.
        (202401, 1, INT, 9.0, 9, 10),
        (202402, 1, INT, 9.0, 9, 20),
        (202403, 1, INT, 9.0, 9, 30),
        (202404, 1, INT, 9.0, 9, 20),
        (202401, 1, DOM, 30.0, None, 50),
        (202402, 1, DOM, 10.0, 4, 100),
        (202403, 1, DOM, None, 6, 100),
        # April has no domestic row: it counts for the mean only.
        # Beta: constant driver → no low month → not listed.
        (202401, 2, INT, None, None, 5),
        (202402, 2, INT, None, None, 5),
        (202401, 2, DOM, 1.0, 1, 1),
        (202402, 2, DOM, 1.0, 1, 1),
        # Gamma: the only month above the mean has no domestic row → no other months.
        (202401, 3, INT, None, None, 1),
        (202402, 3, INT, None, None, 9),
        (202401, 3, DOM, 2.0, 2, 2),
        # NULL driver months and other zones do not take part.
        (202405, 1, INT, 1.0, 1, None),
        (202405, 1, DOM, 1.0, 1, 1),
        (202401, 9, INT, 1.0, 1, 1),
        (202402, 9, INT, 1.0, 1, 9),
        (202401, 9, DOM, 1.0, 1, 1),
    ]
    table = fact(spark, cells)
    rows = [tuple(r) for r in analytics.counter_demand(table, locations, types).collect()]
    assert rows == [
        ("Alpha", "North Island", 1, 50.0, -50.0, 30.0, 200.0, None, None),
        ("Gamma", "South Island", 1, 2.0, None, 2.0, None, 2.0, None),
    ]
    changes = analytics.counter_demand_changes(table, locations, types)
    summary = {r.Measure: tuple(r)[1:] for r in analytics.counter_demand_summary(changes).collect()}
    assert summary == {
        "Visitors": (1, -50.0, -50.0, -50.0, 0),
        "Spend": (1, 200.0, 200.0, 200.0, 1),
        "Nights": (0, None, None, None, 0),
    }


def test_months_with_null_response_still_count(spark, locations, types):
    cells = [
        (202401, 1, INT, None, None, 1),
        (202402, 1, INT, None, None, 9),
        (202401, 1, DOM, None, None, None),
        (202402, 1, DOM, None, None, 3),
    ]
    row = analytics.counter_demand(fact(spark, cells), locations, types).first()
    assert row.LowDemandMonths == 1 and row.AvgDomesticVisitors_LowDemand is None


def test_exposure(spark, locations, types):
    cells = [
        # Alpha: May and June tie for the third place; May comes first.
        (202401, 1, DOM, 10.0, None, None),
        (202402, 1, DOM, 8.0, None, None),
        (202405, 1, DOM, 3.0, None, None),
        (202406, 1, DOM, 1.0, None, None),
        (202406, 1, INT, 2.0, None, None),
        # International January only in one of the two years: averaged over that year alone.
        (202501, 1, DOM, 20.0, None, None),
        (202501, 1, INT, 4.0, None, None),
        # Beta: all zero.
        (202401, 2, DOM, 0.0, None, None),
    ]
    rows = {r.RTOName: tuple(r)[2:] for r in analytics.exposure_score(fact(spark, cells), locations, types).collect()}
    # January 15 + 4 = 19, February 8, May 3, June 3; total 33, international 6.
    assert rows["Alpha"] == (18.2, 90.9, 54.5, "January, February, May")
    assert rows["Beta"] == (None, None, None, "January")


def test_score_is_mean_of_unrounded_shares(spark, locations, types):
    # Shares 60.46… and 33.17…: the mean of the rounded parts would round up.
    cells = [(202401 + i, 1, DOM, 395.4 / 12, None, None) for i in range(12)]
    cells += [(202401 + i, 1, INT, 604.6 / 12, None, None) for i in range(12)]
    cells[0] = (202401, 1, DOM, 395.4 / 12 + 110.0, None, None)
    row = analytics.exposure_score(fact(spark, cells), locations, types).first()
    total, intl = 1110.0, 604.6
    peak = 3 * 1000.0 / 12 + 110.0
    exact = (100 * intl / total + 100 * peak / total) / 2
    assert row.VulnerabilityScore == pytest.approx(exact, abs=0.05)


def test_k_and_types_are_parameters(spark, locations, types):
    cells = [(202401 + i, 1, DOM, float(i), None, None) for i in range(12)]
    row = analytics.exposure_score(
        fact(spark, cells), locations, types, k=1, dependent_type="Domestic", base_type="International"
    ).first()
    assert row.DomesticSpendSharePct == 100.0
    assert row.Peak1MonthSpendSharePct == 16.7 and row.PeakMonths == "December"


def test_measure_index(spark, locations, types):
    cells = [
        (202401, 1, INT, 1.0, None, 10),
        (202402, 1, INT, 1.0, None, 30),
        (202401, 1, DOM, 2.0, None, 7),
        (202402, 1, DOM, None, None, 8),
    ]
    series = (("VisitorCount", "International"), ("SpendMillion", "Domestic"))
    rows = analytics.measure_index(fact(spark, cells), locations, types, series).collect()
    got = sorted((r.Measure, r.DateKey, r.IndexToMean) for r in rows)
    assert got == [
        ("SpendMillion", 202401, 100.0),
        ("VisitorCount", 202401, 50.0),
        ("VisitorCount", 202402, 150.0),
    ]


def test_windows_are_partitioned_by_area(spark, locations, types):
    cells = fact(spark, [(202401, 1, DOM, 1.0, 1, 1)])
    frames = [
        analytics.seasonality_index(cells, locations),
        analytics.counter_demand(cells, locations, types),
        analytics.exposure_score(cells, locations, types),
    ]
    for frame in frames:
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "Window" in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
        optimized = frame._jdf.queryExecution().optimizedPlan().toString()
        for line in optimized.split("\n"):
            if "Window [" in line:
                assert "LocationKey" in line or "Area" in line


@pytest.mark.parametrize("name", ["exposure_score", "counter_demand", "seasonality_index"])
def test_sums_are_generated_small_enough_to_be_compiled(spark, name):
    """The virtual machine never compiles methods of more than 8,000 bytes."""
    from seasonstar.plans.queries import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are generated as they run
    try:
        frame = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = frame._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(debug.codegenStringSeq(plan))
        sizes = [s._3().maxMethodCodeSize() for s in stages if "functions=[" in s._1() and "sum(" in s._1()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000
