"""The three questions asked of the star, and their summaries.

Every analysis reads fact cells: months × types per area, a number bounded by
the calendar. Where several steps are keyed by area, the cells are shuffled by
area once and the aggregations and windows above reuse that partitioning.
Dimension joins are plain equi-joins: the planner broadcasts a dimension its
size statistics allow, and otherwise shuffles cells that are bounded per area.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonstar.functions.calendar import month_name
from seasonstar.functions.numeric import (
    exact_sum,
    percent_change,
    percent_of,
    round_half_up,
    series_avg,
    series_sum,
)
from seasonstar.operators.fact import with_calendar
from seasonstar.sources.layouts import DOMESTIC, INTERNATIONAL, YEARS, ZONES

LEVEL_AREA = "RTO"
LEVEL_ZONE = "Island"


def _analysis_cells(fact: DataFrame, years: Sequence[int], *columns: str) -> DataFrame:
    return with_calendar(fact).where(F.col("Year").isin(*years)).select(*columns)


def _areas(locations: DataFrame, zones: Sequence[str]) -> DataFrame:
    return locations.where(F.col("Island").isin(*zones)).select("LocationKey", "RTOName", "Island")


def index_to_own_mean(
    rows: DataFrame, keys: Sequence[str], value: str, alias: str = "IndexToMean"
) -> DataFrame:
    """Add 100 × value / mean of the value over the rows with the same ``keys``.

    A series must be bounded (a calendar); a zero mean gives NULL.
    """
    mean = series_avg(F.col(value), Window.partitionBy(*keys))
    return rows.withColumn(alias, percent_of(F.col(value), mean))


def seasonality_profile(
    fact: DataFrame,
    locations: DataFrame,
    measure: str = "SpendMillion",
    zones: Sequence[str] = ZONES,
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Unrounded seasonality: per area and per zone, the average of each calendar
    month over the years and its index to the mean of those monthly averages.

    Zone figures average zone totals, not area averages. Both levels come from
    one pass with grouping sets.
    """
    cells = _analysis_cells(fact, years, "LocationKey", "Year", "MonthNumber", measure)
    cells = cells.where(F.col(measure).isNotNull()).join(_areas(locations, zones), "LocationKey")
    totals = cells.groupingSets(
        [["Island", "RTOName", "Year", "MonthNumber"], ["Island", "Year", "MonthNumber"]],
        "Island",
        "RTOName",
        "Year",
        "MonthNumber",
    ).agg(F.grouping("RTOName").alias("is_zone"), exact_sum(F.col(measure)).alias("total"))
    leveled = totals.select(
        F.when(F.col("is_zone") == 1, LEVEL_ZONE).otherwise(LEVEL_AREA).alias("AnalysisLevel"),
        "Island",
        F.when(F.col("is_zone") == 1, F.col("Island")).otherwise(F.col("RTOName")).alias("Area"),
        "MonthNumber",
        "total",
    ).repartition("AnalysisLevel", "Area")
    averages = leveled.groupBy("AnalysisLevel", "Area", "Island", "MonthNumber").agg(
        series_avg(F.col("total")).alias("AvgMonthly")
    )
    return index_to_own_mean(averages, ["AnalysisLevel", "Area"], "AvgMonthly", "Index")


def seasonality_index(
    fact: DataFrame,
    locations: DataFrame,
    measure: str = "SpendMillion",
    zones: Sequence[str] = ZONES,
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Question 1: the seasonality report, zone level first."""
    profile = seasonality_profile(fact, locations, measure, zones, years)
    return profile.select(
        "AnalysisLevel",
        "Island",
        F.col("Area").alias("RTO_or_Island"),
        "MonthNumber",
        month_name(F.col("MonthNumber")).alias("MonthName"),
        round_half_up(F.col("AvgMonthly"), 2).alias(f"AvgMonthly{measure}"),
        round_half_up(F.col("Index"), 1).alias("SeasonalityIndex"),
    ).orderBy(
        F.when(F.col("AnalysisLevel") == LEVEL_ZONE, 1).otherwise(2),
        "Island",
        "RTO_or_Island",
        "MonthNumber",
    )


def seasonality_summary(profile: DataFrame) -> DataFrame:
    """One row per area and zone: spread of the indices, their deviation, peak and trough month.

    Both deviations are given: over the months as the whole population, and as a sample.
    """
    index = F.col("Index")
    month = F.col("MonthNumber")
    # Earliest month wins a tie: order by (index, -month) and (index, month).
    peak = F.max(F.when(index.isNotNull(), F.struct(index, (-month).alias("m"))))
    trough = F.min(F.when(index.isNotNull(), F.struct(index, month.alias("m"))))
    summary = profile.groupBy("AnalysisLevel", "Area", "Island").agg(
        F.count(index).alias("Months"),
        F.stddev_pop(index).alias("dev_pop"),
        F.stddev_samp(index).alias("dev_samp"),
        F.max(index).alias("high"),
        F.min(index).alias("low"),
        peak.alias("peak"),
        trough.alias("trough"),
    )
    return summary.select(
        "AnalysisLevel",
        "Island",
        F.col("Area").alias("RTO_or_Island"),
        "Months",
        round_half_up(F.col("dev_pop"), 2).alias("StdDevPop"),
        round_half_up(F.col("dev_samp"), 2).alias("StdDevSample"),
        round_half_up(F.col("high") - F.col("low"), 1).alias("SpreadPoints"),
        month_name(-F.col("peak.m")).alias("PeakMonth"),
        month_name(F.col("trough.m")).alias("TroughMonth"),
    )


def top_seasonal_areas(summary: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` areas with the widest spread of monthly indices."""
    areas = summary.where(F.col("AnalysisLevel") == LEVEL_AREA).drop("AnalysisLevel")
    return areas.orderBy(F.desc_nulls_last("StdDevPop"), "RTO_or_Island").limit(n)


def demand_periods(
    fact: DataFrame,
    types: DataFrame,
    driver: str = "VisitorCount",
    driver_type: str = INTERNATIONAL,
    response_type: str = DOMESTIC,
    responses: Sequence[str] = ("VisitorCount", "SpendMillion", "GuestNights"),
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Area-months with a driver value, flagged ``Low`` when strictly below the area's own mean.

    The mean covers every month with a driver value; rows are then limited to
    months in which the response type has a fact row.
    """
    needed = list(dict.fromkeys(["LocationKey", "DateKey", "VisitorTypeKey", driver, *responses]))
    cells = _analysis_cells(fact, years, *needed).join(types, "VisitorTypeKey")
    is_driver = F.col("VisitorType") == driver_type
    is_response = F.col("VisitorType") == response_type
    months = (
        cells.repartition("LocationKey")
        .groupBy("LocationKey", "DateKey")
        .agg(
            F.max(F.when(is_driver, F.col(driver))).alias("Driver"),
            F.max(is_response).alias("HasResponse"),
            *[F.max(F.when(is_response, F.col(name))).alias(name) for name in responses],
        )
        .where(F.col("Driver").isNotNull())
    )
    mean = series_avg(F.col("Driver"), Window.partitionBy("LocationKey"))
    return months.withColumn("Low", F.col("Driver") < mean).where("HasResponse")


def counter_demand_changes(
    fact: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    zones: Sequence[str] = ZONES,
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Unrounded averages in low and other months, and their relative differences, per area."""
    rows = demand_periods(fact, types, years=years)
    low = F.col("Low")
    measures = (
        ("Visitors", "VisitorCount"),
        ("Spend", "SpendMillion"),
        ("Nights", "GuestNights"),
    )
    averages = []
    for name, column in measures:
        averages.append(series_avg(F.when(low, F.col(column))).alias(f"Low{name}"))
        averages.append(series_avg(F.when(~low, F.col(column))).alias(f"Other{name}"))
    per_area = rows.groupBy("LocationKey").agg(F.count_if(low).alias("LowDemandMonths"), *averages)
    changes = [
        percent_change(F.col(f"Low{name}"), F.col(f"Other{name}")).alias(f"{name}Change")
        for name, _ in measures
    ]
    kept = per_area.where(F.col("LowDemandMonths") > 0)
    return kept.join(_areas(locations, zones), "LocationKey").select("*", *changes)


def counter_demand(
    fact: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    zones: Sequence[str] = ZONES,
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Question 2: domestic activity in months of low international demand."""
    rows = counter_demand_changes(fact, locations, types, zones, years)
    return rows.select(
        "RTOName",
        "Island",
        "LowDemandMonths",
        round_half_up(F.col("LowVisitors"), 0).alias("AvgDomesticVisitors_LowDemand"),
        round_half_up(F.col("VisitorsChange"), 1).alias("VisitorDiffPct"),
        round_half_up(F.col("LowSpend"), 2).alias("AvgDomesticSpendMillion_LowDemand"),
        round_half_up(F.col("SpendChange"), 1).alias("SpendDiffPct"),
        round_half_up(F.col("LowNights"), 0).alias("AvgDomesticGuestNights_LowDemand"),
        round_half_up(F.col("NightsChange"), 1).alias("GuestNightsDiffPct"),
    ).orderBy(F.desc_nulls_last("SpendDiffPct"), "RTOName")


def counter_demand_summary(changes: DataFrame) -> DataFrame:
    """Per measure: areas compared, median and range of the change, and how many areas rise.

    The median holds one value per area, so its state is the size of the area dimension.
    """
    long = changes.unpivot(
        ["LocationKey"], ["VisitorsChange", "SpendChange", "NightsChange"], "Measure", "Change"
    )
    change = F.col("Change")
    return (
        long.groupBy(F.replace("Measure", F.lit("Change"), F.lit("")).alias("Measure"))
        .agg(
            F.count(change).alias("Areas"),
            round_half_up(F.median(change), 1).alias("MedianChangePct"),
            round_half_up(F.min(change), 1).alias("MinChangePct"),
            round_half_up(F.max(change), 1).alias("MaxChangePct"),
            F.count_if(change > 0).alias("AreasRising"),
        )
    )


def exposure_score(
    fact: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    measure: str = "SpendMillion",
    dependent_type: str = INTERNATIONAL,
    base_type: str = DOMESTIC,
    k: int = 3,
    zones: Sequence[str] = ZONES,
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Question 3: dependence on one visitor type, concentration in the ``k`` peak
    months, and their mean, per area.

    The fact has one cell per area, month and type. Each calendar month is averaged over the
    years separately per type; ties between months go to the earlier month. The score is taken from the
    unrounded shares.
    """
    cells = _analysis_cells(
        fact, years, "LocationKey", "VisitorTypeKey", "Year", "MonthNumber", measure
    ).where(F.col(measure).isNotNull())
    cells = cells.join(types, "VisitorTypeKey").join(_areas(locations, zones), "LocationKey")
    area = ("LocationKey", "RTOName", "Island")
    yearly = (
        cells.repartition("LocationKey")
        .groupBy(*area, "Year", "MonthNumber", "VisitorType")
        .agg(series_sum(F.col(measure)).alias("total"))
    )

    def type_average(name: str) -> Column:
        average = series_avg(F.when(F.col("VisitorType") == name, F.col("total")))
        return F.coalesce(average, F.lit(0.0))

    months = (
        yearly.groupBy(*area, "MonthNumber")
        .agg(type_average(base_type).alias("base"), type_average(dependent_type).alias("dependent"))
        .withColumn("combined", F.col("base") + F.col("dependent"))
    )
    order = Window.partitionBy("LocationKey").orderBy(F.desc("combined"), F.asc("MonthNumber"))
    ranked = months.withColumn("PeakRank", F.row_number().over(order)).withColumn(
        "PeakName",
        F.when(F.col("PeakRank") <= k, month_name(F.col("MonthNumber"))),
    )
    shares = ranked.groupBy(*area).agg(
        percent_of(series_sum(F.col("dependent")), series_sum(F.col("combined"))).alias("dependence"),
        percent_of(
            series_sum(F.when(F.col("PeakRank") <= k, F.col("combined")).otherwise(0.0)),
            series_sum(F.col("combined")),
        ).alias("concentration"),
        F.expr("listagg(PeakName, ', ') WITHIN GROUP (ORDER BY PeakRank)").alias("PeakMonths"),
    )
    return shares.select(
        "RTOName",
        "Island",
        round_half_up(F.col("dependence"), 1).alias(f"{dependent_type}SpendSharePct"),
        round_half_up(F.col("concentration"), 1).alias(f"Peak{k}MonthSpendSharePct"),
        round_half_up((F.col("dependence") + F.col("concentration")) / 2.0, 1).alias(
            "VulnerabilityScore"
        ),
        "PeakMonths",
    ).orderBy(F.desc_nulls_last("VulnerabilityScore"), "RTOName")


def top_exposed_areas(scores: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` areas with the highest score."""
    return scores.orderBy(F.desc_nulls_last("VulnerabilityScore"), "RTOName").limit(n)


def measure_index(
    fact: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    series: Sequence[tuple[str, str]],
    zones: Sequence[str] = ZONES,
    years: Sequence[int] = YEARS,
) -> DataFrame:
    """Monthly series per area, each indexed to its own mean month.

    ``series`` lists (measure, visitor type) pairs; all come from one pass.
    """
    measures = list(dict.fromkeys(measure for measure, _ in series))
    cells = _analysis_cells(
        fact, years, "LocationKey", "DateKey", "VisitorTypeKey", *measures
    ).join(types, "VisitorTypeKey")
    entries = [
        F.struct(
            F.lit(measure).alias("Measure"),
            F.when(F.col("VisitorType") == kind, F.col(measure).cast("double")).alias("Value"),
        )
        for measure, kind in series
    ]
    rows = cells.select(
        "LocationKey", "DateKey", "VisitorType", F.inline(F.array(*entries))
    ).where(F.col("Value").isNotNull())
    indexed = index_to_own_mean(rows, ["LocationKey", "Measure", "VisitorType"], "Value")
    return indexed.join(_areas(locations, zones), "LocationKey").select(
        "RTOName",
        "Island",
        "VisitorType",
        "DateKey",
        "Measure",
        "Value",
        round_half_up(F.col("IndexToMean"), 1).alias("IndexToMean"),
    )
