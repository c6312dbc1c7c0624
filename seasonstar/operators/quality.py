"""Data-quality reports on sources and star."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.functions.calendar import key_month, key_year, month_name
from seasonstar.sources.layouts import DOMESTIC, INTERNATIONAL, OTHER, ZONES


def fact_sample(
    fact: DataFrame, locations: DataFrame, types: DataFrame, n: int = 50
) -> DataFrame:
    """First ``n`` fact rows with their dimension attributes, by month, area and type."""
    month = F.make_date(key_year(F.col("DateKey")), key_month(F.col("DateKey")), F.lit(1))
    return (
        fact.withColumn("MonthStartDate", month)
        .join(locations.select("LocationKey", "RTOName", "Island"), "LocationKey")
        .join(types, "VisitorTypeKey")
        .select(
            "MonthStartDate",
            "RTOName",
            "Island",
            "VisitorType",
            "SpendMillion",
            "GuestNights",
            "VisitorCount",
        )
        .orderBy("MonthStartDate", "RTOName", "VisitorType")
        .limit(n)
    )


def missing_measures(fact: DataFrame) -> DataFrame:
    """Fact rows, and rows without each measure."""
    return fact.agg(
        F.count(F.lit(1)).alias("TotalFactRows"),
        F.count_if(F.col("SpendMillion").isNull()).alias("MissingSpendRows"),
        F.count_if(F.col("GuestNights").isNull()).alias("MissingGuestNightRows"),
        F.count_if(F.col("VisitorCount").isNull()).alias("MissingVisitorCountRows"),
    )


def _area_counts(fact: DataFrame) -> DataFrame:
    return fact.groupBy("LocationKey").agg(
        F.count(F.lit(1)).alias("FactRows"),
        F.count("SpendMillion").alias("SpendObservations"),
        F.count("GuestNights").alias("GuestNightObservations"),
        F.count("VisitorCount").alias("VisitorCountObservations"),
    )


def coverage_by_area(fact: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows and observations per measure for every area in the fact."""
    areas = locations.select("LocationKey", "RTOName", "Island")
    return (
        areas.join(_area_counts(fact), "LocationKey")
        .drop("LocationKey")
        .orderBy("Island", "RTOName")
    )


def areas_represented(fact: DataFrame, locations: DataFrame) -> DataFrame:
    """How many known areas the fact holds, in all and per measure."""
    seen = locations.select("LocationKey").join(_area_counts(fact), "LocationKey", "left")
    return seen.agg(
        F.count(F.lit(1)).alias("AreasKnown"),
        F.count("FactRows").alias("AreasRepresented"),
        F.count_if(F.col("SpendObservations") > 0).alias("AreasWithSpend"),
        F.count_if(F.col("GuestNightObservations") > 0).alias("AreasWithGuestNights"),
        F.count_if(F.col("VisitorCountObservations") > 0).alias("AreasWithVisitors"),
    )


def month_completeness(
    sources: Mapping[str, DataFrame], months: DataFrame | None = None
) -> DataFrame:
    """Available/Missing per source for every month of ``months`` (column ``MonthStartDate``), or
    between the first and last observed one.

    One pass over the sources; the months seen per source, bounded by the
    calendar, meet in one row from which the calendar is expanded.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            frame.where(F.col("Month").isNotNull()).select("Month", F.lit(name).alias("Source"))
            for name, frame in sources.items()
        ],
    ).distinct()
    # Not collect_set: the planner would then drop the distinct and collect every source row.
    seen = [
        F.collect_list(F.when(F.col("Source") == name, F.col("Month"))).alias(name)
        for name in sources
    ]
    summary = rows.agg(F.min("Month").alias("low"), F.max("Month").alias("high"), *seen)
    month = F.col("MonthStartDate")
    if months is None:
        every = F.sequence("low", "high", F.expr("interval 1 month"))
        calendar = summary.withColumn("MonthStartDate", F.explode(every))
    else:
        # the summary is one row; a calendar has a row per month
        calendar = months.select("MonthStartDate").crossJoin(F.broadcast(summary))
    return (
        calendar.select(
            month,
            month_name(F.month(month)).alias("MonthName"),
            F.year(month).alias("Year"),
            *[
                F.when(F.array_contains(F.col(name), month), "Available")
                .otherwise("Missing")
                .alias(name)
                for name in sources
            ],
        )
        .orderBy("MonthStartDate")
    )


def coverage_gaps(
    source: DataFrame,
    months: DataFrame,
    locations: DataFrame,
    zones: Sequence[str] = ZONES,
) -> DataFrame:
    """Area × month combinations of the calendar that the source lacks.

    The expected grid is never built: per area the months seen (bounded by the
    calendar) are taken off the full month sequence, and only gaps are emitted.
    Areas the source never mentions miss every month.
    """
    first = F.min("MonthStartDate").alias("first")
    last = F.max("MonthStartDate").alias("last")
    bounds = months.agg(F.struct(first, last).alias("bounds")).scalar()
    expected = F.sequence(bounds["first"], bounds["last"], F.expr("interval 1 month"))
    # Not collect_set: the planner would then drop the distinct and collect every source row.
    seen = (
        source.where(F.col("RTO_Code").isNotNull() & F.col("Month").isNotNull())
        .select("RTO_Code", "Month")
        .distinct()
        .groupBy("RTO_Code")
        .agg(F.collect_list("Month").alias("seen"))
    )
    areas = locations.where(F.col("Island").isin(*zones)).select(
        F.col("RTOCode").alias("RTO_Code"), "RTOName", "Island"
    )
    missing = F.array_except(
        expected, F.coalesce(F.col("seen"), F.array().cast("array<date>"))
    )
    return (
        areas.join(seen, "RTO_Code", "left")
        .select("RTOName", "Island", F.explode(missing).alias("MonthStartDate"))
        .orderBy("RTOName", "MonthStartDate")
    )


def duplicates(rows: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Grain values held by more than one row, with the number of copies."""
    counts = rows.groupBy(*grain).agg(F.count(F.lit(1)).alias("Copies"))
    return counts.where(F.col("Copies") > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child key values without a parent, with their row counts; NULL keys are not orphans.

    Both sides are reduced to distinct keys within each task first, so a hot
    key crosses the shuffle once per task and the join sees it once.
    """
    keys = (
        child.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("Key"))
        .agg(F.count(F.lit(1)).alias("Rows"))
    )
    known = parent.select(F.col(parent_key).alias("Key")).distinct()
    return keys.join(known, "Key", "left_anti")


@dataclass(frozen=True)
class Rule:
    """A named row rule. CHECK conditions pass on NULL, as constraints do."""

    name: str
    kind: str
    condition: Column

    @property
    def violated(self) -> Column:
        return ~F.coalesce(self.condition, F.lit(True))


def not_null(column: str) -> Rule:
    return Rule(f"{column} present", "NOT NULL", F.col(column).isNotNull())


def in_domain(column: str, values: Sequence[str]) -> Rule:
    return Rule(f"{column} in domain", "DOMAIN", F.col(column).isin(*values))


def in_range(column: str, low: float | None = None, high: float | None = None) -> Rule:
    condition = F.lit(True)
    if low is not None:
        condition = condition & (F.col(column) >= low)
    if high is not None:
        condition = condition & (F.col(column) <= high)
    return Rule(f"{column} in range", "RANGE", condition)


def visitor_rules() -> list[Rule]:
    return [
        not_null("RTO_Code"),
        not_null("Destination"),
        not_null("Visitor_type"),
        in_domain("Visitor_type", (DOMESTIC, INTERNATIONAL)),
        not_null("Month"),
        not_null("Visitor_count"),
        in_range("Visitor_count", 0),
    ]


def nights_rules() -> list[Rule]:
    return [
        not_null("RTO_Code"),
        not_null("Month"),
        not_null("Property"),
        not_null("Visitor_type"),
        in_domain("Visitor_type", (DOMESTIC, INTERNATIONAL)),
        not_null("Total_stay_nights"),
        in_range("Total_stay_nights", 0),
    ]


def spend_rules() -> list[Rule]:
    return [
        not_null("RTO_Code"),
        not_null("Month"),
        not_null("Product"),
        not_null("Visitor_type"),
        in_domain("Visitor_type", (DOMESTIC, INTERNATIONAL)),
        not_null("Origin"),
    ]


def mapping_rules() -> list[Rule]:
    return [not_null("RTO_Code"), not_null("RTO2025_V1_00_NAME")]


def month_rules() -> list[Rule]:
    return [
        not_null("MonthStartDate"),
        not_null("MonthNumber"),
        in_range("MonthNumber", 1, 12),
        not_null("MonthName"),
        not_null("Quarter"),
        in_domain("Quarter", ("Q1", "Q2", "Q3", "Q4")),
        not_null("Year"),
        not_null("Season"),
        in_domain("Season", ("Summer", "Autumn", "Winter", "Spring")),
    ]


def location_rules() -> list[Rule]:
    return [
        not_null("RTOCode"),
        not_null("RTOName"),
        not_null("Island"),
        in_domain("Island", (*ZONES, OTHER)),
    ]


def rule_violations(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Violation count of every rule, all rules in one pass."""
    counts = rows.agg(
        *[F.count_if(rule.violated).alias(f"r{i}") for i, rule in enumerate(rules)]
    )
    entries = [
        F.struct(
            F.lit(rule.name).alias("Rule"),
            F.lit(rule.kind).alias("Kind"),
            F.col(f"r{i}").alias("Violations"),
        )
        for i, rule in enumerate(rules)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def quarantine(rows: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those passing every rule and those failing, with the failed rule names."""
    failed = F.filter(
        F.array(*[F.when(rule.violated, F.lit(rule.name)) for rule in rules]),
        lambda name: name.isNotNull(),
    )
    broken = reduce(lambda left, right: left | right, [rule.violated for rule in rules])
    return rows.where(~broken), rows.where(broken).withColumn("FailedRules", failed)
