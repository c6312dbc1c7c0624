"""Dimensions: continuous month calendar, areas with zones, enumerations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonstar.functions import calendar
from seasonstar.operators.clean import MAPPING
from seasonstar.sources.layouts import OTHER, VISITOR_TYPES, ZONE_BANDS


def with_month_attributes(months: DataFrame, hemisphere: str = "south") -> DataFrame:
    """Calendar columns for a ``MonthStartDate``."""
    month = F.col("MonthStartDate")
    number = F.month(month)
    return months.select(
        calendar.date_key(month).alias("DateKey"),
        month,
        number.alias("MonthNumber"),
        calendar.month_name(number).alias("MonthName"),
        calendar.quarter_label(month).alias("Quarter"),
        F.year(month).alias("Year"),
        calendar.season(number, hemisphere).alias("Season"),
    )


def month_dim(*sources: DataFrame, hemisphere: str = "south") -> DataFrame:
    """Every month from the earliest to the latest ``Month`` of the sources, gaps included.

    One partial min/max per task over each source; the calendar itself is
    expanded from a single row.
    """
    months = reduce(DataFrame.unionByName, [frame.select("Month") for frame in sources])
    bounds = months.agg(F.min("Month").alias("low"), F.max("Month").alias("high"))
    series = F.explode(F.sequence("low", "high", F.expr("interval 1 month")))
    return with_month_attributes(bounds.select(series.alias("MonthStartDate")), hemisphere)


def location_dim(
    mapping: DataFrame,
    bands: Sequence[tuple[int, int, str]] = ZONE_BANDS,
    other: str = OTHER,
) -> DataFrame:
    """Areas with their zone, from inclusive code bands."""
    code = F.col("RTO_Code")
    return mapping.select(
        code.alias("LocationKey"),
        code.alias("RTOCode"),
        F.col(MAPPING.name).alias("RTOName"),
        F.col(MAPPING.label).alias("RTOLabel"),
        calendar.band(code, bands, other).alias("Island"),
    )


def enum_dim(
    spark: SparkSession,
    entries: Sequence[tuple[int, str]] = VISITOR_TYPES,
    key: str = "VisitorTypeKey",
    label: str = "VisitorType",
) -> DataFrame:
    """A literal key/label relation, small enough to live in the plan."""
    rows = [
        F.struct(F.lit(number).cast("int").alias(key), F.lit(name).alias(label))
        for number, name in entries
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))
