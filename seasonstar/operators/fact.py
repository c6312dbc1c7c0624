"""The monthly fact: sources of different grain in one table, missing measures NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.functions.calendar import date_key, key_month, key_year
from seasonstar.functions.numeric import exact_sum

CELL = ("RTO_Code", "Month", "Visitor_type")
MEASURES = ("SpendMillion", "GuestNights", "VisitorCount")
#: Types that the packed row key tells apart.
MOST_TYPES = 920
FACT_GRAIN = ("DateKey", "LocationKey", "VisitorTypeKey")


def surrogate_key() -> Column:
    """Row key packed from the grain: reproducible, and no global numbering pass.

    A month key has at most six digits (year 9999). The type key fills the last digit, and a
    larger one is moved above all others: keys are unique while types number at most MOST_TYPES
    and area keys are any INT of 0 and more. A key outside these ranges, or a negative one, gives NULL, which
    the load's checks report, instead of the key of another row.
    """
    month, area, kind = (F.col(name).cast("bigint") for name in FACT_GRAIN)
    in_range = (
        month.between(0, 999_999) & area.between(0, 2**31 - 1) & kind.between(0, MOST_TYPES - 1)
    )
    narrow = month * 100_000_000_000 + area * 10 + kind % 10
    # 10 ** 17 rows of (month, area, last digit) per group of ten types: 92 groups fit a BIGINT
    return F.when(in_range, narrow + (kind - kind % 10) * 10_000_000_000_000_000)


def _key_cells(
    cells: DataFrame, locations: DataFrame, types: DataFrame, months: DataFrame | None
) -> DataFrame:
    """Replace area code, month and type label by dimension keys; unknown ones drop out."""
    if months is None:
        keyed = cells.where(F.col("Month").isNotNull()).withColumn(
            "DateKey", date_key(F.col("Month"))
        )
    else:
        calendar = months.select(F.col("MonthStartDate").alias("Month"), "DateKey")
        keyed = cells.join(calendar, "Month")
    areas = locations.select(F.col("RTOCode").alias("RTO_Code"), "LocationKey")
    labels = types.withColumnRenamed("VisitorType", "Visitor_type")
    # the types are a literal list inside the plan, so their bound is known
    return keyed.join(areas, "RTO_Code").join(F.broadcast(labels), "Visitor_type")


def conform_fact(
    spend: DataFrame,
    nights: DataFrame,
    visitors: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    months: DataFrame | None = None,
) -> DataFrame:
    """One row per month × area × type that any source reports.

    The sources are stacked with NULL in each other's measures and summed in
    one aggregation: a cell exists when a source row exists, and a sum over
    NULLs only is NULL. Tasks add up their rows before the single shuffle, so
    a hot area or month sends one row per task. Without ``months`` the key
    comes from the month itself, as in the continuous calendar.
    """
    none = F.lit(None).cast("bigint")
    stacked = (
        spend.select(
            *CELL,
            F.col("Monthly_Spend_Million").alias("spend"),
            none.alias("nights"),
            none.alias("visitors"),
        )
        .unionByName(
            nights.select(
                *CELL,
                F.lit(None).cast("double").alias("spend"),
                F.col("Total_stay_nights").alias("nights"),
                none.alias("visitors"),
            )
        )
        .unionByName(
            visitors.select(
                *CELL,
                F.lit(None).cast("double").alias("spend"),
                none.alias("nights"),
                F.col("Visitor_count").alias("visitors"),
            )
        )
    )
    cells = stacked.groupBy(*CELL).agg(
        exact_sum(F.col("spend")).alias("SpendMillion"),
        F.sum("nights").alias("GuestNights"),
        F.sum("visitors").alias("VisitorCount"),
    )
    return _key_cells(cells, locations, types, months).select(
        surrogate_key().alias("FactID"), *FACT_GRAIN, *MEASURES
    )


def conform_fact_join_form(
    spend: DataFrame,
    nights: DataFrame,
    visitors: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    months: DataFrame | None = None,
) -> DataFrame:
    """Same table as :func:`conform_fact`: each source's totals, joined on the distinct cells.

    Sources are reduced to totals first, so every later step handles cells. The aggregation of
    a source is one exchange, which the list of cells and the join share.
    """
    totals = (
        spend.groupBy(*CELL).agg(exact_sum(F.col("Monthly_Spend_Million")).alias("SpendMillion")),
        nights.groupBy(*CELL).agg(F.sum("Total_stay_nights").alias("GuestNights")),
        visitors.groupBy(*CELL).agg(F.sum("Visitor_count").alias("VisitorCount")),
    )
    keys = reduce(DataFrame.union, [total.select(*CELL) for total in totals]).distinct()
    for measure in totals:
        other = measure.select(*[F.col(n).alias(f"__{n}") for n in CELL], measure.columns[-1])
        same = [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in CELL]
        keys = keys.join(other, reduce(Column.__and__, same), "left").drop(*other.columns[:-1])
    return _key_cells(keys, locations, types, months).select(
        surrogate_key().alias("FactID"), *FACT_GRAIN, *MEASURES
    )


def build_spend_detail(
    spend: DataFrame,
    locations: DataFrame,
    types: DataFrame,
    months: DataFrame | None = None,
) -> DataFrame:
    """Second fact at month × area × type × product × origin, on the same dimensions."""
    grain = (*CELL, "Product", "Origin")
    cells = spend.groupBy(*grain).agg(
        exact_sum(F.col("Monthly_Spend_Million")).alias("SpendMillion")
    )
    return _key_cells(cells, locations, types, months).select(
        *FACT_GRAIN, "Product", "Origin", "SpendMillion"
    )


def with_calendar(fact: DataFrame) -> DataFrame:
    """Add ``Year`` (unless stored as a partition column) and ``MonthNumber`` from the key."""
    out = fact.withColumn("MonthNumber", key_month(F.col("DateKey")))
    if "Year" not in fact.columns:
        out = out.withColumn("Year", key_year(F.col("DateKey")))
    return out
