"""The three raw text sources, the mapping and the star, derived from the sales tables.

``raw_*`` render untidy text (mixed date forms, padding, suffixes, flags, total
rows); the functions without prefix give the same content already typed. Both
read the whole tables.

============  ==================================================================
area          nation; code = n_nationkey + 1; no label in the region MIDDLE EAST
zone          bands of the area code
spend         one row per line item: supplier's nation, ship month, discounted price
nights        one row per line item: supplier's nation, ship month, quantity
visitors      distinct customers per nation, order month and market segment
============  ==================================================================
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonstar.functions.text import recode
from seasonstar.operators.clean import MAPPING, clean_mapping
from seasonstar.operators.dims import enum_dim, location_dim
from seasonstar.operators.fact import conform_fact
from seasonstar.operators.joins import dim_join
from seasonstar.sources.layouts import (
    DOMESTIC,
    INTERNATIONAL,
    NORTH,
    SOUTH,
    NightsLayout,
    SpendLayout,
)

# Fixed values of the demo: bands, window (complete order months), complete years.
BANDS = ((1, 10, NORTH), (11, 20, SOUTH))
WINDOW = (dt.date(1995, 1, 1), dt.date(2001, 7, 1))
YEARS = (1995, 1996, 1997, 1998, 1999, 2000)
UNLABELLED_REGION = "MIDDLE EAST"
SPEND_LAYOUT = SpendLayout(
    excluded_areas=("non-RTO - NATION_4", "non-RTO - NATION_9", "non-RTO - NATION_14")
)
NIGHTS_LAYOUT = NightsLayout()
STATUS_TYPES = {"F": DOMESTIC, "O": INTERNATIONAL}
SEGMENT_TYPES = {
    "BUILDING": DOMESTIC,
    "HOUSEHOLD": DOMESTIC,
    "AUTOMOBILE": DOMESTIC,
    "MACHINERY": INTERNATIONAL,
    "FURNITURE": INTERNATIONAL,
}
SUPPRESSED_DISCOUNT = 10


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _cents(column: str) -> Column:
    """A two-decimal number in hundredths, as an integer."""
    return F.rint(F.col(column) * 100).cast("bigint")


def _amount() -> Column:
    """Discounted price in ten-thousandths; not reported for the largest quantity."""
    price = _cents("l_extendedprice") * (100 - _cents("l_discount"))
    return F.when(F.col("l_quantity") < 50, price)


def _month(day: Column) -> Column:
    return F.trunc(day, "month")


def _day_text(day: Column, form: Column) -> Column:
    """ISO, ``D/M/YYYY`` or padded ``DD/MM/YYYY`` text, chosen by ``form``."""
    number, month, year = (
        part.cast("string") for part in (F.dayofmonth(day), F.month(day), F.year(day))
    )
    slash = F.lit("/")
    return (
        F.when(form == "R", day.cast("string"))
        .when(form == "A", F.concat(number, slash, month, slash, year))
        .otherwise(
            F.concat(F.lit(" "), F.lpad(number, 2, "0"), slash, F.lpad(month, 2, "0"), slash, year)
        )
    )


def _in_window(day: Column) -> Column:
    """Day inside the months of the load window, without computing its month."""
    low, high = WINDOW
    after = dt.date(high.year + high.month // 12, high.month % 12 + 1, 1)
    return (day >= F.lit(low)) & (day < F.lit(after))


class Demo:
    """Sources and star of one table directory; every table is opened at most once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = read(self.spark, self.sf_dir, name)
        return self._tables[name]

    # --- shared parts ---------------------------------------------------------

    @cached_property
    def _nations(self) -> DataFrame:
        label = F.when(F.col("r_name") != UNLABELLED_REGION, F.concat_ws(" ", "r_name", "n_name"))
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("nation"),
                (F.col("n_nationkey") + 1).alias("code"),
                F.col("n_name").alias("name"),
                "r_name",
                label.alias("label"),
            )
        )

    @cached_property
    def _items(self) -> DataFrame:
        """Line items with the area of their supplier, in one size-checked join."""
        items = self.table("lineitem").select(
            F.col("l_suppkey").alias("supplier"),
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_returnflag",
            "l_linestatus",
            F.col("l_shipdate").cast("date").alias("day"),
        )
        suppliers = self.table("supplier").select(
            F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("nation")
        )
        areas = suppliers.join(self._nations, "nation").drop("nation")
        return dim_join(items, areas, ["supplier"])

    @cached_property
    def _customer_months(self) -> DataFrame:
        """Customers per nation, month and visitor type; each customer counts once a month.

        Orders shrink to one row per customer and month before they meet the
        customers, so a customer with very many orders stays small in the join.
        """
        active = (
            self.table("orders")
            .select(
                F.col("o_custkey").alias("customer"),
                _month(F.col("o_orderdate").cast("date")).alias("Month"),
            )
            .distinct()
        )
        customers = self.table("customer").select(
            F.col("c_custkey").alias("customer"),
            F.col("c_nationkey").alias("nation"),
            recode("c_mktsegment", SEGMENT_TYPES).alias("Visitor_type"),
        )
        return (
            active.join(customers, "customer")
            .groupBy("nation", "Month", "Visitor_type")
            .agg(F.count(F.lit(1)).alias("Visitor_count"))
        )

    # --- raw text -------------------------------------------------------------

    @cached_property
    def raw_mapping(self) -> DataFrame:
        label = F.coalesce(F.col("label"), F.lit(" null "))
        return self._nations.select(
            F.concat(F.lit(" "), _text("code")).alias(MAPPING.code),
            F.concat(F.lit("  "), "name", F.lit(" ")).alias(MAPPING.name),
            F.col("name").alias(MAPPING.name_ascii),
            label.alias(MAPPING.label),
            label.alias(MAPPING.label_ascii),
        )

    @cached_property
    def raw_spend(self) -> DataFrame:
        """Line items as spending text; first lines also carry a row for both visitor types."""
        kind = F.when(F.col("l_linestatus") == "F", "New Zealand").otherwise(" International ")
        area = F.coalesce("label", F.concat(F.lit("non-RTO - "), "name"))
        millions = _amount().cast("decimal(18,0)") * F.lit(Decimal("0.0000000001"))
        rows = self._items.select(
            "l_linenumber",
            _day_text(F.col("day"), F.col("l_returnflag")).alias("Date"),
            F.concat(F.lit(" "), area, F.lit(" ")).alias("RTO"),
            F.concat(F.lit("Product "), _text("l_linenumber")).alias("Product"),
            kind.alias("kind"),
            F.concat(F.lit(" Market "), "l_returnflag").alias("Origin"),
            F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("Annual Spend"),
            F.concat(F.lit(" "), millions.cast("string")).alias("Monthly Spend"),
        )

        def row(kind: Column) -> Column:
            return F.struct(
                "Date",
                "RTO",
                "Product",
                kind.alias("Visitor Type"),
                "Origin",
                "`Annual Spend`",
                "`Monthly Spend`",
            )

        return _emit(rows, row(F.col("kind")), [row(F.lit("Total"))])

    @cached_property
    def raw_nights(self) -> DataFrame:
        """Line items as guest-night text; first lines also carry total and regional rows."""
        area = (
            F.when(F.col("l_returnflag") == "A", F.concat(F.lit("  "), "name", F.lit(" RTO")))
            .when(F.col("l_returnflag") == "N", F.concat("name", F.lit(" rto ")))
            .otherwise(F.col("name"))
        )
        measure = F.when(F.col("l_linestatus") == "F", " Domestic guest nights").otherwise(
            "International guest nights "
        )
        flag = (
            F.when(_cents("l_discount") == SUPPRESSED_DISCOUNT, " c ")
            .when(_cents("l_discount") == 9, "C")
            .when(_cents("l_discount") == 8, "")
        )
        rows = self._items.select(
            "l_linenumber",
            "r_name",
            _day_text(F.col("day"), F.col("l_returnflag")).alias("Month"),
            area.alias("area_text"),
            F.concat(F.lit("Property "), _text("l_linenumber")).alias("property_text"),
            measure.alias("measure_text"),
            _text("l_quantity").alias("Value"),
            flag.alias("Flag"),
        )

        def row(
            level: str = " RTO",
            area: Column = F.col("area_text"),
            prop: Column = F.col("property_text"),
            measure: Column = F.col("measure_text"),
        ) -> Column:
            return F.struct(
                "Month",
                F.lit(level).alias("Area type"),
                area.alias("Area"),
                prop.alias("Property"),
                measure.alias("Measure"),
                "Value",
                "Flag",
            )

        extra = [
            row("RTO ", prop=F.lit(" Total")),
            row("RTO", area=F.lit("Total New Zealand ")),
            row("Regional Council", area=F.col("r_name")),
            row("RTO", measure=F.lit("Total guest nights")),
        ]
        return _emit(rows, row(), extra)

    @cached_property
    def raw_visitors(self) -> DataFrame:
        """Customer counts as visitor text, with regional rows and an all-visitors row."""
        domestic = F.col("Visitor_type") == DOMESTIC
        rows = self._customer_months.join(self._nations, "nation").select(
            "r_name",
            F.concat(F.lit(" RTO"), F.lpad(_text("code"), 2, "0"), F.lit(" ")).alias("code_text"),
            F.concat("name", F.lit(" RTO")).alias("area_text"),
            F.when(domestic, " Domestic visitor")
            .otherwise("Total international visitor ")
            .alias("segment_text"),
            _day_text(F.col("Month"), F.when(domestic, "R").otherwise("N")).alias("Date"),
            _text("Visitor_count").alias("Monthly_unique_counts"),
        )

        def row(level: str, code: Column, name: Column, segment: Column) -> Column:
            return F.struct(
                code.alias("Destination_code"),
                name.alias("Destination"),
                segment.alias("Population_segment"),
                "Date",
                "Monthly_unique_counts",
                F.lit(level).alias("Geographic_level_destination"),
            )

        code, name, segment = F.col("code_text"), F.col("area_text"), F.col("segment_text")
        region = row("Region", F.concat(F.lit("REG"), "r_name"), F.col("r_name"), segment)
        total = row("RTO", code, name, F.lit("All visitors"))
        return rows.select(F.inline(F.array(row(" RTO", code, name, segment), region, total)))

    # --- rows that break rules or match no area --------------------------------

    def _spoiled(self, usual: dict[str, Column], faults: list[dict[str, Column]]) -> DataFrame:
        """A row per supplier and fault: the usual text with some columns replaced, the fault
        chosen by the last digit of the supplier's key."""
        digit = F.col("s_suppkey") % 10
        columns = []
        for name, value in usual.items():
            for i, fault in enumerate(faults):
                if name in fault:
                    value = F.when(digit == i, fault[name]).otherwise(value)
            columns.append(value.alias(name))
        suppliers = self.table("supplier").join(
            self._nations, F.col("s_nationkey") == F.col("nation")
        )
        return suppliers.where(digit < len(faults)).select(*columns)

    @cached_property
    def spoiled_nights(self) -> DataFrame:
        """Guest nights with a negative and a blank value, no date, an unknown and a decomposed
        area name, no property and no area."""
        none, decomposed = F.lit(None).cast("string"), F.concat("name", F.lit("\u0301"))
        usual = {
            "Month": F.lit("1995-03-01"),
            "Area type": F.lit("Regional Council"),
            "Area": F.col("name"),
            "Property": F.lit("Spoiled"),
            "Measure": F.lit("Domestic guest nights"),
            "Value": F.lit("7"),
            "Flag": F.lit(""),
        }
        faults = [
            {"Value": F.lit("-5")},
            {"Value": F.lit(" ")},
            {"Month": F.lit("soon")},
            {"Area": F.lit("Atlantis"), "Area type": F.lit("RTO")},
            {"Area": decomposed, "Area type": F.lit("RTO")},
            {"Property": none},
            {"Area": none},
        ]
        return self.raw_nights.unionByName(self._spoiled(usual, faults))

    @cached_property
    def spoiled_spend(self) -> DataFrame:
        """Spending without date, product, origin or area, and of an unknown area."""
        none = F.lit(None).cast("string")
        usual = {
            "Date": F.lit("1/03/1995"),
            "RTO": F.lit(SPEND_LAYOUT.excluded_areas[0]),
            "Product": F.lit("Spoiled"),
            "Visitor Type": F.lit("International"),
            "Origin": F.lit("Market A"),
            "Annual Spend": F.lit("1"),
            "Monthly Spend": F.lit("1"),
        }
        faults = [
            {"Date": F.lit("soon")},
            {"Product": none},
            {"Origin": none},
            {"RTO": F.concat(F.lit("Lost "), "name")},
            {"RTO": none},
        ]
        return self.raw_spend.unionByName(self._spoiled(usual, faults))

    @cached_property
    def spoiled_visitors(self) -> DataFrame:
        """Visitors with a negative and no count, no date, no name, and an unknown code."""
        none = F.lit(None).cast("string")
        usual = {
            "Destination_code": F.lit("RTO01"),
            "Destination": F.concat("name", F.lit(" RTO")),
            "Population_segment": F.lit("Domestic visitor"),
            "Date": F.lit("1995-03-01"),
            "Monthly_unique_counts": F.lit("5"),
            "Geographic_level_destination": F.lit("Region"),
        }
        faults = [
            {"Monthly_unique_counts": F.lit("-5")},
            {"Monthly_unique_counts": none},
            {"Date": F.lit("soon")},
            {"Destination": none},
            {"Destination_code": F.lit("RTO99"), "Geographic_level_destination": F.lit("RTO")},
        ]
        return self.raw_visitors.unionByName(self._spoiled(usual, faults))

    # --- typed sources and star -----------------------------------------------

    @cached_property
    def mapping(self) -> DataFrame:
        return clean_mapping(self.raw_mapping)

    @cached_property
    def locations(self) -> DataFrame:
        return location_dim(self.mapping, BANDS)

    @cached_property
    def types(self) -> DataFrame:
        return enum_dim(self.spark)

    @cached_property
    def spend(self) -> DataFrame:
        month = _month(F.col("day"))
        return self._items.where(_in_window(F.col("day")) & F.col("label").isNotNull()).select(
            F.col("code").alias("RTO_Code"),
            month.alias("Month"),
            F.concat(F.lit("Product "), _text("l_linenumber")).alias("Product"),
            recode("l_linestatus", STATUS_TYPES).alias("Visitor_type"),
            F.concat(F.lit("Market "), "l_returnflag").alias("Origin"),
            F.col("l_extendedprice").alias("Annual_Spend_Million"),
            (_amount() / 1e10).alias("Monthly_Spend_Million"),
        )

    @cached_property
    def nights(self) -> DataFrame:
        month = _month(F.col("day"))
        return self._items.where(_in_window(F.col("day")) & (_cents("l_discount") != SUPPRESSED_DISCOUNT)).select(
            F.col("code").alias("RTO_Code"),
            month.alias("Month"),
            F.concat(F.lit("Property "), _text("l_linenumber")).alias("Property"),
            recode("l_linestatus", STATUS_TYPES).alias("Visitor_type"),
            F.col("l_quantity").cast("bigint").alias("Total_stay_nights"),
        )

    @cached_property
    def visitors(self) -> DataFrame:
        return self._customer_months.select(
            (F.col("nation") + 1).alias("RTO_Code"), "Visitor_type", "Month", "Visitor_count"
        )

    @cached_property
    def fact(self) -> DataFrame:
        return conform_fact(self.spend, self.nights, self.visitors, self.locations, self.types)


def _emit(rows: DataFrame, plain: Column, extra: list[Column]) -> DataFrame:
    """One text row per line item, and the total rows with the first line of an order."""
    emitted = F.when(F.col("l_linenumber") == 1, F.array(plain, *extra)).otherwise(F.array(plain))
    return rows.select(F.inline(emitted))
