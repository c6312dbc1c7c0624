"""Raw text sources to clean, typed tables.

Each source is first *standardised*: one narrow step that types the text
and marks the rows the load keeps (``Kept``), so that cleaning,
reconciliation and the unmatched-key report share one definition. Rows that
are not kept can be left out before their text is parsed, and filters on parsed
columns run on the parsed values. Nothing here shuffles the raw rows while the
area mapping measures small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonstar.functions.text import (
    last_chars,
    lenient_int,
    lenient_real,
    month_start,
    null_text,
    recode,
    remove_all,
    strip_suffix,
    trimmed,
)
from seasonstar.operators.joins import dim_join
from seasonstar.sources.layouts import (
    WINDOW,
    MappingLayout,
    NightsLayout,
    SpendLayout,
    VisitorLayout,
    Window,
)

MAPPING = MappingLayout()

_BLANKS = ("null", "zero")
#: Reasons of rows that pass all filters and are not loaded.
UNKNOWN_AREA, OUTSIDE = "area unknown", "outside the window"


def _raw(name: str) -> Column:
    return F.col(f"`{name}`")


def _in_window(window: Window | None) -> Column:
    """Month inside the window; a NULL month is outside. No window keeps every row."""
    if window is None:
        return F.lit(True)
    low, high = window
    return F.coalesce(F.col("Month").between(F.lit(low), F.lit(high)), F.lit(False))


def _parsed_once(
    raw: DataFrame, filters: dict[str, Column], kept_only: bool, trace: bool, *columns: Column
) -> DataFrame:
    """``columns`` and ``Kept`` of each row, or of the kept rows only, which pass all ``filters``.

    The columns come out of a generator with one row per row. Filters on its output stay above
    it, where they would otherwise be moved to the scan and parse each text again. ``trace``
    adds ``Failed``, the name of the first filter a row fails, and the row itself as ``Raw``.
    """
    kept = reduce(Column.__and__, filters.values())
    rows = raw.where(kept) if kept_only else raw
    flag = F.lit(True) if kept_only else F.coalesce(kept, F.lit(False))
    extra = []
    if trace:
        failed = [F.when(F.coalesce(~f, F.lit(True)), F.lit(name)) for name, f in filters.items()]
        extra = [
            F.coalesce(*failed).alias("Failed"),
            F.struct(*[_raw(name) for name in raw.columns]).alias("Raw"),
        ]
    return rows.select(F.inline(F.array(F.struct(*columns, flag.alias("Kept"), *extra))))


def clean_mapping(raw: DataFrame, layout: MappingLayout = MAPPING) -> DataFrame:
    """Area reference table; the text ``null`` becomes NULL, and so does a code beyond INT,
    which the rule that codes are present then reports."""
    return raw.select(
        lenient_int(_raw(layout.code)).try_cast("int").alias("RTO_Code"),
        trimmed(_raw(layout.name)).alias(MAPPING.name),
        null_text(_raw(layout.name_ascii)).alias(MAPPING.name_ascii),
        null_text(_raw(layout.label)).alias(MAPPING.label),
        null_text(_raw(layout.label_ascii)).alias(MAPPING.label_ascii),
    )


def area_keys(mapping: DataFrame, column: str) -> DataFrame:
    """``AreaKey`` → ``RTO_Code`` by one of the mapping's columns; areas without that key drop out."""
    return mapping.where(F.col(column).isNotNull()).select(F.col(column).alias("AreaKey"), "RTO_Code")


def standardise_visitors(
    raw: DataFrame,
    layout: VisitorLayout = VisitorLayout(),
    kept_only: bool = False,
    trace: bool = False,
) -> DataFrame:
    code = lenient_int(last_chars(trimmed(_raw(layout.code)), 2)).try_cast("int")
    filters = {
        "area level": trimmed(_raw(layout.level)) == layout.level_kept,
        "visitor type": trimmed(_raw(layout.segment)).isin(*layout.types),
    }
    return _parsed_once(
        raw,
        filters,
        kept_only,
        trace,
        code.alias("AreaKey"),
        remove_all(_raw(layout.destination), layout.suffix).alias("Destination"),
        recode(_raw(layout.segment), layout.types).alias("Visitor_type"),
        month_start(_raw(layout.date)).alias("Month"),
        lenient_int(_raw(layout.count)).alias("Visitor_count"),
    )


def clean_visitors(
    raw: DataFrame, layout: VisitorLayout = VisitorLayout(), window: Window | None = None
) -> DataFrame:
    """Visitor counts. The area code comes from the text itself; check it with ``orphans``."""
    rows = standardise_visitors(raw, layout, kept_only=True)
    return rows.where(_in_window(window)).select(
        F.col("AreaKey").alias("RTO_Code"), "Destination", "Visitor_type", "Month", "Visitor_count"
    )


def standardise_nights(
    raw: DataFrame,
    layout: NightsLayout = NightsLayout(),
    blank: str = "null",
    kept_only: bool = False,
    trace: bool = False,
) -> DataFrame:
    """Guest nights; a blank value is NULL, or 0 with ``blank="zero"``."""
    if blank not in _BLANKS:
        raise ValueError(f"blank must be one of {_BLANKS}, got {blank!r}")
    value = _raw(layout.value)
    nights = lenient_int(value)
    if blank == "null":
        nights = F.when(trimmed(value) != "", nights)
    filters = {
        "area level": trimmed(_raw(layout.level)) == layout.level_kept,
        "area excluded": trimmed(_raw(layout.area)) != layout.national_area,
        "total of properties": trimmed(_raw(layout.property_type)) != layout.total_property,
        "visitor type": trimmed(_raw(layout.measure)).isin(*layout.types),
        "suppressed": F.coalesce(trimmed(_raw(layout.flag)), F.lit("")) != layout.suppressed,
    }
    return _parsed_once(
        raw,
        filters,
        kept_only,
        trace,
        strip_suffix(_raw(layout.area), layout.suffix).alias("AreaKey"),
        month_start(_raw(layout.month)).alias("Month"),
        trimmed(_raw(layout.property_type)).alias("Property"),
        recode(_raw(layout.measure), layout.types).alias("Visitor_type"),
        nights.alias("Total_stay_nights"),
    )


def clean_nights(
    raw: DataFrame,
    mapping: DataFrame,
    layout: NightsLayout = NightsLayout(),
    window: Window | None = WINDOW,
    blank: str = "null",
) -> DataFrame:
    """Guest nights of the mapped areas (matched on area name), suppressed rows left out."""
    rows = standardise_nights(raw, layout, blank, kept_only=True)
    return conform_to_dim(rows, area_keys(mapping, MAPPING.name), window).select(
        "RTO_Code", "Month", "Property", "Visitor_type", "Total_stay_nights"
    )


def standardise_spend(
    raw: DataFrame,
    layout: SpendLayout = SpendLayout(),
    kept_only: bool = False,
    trace: bool = False,
) -> DataFrame:
    filters = {
        "area excluded": ~trimmed(_raw(layout.area)).isin(*layout.excluded_areas),
        "visitor type": trimmed(_raw(layout.type)).isin(*layout.types),
    }
    return _parsed_once(
        raw,
        filters,
        kept_only,
        trace,
        trimmed(_raw(layout.area)).alias("AreaKey"),
        month_start(_raw(layout.month)).alias("Month"),
        trimmed(_raw(layout.product)).alias("Product"),
        recode(_raw(layout.type), layout.types).alias("Visitor_type"),
        trimmed(_raw(layout.origin)).alias("Origin"),
        lenient_real(trimmed(_raw(layout.annual))).alias("Annual_Spend_Million"),
        lenient_real(trimmed(_raw(layout.monthly))).alias("Monthly_Spend_Million"),
    )


def clean_spend(
    raw: DataFrame,
    mapping: DataFrame,
    layout: SpendLayout = SpendLayout(),
    window: Window | None = WINDOW,
) -> DataFrame:
    """Spending of the mapped areas (matched on ASCII label)."""
    rows = standardise_spend(raw, layout, kept_only=True)
    return conform_to_dim(rows, area_keys(mapping, MAPPING.label_ascii), window).select(
        "RTO_Code",
        "Month",
        "Product",
        "Visitor_type",
        "Origin",
        "Annual_Spend_Million",
        "Monthly_Spend_Million",
    )


def conform_to_dim(rows: DataFrame, keys: DataFrame, window: Window | None = None) -> DataFrame:
    """Kept rows of a standardised source whose ``AreaKey`` is known, with its ``RTO_Code``."""
    return dim_join(rows.where(F.col("Kept") & _in_window(window)), keys, ["AreaKey"])


def unmatched_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Kept rows that the inner join would drop, counted per key (NULL keys included)."""
    counts = rows.where("Kept").groupBy("AreaKey").agg(F.count(F.lit(1)).alias("Rows"))
    return counts.join(keys, "AreaKey", "left_anti")


def reconcile_rows(rows: DataFrame, keys: DataFrame, window: Window | None = None) -> DataFrame:
    """Raw → kept → matched → loaded row counts in one pass over the source.

    Rows are counted per key before the join, so the join sees distinct keys.
    """
    counts = (
        rows.select("AreaKey", "Kept", _in_window(window).alias("InWindow"))
        .groupBy("AreaKey", "Kept", "InWindow")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    matched = counts.join(keys.withColumn("Matched", F.lit(True)), "AreaKey", "left")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return matched.agg(
        total(F.lit(True)).alias("RawRows"),
        total(F.col("Kept")).alias("KeptRows"),
        total(F.col("Kept") & F.col("Matched")).alias("MatchedRows"),
        total(F.col("Kept") & F.col("Matched") & F.col("InWindow")).alias("LoadedRows"),
    )


def dropped_rows(rows: DataFrame, keys: DataFrame, window: Window | None = None) -> DataFrame:
    """Every row that the load leaves out, as it was read (``Raw``), with the ``Reason``.

    ``rows`` come from a standardise function with ``trace=True``. The reason is the first filter
    that a row fails, in the order of the filters (a filter on a missing value fails), then an
    area key the mapping does not have, then a month outside the window or missing; so the counts
    per reason add up to the steps of ``reconcile_rows``. One pass, joined as the load joins.
    """
    known = keys.withColumnRenamed("RTO_Code", "__code").withColumn("__known", F.lit(True))
    reason = F.coalesce(
        F.col("Failed"),
        F.when(F.col("__known").isNull(), F.lit(UNKNOWN_AREA)),
        F.when(~_in_window(window), F.lit(OUTSIDE)),
    )
    joined = dim_join(rows, known, ["AreaKey"], how="left")
    return joined.select(reason.alias("Reason"), "AreaKey", "Month", "Raw").where("Reason IS NOT NULL")


def drop_reasons(dropped: DataFrame) -> DataFrame:
    """Rows per reason of ``dropped_rows``."""
    return dropped.groupBy("Reason").agg(F.count(F.lit(1)).alias("Rows"))


def near_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Unmatched text keys that are canonically equal to a known one, with that key and its area.

    A letter with a mark can be one character or two (``ō`` or ``o`` and U+0304), which look the
    same and do not match. Only distinct unmatched keys are compared, under Unicode collation;
    a key that differs in letter, mark, case or width is another key.
    """
    lost = unmatched_keys(rows, keys).withColumn("__same", F.collate("AreaKey", "UNICODE"))
    known = keys.select(
        F.collate("AreaKey", "UNICODE").alias("__same"), F.col("AreaKey").alias("KnownKey"), "RTO_Code"
    )
    return lost.join(known, "__same").select("AreaKey", "KnownKey", "RTO_Code", "Rows")
