"""The registered queries: every operator run over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonstar.functions import text
from seasonstar.functions.numeric import round_half_up
from seasonstar.operators import analytics, clean, dims, quality
from seasonstar.operators import fact as facts
from seasonstar.operators.selection import exact_median
from seasonstar.plans import demo
from seasonstar.plans.demo import Demo
from seasonstar.sources.layouts import DOMESTIC, INTERNATIONAL, VisitorLayout
from seasonstar.sources.tables import read_text_csv, rebuild_table, shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(query: Callable[[Demo], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(Demo(spark, sf_dir))

    run.__name__ = query.__name__
    run.__doc__ = query.__doc__
    return run


def _with_source(name: str, frame: DataFrame) -> DataFrame:
    return frame.select(F.lit(name).alias("Source"), "*")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- text functions over whole texts --------------------------------------------


def text_parts(d: Demo) -> DataFrame:
    body = F.col("text")
    return d.table("documents").select(
        "doc_id",
        text.last_chars(text.trimmed(body), 2).alias("last_two"),
        text.strip_suffix(body, ".").alias("no_stop"),
        text.remove_all(body, " de").alias("no_de"),
        F.instr(body, "/").cast("int").alias("slash_at"),
        text.null_text("lang", "fr").alias("lang_not_fr"),
        text.recode("lang", {"en": "English", "de": "German"}).alias("language"),
        text.lenient_int(body).alias("leading_int"),
        text.lenient_real(body).alias("leading_real"),
    )


def lenient_numbers(d: Demo) -> DataFrame:
    """Numbers read back from several text forms of account balances."""
    plain = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    forms = {
        "plain": plain,
        "padded": F.concat(F.lit("\t "), plain, F.lit(" ")),
        "unit": F.concat(plain, F.lit(" million")),
        "exponent": F.concat(plain, F.lit("e2")),
        "signed": F.concat(F.lit("+"), F.abs(F.col("c_acctbal")).cast("decimal(12,2)").cast("string")),
        "currency": F.concat(F.lit("$"), plain),
        "empty": F.replace(plain, plain, F.lit("")),
    }
    columns = []
    for name, form in forms.items():
        columns.append(text.lenient_int(form).alias(f"int_{name}"))
        columns.append(text.lenient_real(form).alias(f"real_{name}"))
    return d.table("customer").select("c_custkey", *columns)


def month_starts(d: Demo) -> DataFrame:
    """Order months read back from one text form per order priority."""
    day = F.col("o_orderdate").cast("date")
    number, month, year = F.dayofmonth(day), F.month(day), F.year(day)
    priority = F.left("o_orderpriority", F.lit(1))
    form = (
        F.when(priority == "1", F.format_string("%d/%d/%d", number, month, year))
        .when(priority == "2", F.format_string("  31/%02d/%d ", month, year))
        .when(priority == "3", F.concat(day.cast("string"), F.lit(" 10:30")))
        .when(priority == "4", F.concat(F.lit(" "), day.cast("string")))
        .otherwise(F.format_string("%d%02d", year, month))
    )
    return d.table("orders").select(
        "o_orderkey", text.month_start(form).alias("order_month")
    )


# --- cleaning ---------------------------------------------------------------------


def clean_mapping(d: Demo) -> DataFrame:
    return d.mapping


def clean_visitors(d: Demo) -> DataFrame:
    return clean.clean_visitors(d.raw_visitors)


def visitors_from_csv(d: Demo) -> DataFrame:
    """The visitor source written as CSV text, read back, cleaned, and stored by year."""
    folder = shared_folder(d.spark, "visitors")
    d.raw_visitors.write.options(header=True, escape='"').csv(f"{folder}/raw")
    layout = VisitorLayout()
    rows = clean.clean_visitors(read_text_csv(d.spark, f"{folder}/raw", layout.columns), layout)
    return rebuild_table(
        rows.withColumn("Year", F.year("Month")),
        f"{folder}/clean",
        partition_by=["Year"],
        sort_by=["RTO_Code", "Month"],
    )


def clean_nights(d: Demo) -> DataFrame:
    return clean.clean_nights(
        d.raw_nights, d.mapping, demo.NIGHTS_LAYOUT, demo.WINDOW
    )


def clean_spend(d: Demo) -> DataFrame:
    return clean.clean_spend(
        d.raw_spend, d.mapping, demo.SPEND_LAYOUT, demo.WINDOW
    )


def _standardised(d: Demo, trace: bool = False):
    """Source, with spoiled rows added → (standardised rows, area keys, load window)."""
    mapping = d.mapping
    codes = mapping.select(F.col("RTO_Code").alias("AreaKey"), "RTO_Code")
    return {
        "nights": (
            clean.standardise_nights(d.spoiled_nights, demo.NIGHTS_LAYOUT, trace=trace),
            clean.area_keys(mapping, clean.MAPPING.name),
            demo.WINDOW,
        ),
        "spend": (
            clean.standardise_spend(d.spoiled_spend, demo.SPEND_LAYOUT, trace=trace),
            clean.area_keys(mapping, clean.MAPPING.label_ascii),
            demo.WINDOW,
        ),
        "visitors": (clean.standardise_visitors(d.spoiled_visitors, trace=trace), codes, None),
    }


def unmatched_keys(d: Demo) -> DataFrame:
    return _union(
        [
            _with_source(
                name, clean.unmatched_keys(rows, keys).withColumn("AreaKey", F.col("AreaKey").cast("string"))
            )
            for name, (rows, keys, _) in _standardised(d).items()
        ]
    )


def reconcile_rows(d: Demo) -> DataFrame:
    return _union(
        [
            _with_source(name, clean.reconcile_rows(rows, keys, window))
            for name, (rows, keys, window) in _standardised(d).items()
        ]
    )


def drop_reasons(d: Demo) -> DataFrame:
    """How many rows of each source are left out, by the first reason."""
    return _union(
        [
            _with_source(name, clean.drop_reasons(clean.dropped_rows(rows, keys, window)))
            for name, (rows, keys, window) in _standardised(d, trace=True).items()
        ]
    )


def near_keys(d: Demo) -> DataFrame:
    """Guest nights whose area names end in a macron, written in one character, in two, or left out."""
    one, two = "\u014d", "o\u0304"
    end = (
        F.when(text.lenient_int("Value") % 3 == 0, one)
        .when(text.lenient_int("Value") % 3 == 1, two)
        .otherwise("o")
    )
    area = clean.strip_suffix(F.col("Area"), demo.NIGHTS_LAYOUT.suffix)
    raw = d.spoiled_nights.withColumn("Area", F.concat(area, end))
    keys = clean.area_keys(d.mapping, clean.MAPPING.name)
    keys = keys.withColumn("AreaKey", F.concat("AreaKey", F.lit(one)))
    return clean.near_keys(clean.standardise_nights(raw, demo.NIGHTS_LAYOUT), keys)


# --- star ---------------------------------------------------------------------------


def month_dim(d: Demo) -> DataFrame:
    return dims.month_dim(d.spend, d.nights, d.visitors)


def location_dim(d: Demo) -> DataFrame:
    return d.locations


def visitor_type_dim(d: Demo) -> DataFrame:
    """The enumeration with the number of fact rows that use each entry."""
    used = d.fact.groupBy("VisitorTypeKey").agg(F.count(F.lit(1)).alias("FactRows"))
    return d.types.join(used, "VisitorTypeKey", "left")


def conform_fact(d: Demo) -> DataFrame:
    return d.fact


def conform_fact_join_form(d: Demo) -> DataFrame:
    return facts.conform_fact_join_form(
        d.spend,
        d.nights,
        d.visitors,
        d.locations,
        d.types,
    )


def spend_detail(d: Demo) -> DataFrame:
    return facts.build_spend_detail(
        d.spend, d.locations, d.types
    )


# --- quality ------------------------------------------------------------------------


def fact_sample(d: Demo) -> DataFrame:
    return quality.fact_sample(d.fact, d.locations, d.types)


def missing_measures(d: Demo) -> DataFrame:
    return quality.missing_measures(d.fact)


def coverage_by_area(d: Demo) -> DataFrame:
    return quality.coverage_by_area(d.fact, d.locations)


def areas_represented(d: Demo) -> DataFrame:
    return quality.areas_represented(d.fact, d.locations)


def _sources(d: Demo) -> dict[str, DataFrame]:
    return {
        "SpendData": d.spend,
        "GuestNightData": d.nights,
        "VisitorCountData": d.visitors,
    }


def month_completeness(d: Demo) -> DataFrame:
    return quality.month_completeness(_sources(d))


def coverage_gaps(d: Demo) -> DataFrame:
    months = dims.month_dim(d.spend, d.nights, d.visitors)
    return quality.coverage_gaps(d.spend, months, d.locations)


def duplicate_grain(d: Demo) -> DataFrame:
    return quality.duplicates(d.table("lineitem"), ["l_orderkey", "l_linenumber"])


def orphan_keys(d: Demo) -> DataFrame:
    """Foreign keys of the sales tables, and orders that no line item refers to."""
    table = {
        name: d.table(name)
        for name in ("customer", "orders", "lineitem", "part", "supplier", "labels", "documents")
    }
    relations = (
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("orders", "o_orderkey", "lineitem", "l_orderkey"),
        ("customer", "c_custkey", "orders", "o_custkey"),
        ("documents", "doc_id", "labels", "doc_id"),
    )
    return _union(
        [
            quality.orphans(table[child], key, table[parent], parent_key)
            .agg(
                F.count(F.lit(1)).alias("OrphanKeys"),
                F.coalesce(F.sum("Rows"), F.lit(0)).alias("OrphanRows"),
            )
            .select(F.lit(f"{child}.{key} in {parent}").alias("Relation"), "*")
            for child, key, parent, parent_key in relations
        ]
    )


def rule_violations(d: Demo) -> DataFrame:
    """Load rules on everything the sources hold before filtering, and a balance rule."""
    rows = _standardised(d)
    code = F.col("AreaKey").alias("RTO_Code")
    checked = {
        "nights": (rows["nights"][0].select(code, "*"), quality.nights_rules()),
        "spend": (rows["spend"][0].select(code, "*"), quality.spend_rules()),
        "visitors": (rows["visitors"][0].select(code, "*"), quality.visitor_rules()),
        "customer": (
            d.table("customer"),
            [quality.not_null("c_custkey"), quality.in_range("c_acctbal", 0)],
        ),
    }
    return _union(
        [
            _with_source(name, quality.rule_violations(frame, rules))
            for name, (frame, rules) in checked.items()
        ]
    )


def quarantined_rows(d: Demo) -> DataFrame:
    """Customers that fail a rule, with the names of the failed rules."""
    rules = [
        quality.in_range("c_acctbal", 0),
        quality.in_domain("c_mktsegment", ("BUILDING", "HOUSEHOLD", "AUTOMOBILE", "MACHINERY")),
    ]
    _, failed = quality.quarantine(d.table("customer"), rules)
    return failed.select("c_custkey", F.concat_ws("; ", "FailedRules").alias("FailedRules"))


# --- analytics ----------------------------------------------------------------------


def _profile(d: Demo) -> DataFrame:
    return analytics.seasonality_profile(
        d.fact, d.locations, years=demo.YEARS
    )


def seasonality_index(d: Demo) -> DataFrame:
    return analytics.seasonality_index(
        d.fact, d.locations, years=demo.YEARS
    )


def seasonality_summary(d: Demo) -> DataFrame:
    return analytics.seasonality_summary(_profile(d))


def top_seasonal_areas(d: Demo) -> DataFrame:
    return analytics.top_seasonal_areas(analytics.seasonality_summary(_profile(d)))


def counter_demand(d: Demo) -> DataFrame:
    return analytics.counter_demand(
        d.fact, d.locations, d.types, years=demo.YEARS
    )


def counter_demand_summary(d: Demo) -> DataFrame:
    return analytics.counter_demand_summary(
        analytics.counter_demand_changes(
            d.fact, d.locations, d.types, years=demo.YEARS
        )
    )


def exposure_score(d: Demo) -> DataFrame:
    return analytics.exposure_score(
        d.fact, d.locations, d.types, years=demo.YEARS
    )


def top_exposed_areas(d: Demo) -> DataFrame:
    return analytics.top_exposed_areas(exposure_score(d))


def spend_median(d: Demo) -> DataFrame:
    """The middle spending row of each visitor type and origin, of which a few hold all rows."""
    keys = ["Visitor_type", "Origin"]
    medians = exact_median(d.spend, keys, "Monthly_Spend_Million", "MedianMillion")
    return medians.withColumn("MedianMillion", round_half_up(F.col("MedianMillion"), 9))


def index_to_own_mean(d: Demo) -> DataFrame:
    """International visitors and domestic spending, each against its own average month."""
    series = (("VisitorCount", INTERNATIONAL), ("SpendMillion", DOMESTIC))
    return analytics.measure_index(d.fact, d.locations, d.types, series, years=demo.YEARS)


QUERIES: dict[str, Query] = {
    query.__name__: _on_tables(query)
    for query in (
        text_parts,
        lenient_numbers,
        month_starts,
        clean_mapping,
        clean_visitors,
        visitors_from_csv,
        clean_nights,
        clean_spend,
        unmatched_keys,
        reconcile_rows,
        drop_reasons,
        near_keys,
        month_dim,
        location_dim,
        visitor_type_dim,
        conform_fact,
        conform_fact_join_form,
        spend_detail,
        fact_sample,
        missing_measures,
        coverage_by_area,
        areas_represented,
        month_completeness,
        coverage_gaps,
        duplicate_grain,
        orphan_keys,
        rule_violations,
        quarantined_rows,
        seasonality_index,
        seasonality_summary,
        top_seasonal_areas,
        counter_demand,
        counter_demand_summary,
        exposure_score,
        top_exposed_areas,
        spend_median,
        index_to_own_mean,
    )
}
