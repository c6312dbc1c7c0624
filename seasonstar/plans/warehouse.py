"""Raw CSV files → clean tables → star → reports and answers, as written tables.

Every stage reads the tables of the stage before, so a lost executor never
reaches back past the last written table. Nothing is deleted: raw files stay.

The clean tables are one set of versions, the star another: all tables of a set
are written beside the last version, checked, and published in one step, so a
killed job or a failed check leaves everything readable as it was. Row rules are
counted by the job that writes a table; uniqueness and references of several
tables are one more.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seasonstar.functions.calendar import date_key
from seasonstar.operators import analytics, clean, dims, quality
from seasonstar.operators import fact as facts
from seasonstar.operators.changes import cell_digests, changed_cells
from seasonstar.sources.layouts import (
    DOMESTIC,
    INTERNATIONAL,
    OTHER,
    TABLE_VIEWS,
    WINDOW,
    YEARS,
    ZONE_BANDS,
    MappingLayout,
    NightsLayout,
    SpendLayout,
    VisitorLayout,
    Window,
)
from seasonstar.sources.tables import MALFORMED, read_text_csv, rebuild_table
from seasonstar.sources.versions import ConflictError, Version, VersionedTables

GRAINS = {
    "mapping": [("RTO_Code",), (clean.MAPPING.name,), (clean.MAPPING.label_ascii,)],
    "visitors": [("RTO_Code", "Visitor_type", "Month")],
    "nights": [("RTO_Code", "Month", "Property", "Visitor_type")],
    "spend": [("RTO_Code", "Month", "Product", "Visitor_type", "Origin")],
    "months": [("DateKey",), ("MonthStartDate",)],
    "locations": [("LocationKey",), ("RTOCode",)],
    "fact": [("FactID",), facts.FACT_GRAIN],
}
ON_VIOLATION = ("fail", "quarantine")
#: Tables of a star version; all others belong to a version of the clean tables.
STAR = ("months", "locations", "visitor_types", "fact", "spend_detail", "cells")
SOURCES = ("spend", "nights", "visitors")


class LoadError(ValueError):
    """A table broke a declared rule; the table it should replace is unchanged."""


@dataclass(frozen=True)
class RawPaths:
    mapping: str
    visitors: str
    nights: str
    spend: str


def _counted(rows: DataFrame, name: str, fault: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("name"), F.lit(fault).alias("fault"), "n"
    )


class Warehouse:
    """The tables under one root folder (on a cluster: shared storage)."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        bands: Sequence[tuple[int, int, str]] = ZONE_BANDS,
        other_zone: str = OTHER,
        years: Sequence[int] = YEARS,
        hemisphere: str = "south",
    ) -> None:
        self.spark = spark
        self.root = root
        self.bands = bands
        self.other_zone = other_zone
        self.years = years
        self.hemisphere = hemisphere

        self.clean = VersionedTables(spark, os.path.join(root, "clean"))
        self.star = VersionedTables(spark, os.path.join(root, "star"))

    def path(self, table: str) -> str:
        """Where the current version wrote ``table``; ``table()`` also reads what it shares with others."""
        version = (self.star if table in STAR else self.clean).current()
        if version is None:
            raise LoadError("no star has been built" if table in STAR else "nothing has been loaded")
        return version.path(table)

    def version(self) -> str | None:
        """The star version published last."""
        current = self.star.current()
        return current and current.name

    def expire(self, keep: int = 2, unfinished_hours: float = 24.0) -> list[str]:
        """Remove old versions of both sets, and what killed jobs have left; see ``VersionedTables``."""
        return [n for tables in (self.clean, self.star) for n in tables.expire(keep, unfinished_hours)]

    def table(self, table: str) -> DataFrame:
        tables = self.star if table in STAR else self.clean
        version = tables.current()
        if version is None:
            raise LoadError("no star has been built" if table in STAR else "nothing has been loaded")
        return tables.read(version, table)

    # --- raw → clean ------------------------------------------------------------

    def load(
        self,
        raw: RawPaths,
        mapping_layout: MappingLayout = MappingLayout(),
        visitor_layout: VisitorLayout = VisitorLayout(),
        nights_layout: NightsLayout = NightsLayout(),
        spend_layout: SpendLayout = SpendLayout(),
        window: Window | None = WINDOW,
        visitor_window: Window | None = None,
        blank: str = "null",
        on_violation: str = "fail",
        multi_line: bool = False,
    ) -> None:
        """Clean all four sources, the mapping first since the others refer to it, all or nothing.

        ``on_violation="quarantine"`` loads the rows that pass their rules and
        keeps the others, with the failed rule names, under ``quarantine/``, and
        malformed records with their raw text under ``quarantine/<name>_records``.
        Otherwise either fails the load. Broken uniqueness or unknown area codes
        always do. If another load is published meanwhile, this one fails.
        """
        if on_violation not in ON_VIOLATION:
            raise ValueError(f"on_violation must be one of {ON_VIOLATION}, got {on_violation!r}")
        draft = self.clean.begin()

        def text(name: str, path: str, layout) -> DataFrame:
            if on_violation == "fail":
                return read_text_csv(self.spark, path, layout.columns, multi_line=multi_line)
            records = read_text_csv(
                self.spark, path, layout.columns, on_malformed="capture", multi_line=multi_line
            )
            broken = records.where(F.col(MALFORMED).isNotNull())
            rebuild_table(broken, draft.path(f"quarantine/{name}_records"))
            return records.where(F.col(MALFORMED).isNull()).drop(MALFORMED)

        def build(name: str, frame: DataFrame, rules: list[quality.Rule]) -> DataFrame:
            options = {"sort_by": ["RTO_Code"]}
            if name != "mapping":
                options = {"partition_by": ["Year"], "sort_by": ["RTO_Code", "Month"]}
            if on_violation == "quarantine":
                parsed = rebuild_table(frame, draft.path(f"parsed/{name}"))
                frame, failed = quality.quarantine(parsed, rules)
                rebuild_table(failed, draft.path(f"quarantine/{name}"))
                rules = []
            if name != "mapping":
                frame = frame.withColumn("Year", F.year("Month"))
            return self._build(draft, name, frame, rules, **options)

        mapping = clean.clean_mapping(text("mapping", raw.mapping, mapping_layout), mapping_layout)
        mapping = build("mapping", mapping, quality.mapping_rules())
        self._verify({"mapping": mapping}, {})
        visitors = clean.clean_visitors(
            text("visitors", raw.visitors, visitor_layout), visitor_layout, visitor_window
        )
        nights = clean.clean_nights(
            text("nights", raw.nights, nights_layout), mapping, nights_layout, window, blank
        )
        spend = clean.clean_spend(text("spend", raw.spend, spend_layout), mapping, spend_layout, window)
        tables = {
            "visitors": build("visitors", visitors, quality.visitor_rules()),
            "nights": build("nights", nights, quality.nights_rules()),
            "spend": build("spend", spend, quality.spend_rules()),
        }
        self._verify(tables, dict.fromkeys(tables, [("RTO_Code", mapping, "RTO_Code")]))
        self._publish(self.clean, draft)

    # --- clean → star -----------------------------------------------------------

    def build_star(self, refresh_years: Sequence[int] | None = None) -> None:
        """Dimensions and facts from one version of the clean tables, all or nothing.

        With ``refresh_years`` only those years of the facts are computed again,
        after revised months have been loaded, and the other years are taken over
        from the last version; the dimensions are always rebuilt. A year that no
        source holds any more leaves no row. Only a version that passes every
        check is published; the versions before stay on storage until ``expire``.
        A load that is published meanwhile does not change what is read here, and
        a star that is published meanwhile fails this one.
        """
        loaded = self.clean.current()
        if loaded is None:
            raise LoadError("nothing has been loaded")
        sources = {name: self.clean.read(loaded, name) for name in SOURCES}
        last = self.star.current()
        draft = self.star.begin(clean=loaded.name)
        months, locations, types = self._dimensions(draft, loaded, sources)
        renewed = F.lit(True)
        if refresh_years is not None and last is not None:
            renewed = F.col("Year").isin(*refresh_years)
            sources = {name: frame.where(renewed) for name, frame in sources.items()}
        fact = facts.conform_fact(**sources, locations=locations, types=types, months=months)
        detail = facts.build_spend_detail(sources["spend"], locations, types, months)
        tables = {"months": months, "locations": locations}
        for name, frame in (("fact", fact), ("spend_detail", detail)):
            whole = facts.with_calendar(frame).drop("MonthNumber")
            if refresh_years is not None and last is not None:
                kept = self.star.read(last, name).where(~renewed)
                whole = whole.unionByName(kept.withColumn("Year", F.col("Year").cast("int")))
            rules = [quality.not_null("FactID")] if name == "fact" else []
            tables[name] = self._build(
                draft, name, whole, rules, partition_by=["Year"], sort_by=["LocationKey", "DateKey"]
            )
        self._verify_star(tables, types)
        self._publish(self.star, draft)

    def refresh_star(self) -> list[int]:
        """Bring the star up to the current clean tables, summing only what has changed; the years
        that were written.

        A digest of every area and month of the sources is kept with the star. Cells whose digest
        differs from the last one are summed again and merged into the partitions of their years;
        partitions of other years are neither read nor written but shared with the version that
        has them. The result equals that of ``build_star``, since sums do not depend on order, and
        is all or nothing like it. Finding the changes reads the clean tables once and shuffles a
        row per cell and task. All years are built when there is no star, or it holds no digests,
        or other visitor types.
        """
        loaded = self.clean.current()
        if loaded is None:
            raise LoadError("nothing has been loaded")
        sources = {name: self.clean.read(loaded, name) for name in SOURCES}
        last = self.star.current()
        draft = self.star.begin(clean=loaded.name)
        months, locations, types = self._dimensions(draft, loaded, sources)
        cells = rebuild_table(cell_digests(sources), draft.path("cells"))
        whole = last is None or not self.star.holds(last, "cells") or self._differ(last, types)
        if whole:
            changed = cells.select("RTO_Code", "Month")
        else:
            changed = changed_cells(self.star.read(last, "cells"), cells)
        changed = rebuild_table(changed.withColumn("Year", F.year("Month")), draft.path("changed"))
        # at most as many as the calendar has
        years = sorted(row.Year for row in changed.select("Year").distinct().collect())
        if not years and not whole:
            # an empty refresh still publishes the new dimensions
            draft.parts.update({n: self.star.partitions(last, n) for n in ("fact", "spend_detail")})
            self._verify({"months": months, "locations": locations}, {})
            self._publish(self.star, draft)
            return years
        if not whole:
            touched = F.col("Year").isin(years)
            sources = {
                name: frame.where(touched).join(changed.drop("Year"), ["RTO_Code", "Month"], "left_semi")
                for name, frame in sources.items()
            }
        fact = facts.conform_fact(**sources, locations=locations, types=types, months=months)
        detail = facts.build_spend_detail(sources["spend"], locations, types, months)
        # an area's key is its code in every version of the dimension
        renewed = changed.select(date_key(F.col("Month")).alias("DateKey"), F.col("RTO_Code").alias("LocationKey"))
        tables = {"months": months, "locations": locations}
        for name, frame in (("fact", fact), ("spend_detail", detail)):
            merged = facts.with_calendar(frame).drop("MonthNumber")
            if not whole:
                kept = self.star.read(last, name).where(F.col("Year").isin(years))
                kept = kept.join(renewed, ["DateKey", "LocationKey"], "left_anti")
                merged = merged.unionByName(kept.withColumn("Year", F.col("Year").cast("int")))
            rules = [quality.not_null("FactID")] if name == "fact" else []
            tables[name] = self._build(
                draft, name, merged, rules, partition_by=["Year"], sort_by=["LocationKey", "DateKey"]
            )
            if not whole:
                shared = {
                    folder: [year for year in held if year not in years]
                    for folder, held in self.star.partitions(last, name).items()
                }
                parts = {folder: held for folder, held in shared.items() if held}
                draft.parts[name] = parts | self.star.partitions(draft, name)
        # a grain holds the month, and the sources of shared partitions are as they were
        self._verify_star(tables, types)
        self._publish(self.star, draft)
        return years

    def _differ(self, last: Version, types: DataFrame) -> bool:
        """Whether the list of visitor types, a literal of the code, is another than that of ``last``."""
        columns = types.columns
        before = self.star.read(last, "visitor_types").select(*columns)
        return sorted(before.collect()) != sorted(types.select(*columns).collect())

    def _dimensions(
        self, draft: Version, loaded: Version, sources: dict[str, DataFrame]
    ) -> tuple[DataFrame, DataFrame, DataFrame]:
        months = dims.month_dim(*sources.values(), hemisphere=self.hemisphere)
        months = self._build(draft, "months", months, quality.month_rules(), sort_by=["DateKey"])
        mapping = self.clean.read(loaded, "mapping")
        locations = dims.location_dim(mapping, self.bands, self.other_zone)
        locations = self._build(
            draft, "locations", locations, quality.location_rules(), sort_by=["LocationKey"]
        )
        return months, locations, self._build(draft, "visitor_types", dims.enum_dim(self.spark), [])

    def _verify_star(self, tables: dict[str, DataFrame], types: DataFrame) -> None:
        parents = [
            ("DateKey", tables["months"], "DateKey"),
            ("LocationKey", tables["locations"], "LocationKey"),
            ("VisitorTypeKey", types, "VisitorTypeKey"),
        ]
        self._verify(tables, {"fact": parents, "spend_detail": parents})

    # --- writing and checks -----------------------------------------------------

    def _build(
        self, draft: Version, name: str, frame: DataFrame, rules: list[quality.Rule], **options
    ) -> DataFrame:
        """Write a table of a draft, counting broken rules on the way."""
        path = draft.path(name)
        if not rules:
            return rebuild_table(frame, path, **options)
        seen = Observation()
        broken = [F.count_if(rule.violated).alias(f"r{i}") for i, rule in enumerate(rules)]
        written = rebuild_table(frame.observe(seen, *broken), path, **options)
        try:
            suspect = any(seen.get.values())
        except Py4JJavaError:  # an input found empty while it ran leaves no metrics
            suspect = True
        if suspect:
            # a task that ran twice may have counted twice: the numbers to report are counted again
            found = quality.rule_violations(written, rules).where("Violations > 0").collect()
            if found:
                raise LoadError(f"{name}: " + ", ".join(f"{r.Rule} ({r.Violations})" for r in found))
        return written

    def _verify(
        self,
        tables: dict[str, DataFrame],
        parents: dict[str, list[tuple[str, DataFrame, str]]],
    ) -> None:
        """Uniqueness and references of all ``tables`` in one job."""
        counts = []
        for name, frame in tables.items():
            for grain in GRAINS.get(name, ()):
                # A unique constraint lets NULLs repeat.
                known = frame.dropna(subset=list(grain))
                fault = f"duplicate values of {', '.join(grain)}"
                counts.append(_counted(quality.duplicates(known, grain), name, fault))
            for key, parent, parent_key in parents.get(name, ()):
                unknown = quality.orphans(frame, key, parent, parent_key)
                counts.append(_counted(unknown, name, f"values of {key} without a parent row"))
        found = reduce(DataFrame.unionAll, counts).where("n > 0").collect()
        if found:
            raise LoadError("; ".join(f"{r.name}: {r.n} {r.fault}" for r in found))

    def _publish(self, tables: VersionedTables, draft: Version) -> None:
        try:
            tables.publish(draft)
        except ConflictError as error:
            raise LoadError(str(error)) from error

    # --- reading ----------------------------------------------------------------

    def register_views(self) -> None:
        """Temporary views under the customary table names, for SQL users."""
        for table, view in TABLE_VIEWS.items():
            self.table(table).createOrReplaceTempView(view)

    def _sources(self) -> dict[str, DataFrame]:
        return {
            "SpendData": self.table("spend"),
            "GuestNightData": self.table("nights"),
            "VisitorCountData": self.table("visitors"),
        }

    def reports(self) -> dict[str, DataFrame]:
        """Validation reports on the star."""
        fact, locations, types = (self.table(n) for n in ("fact", "locations", "visitor_types"))
        sources = self._sources()
        return {
            "months": self.table("months").orderBy("DateKey"),
            "locations": locations.drop("LocationKey").orderBy("RTOCode"),
            "visitor_types": types,
            "fact_sample": quality.fact_sample(fact, locations, types),
            "missing_measures": quality.missing_measures(fact),
            "coverage_by_area": quality.coverage_by_area(fact, locations),
            "areas_represented": quality.areas_represented(fact, locations),
            "month_completeness": quality.month_completeness(sources, self.table("months")),
            "coverage_gaps": quality.coverage_gaps(
                sources["SpendData"], self.table("months"), locations
            ),
        }

    def answers(self) -> dict[str, DataFrame]:
        """The three questions and their summaries."""
        fact, locations, types = (self.table(n) for n in ("fact", "locations", "visitor_types"))
        profile = analytics.seasonality_profile(fact, locations, years=self.years)
        summary = analytics.seasonality_summary(profile)
        changes = analytics.counter_demand_changes(fact, locations, types, years=self.years)
        scores = analytics.exposure_score(fact, locations, types, years=self.years)
        series = (("VisitorCount", INTERNATIONAL), ("SpendMillion", DOMESTIC))
        return {
            "seasonality_index": analytics.seasonality_index(fact, locations, years=self.years),
            "seasonality_summary": summary,
            "top_seasonal_areas": analytics.top_seasonal_areas(summary),
            "counter_demand": analytics.counter_demand(
                fact, locations, types, years=self.years
            ),
            "counter_demand_summary": analytics.counter_demand_summary(changes),
            "exposure_score": scores,
            "top_exposed_areas": analytics.top_exposed_areas(scores),
            "index_to_own_mean": analytics.measure_index(
                fact, locations, types, series, years=self.years
            ),
        }
