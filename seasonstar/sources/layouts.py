"""Fixed layouts of the raw sources and the defaults of the analyses.

Everything here is a fixed value of the data: column names, labels, lists,
bands and dates. Pass another layout to run the operators on another source.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

# Standard visitor types and their keys.
DOMESTIC = "Domestic"
INTERNATIONAL = "International"
VISITOR_TYPES = ((1, DOMESTIC), (2, INTERNATIONAL))

# Zones, and the area-code bands that belong to them.
NORTH = "North Island"
SOUTH = "South Island"
OTHER = "Other"
ZONES = (NORTH, SOUTH)
ZONE_BANDS = ((1, 23, NORTH), (24, 40, SOUTH))

# Month window of the load and complete years of the analyses.
WINDOW = (dt.date(2024, 1, 1), dt.date(2026, 6, 1))
YEARS = (2024, 2025)

Window = tuple[dt.date, dt.date]


@dataclass(frozen=True)
class MappingLayout:
    code: str = "RTO2025_V1_00"
    name: str = "RTO2025_V1_00_NAME"
    name_ascii: str = "RTO2025_V1_00_NAME_ASCII"
    label: str = "RTO_Label_2025"
    label_ascii: str = "RTO_Label_2025_ASCII"

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.code, self.name, self.name_ascii, self.label, self.label_ascii)


@dataclass(frozen=True)
class VisitorLayout:
    code: str = "Destination_code"
    destination: str = "Destination"
    segment: str = "Population_segment"
    date: str = "Date"
    count: str = "Monthly_unique_counts"
    level: str = "Geographic_level_destination"
    level_kept: str = "RTO"
    suffix: str = " RTO"
    types: Mapping[str, str] = field(
        default_factory=lambda: {
            "Domestic visitor": DOMESTIC,
            "Total international visitor": INTERNATIONAL,
        }
    )

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.code, self.destination, self.segment, self.date, self.count, self.level)


@dataclass(frozen=True)
class NightsLayout:
    month: str = "Month"
    level: str = "Area type"
    area: str = "Area"
    property_type: str = "Property"
    measure: str = "Measure"
    value: str = "Value"
    flag: str = "Flag"
    level_kept: str = "RTO"
    suffix: str = " RTO"
    national_area: str = "Total New Zealand"
    total_property: str = "Total"
    suppressed: str = "c"
    types: Mapping[str, str] = field(
        default_factory=lambda: {
            "Domestic guest nights": DOMESTIC,
            "International guest nights": INTERNATIONAL,
        }
    )

    @property
    def columns(self) -> tuple[str, ...]:
        return (
            self.month,
            self.level,
            self.area,
            self.property_type,
            self.measure,
            self.value,
            self.flag,
        )


@dataclass(frozen=True)
class SpendLayout:
    month: str = "Date"
    area: str = "RTO"
    product: str = "Product"
    type: str = "Visitor Type"
    origin: str = "Origin"
    annual: str = "Annual Spend"
    monthly: str = "Monthly Spend"
    types: Mapping[str, str] = field(
        default_factory=lambda: {
            "New Zealand": DOMESTIC,
            "International": INTERNATIONAL,
        }
    )
    excluded_areas: tuple[str, ...] = (
        "Area Outside RTO",
        "non-RTO - Horowhenua",
        "non-RTO - Kawerau",
        "non-RTO - Otorohanga",
        "non-RTO - Rangitikei",
        "non-RTO - South Waikato",
        "non-RTO - Tararua",
        "non-RTO - Waimate",
        "non-RTO - Waitomo",
        "non-RTO - Whakatane",
    )

    @property
    def columns(self) -> tuple[str, ...]:
        return (
            self.month,
            self.area,
            self.product,
            self.type,
            self.origin,
            self.annual,
            self.monthly,
        )


# Names of the tables that a warehouse offers to SQL users.
TABLE_VIEWS = {
    "mapping": "RTO_Areas_Mapping_Clean",
    "visitors": "Visitor_Count_Clean",
    "nights": "ADP_Nights_Clean",
    "spend": "Spend_Clean",
    "months": "DimDate",
    "locations": "DimLocation",
    "visitor_types": "DimVisitorType",
    "fact": "FactTourismMonthly",
    "spend_detail": "FactSpendDetail",
}
