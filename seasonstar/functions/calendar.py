"""Month attributes and code bands as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, and the season of each month by hemisphere.
MONTH_NAMES = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)
SEASONS = {
    "south": {
        "Summer": (12, 1, 2),
        "Autumn": (3, 4, 5),
        "Winter": (6, 7, 8),
        "Spring": (9, 10, 11),
    },
    "north": {
        "Winter": (12, 1, 2),
        "Spring": (3, 4, 5),
        "Summer": (6, 7, 8),
        "Autumn": (9, 10, 11),
    },
}


def date_key(month: Column) -> Column:
    """yyyymm as INT."""
    return F.year(month) * 100 + F.month(month)


def key_year(key: Column) -> Column:
    return F.floor(key / 100).cast("int")


def key_month(key: Column) -> Column:
    return (key % 100).cast("int")


def month_name(number: Column) -> Column:
    names = F.array(*[F.lit(name) for name in MONTH_NAMES])
    # Under ANSI, element_at counts as never NULL even when the position is NULL.
    return F.when(number.isNotNull(), F.element_at(names, number))


def quarter_label(month: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(month).cast("string"))


def season(number: Column, hemisphere: str = "south") -> Column:
    """Season of a month number; December belongs to its own calendar year's season."""
    out = None
    for name, months in SEASONS[hemisphere].items():
        hit = number.isin(*months)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def band(code: Column, bands: Sequence[tuple[int, int, str]], other: str) -> Column:
    """Label of the first inclusive ``(low, high, label)`` band that holds ``code``."""
    out = F.lit(other)
    for low, high, label in reversed(bands):
        out = F.when(code.between(low, high), F.lit(label)).otherwise(out)
    return out
