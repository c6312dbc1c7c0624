"""Text cleaning as Column expressions.

All helpers are built-in expressions (no Python UDF), never raise on bad
input, also with ``spark.sql.ansi.enabled``, and keep NULL as NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
LONG_MIN = -(2**63)

_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_REAL_PREFIX = r"^\s*([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)"
# Month and year of D/M/YYYY: the leading integer (1 to 12) of the part between the first
# two slashes, and the last four digits.
_SLASH = r"[^/]*/\s*[+]?0*(1[0-2]|[1-9])(?:[^0-9/][^/]*)?/.*([0-9]{4}) *"
# Year and month of yyyy-MM-dd, optionally followed by a time of day without a zone offset.
_ISO = (
    r"([0-9]{4})-(0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])[\sT]*"
    r"(?:(?:[01][0-9]|2[0-4]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?\s*[Zz]?\s*)?"
)
_ANY_DATE = rf"(?s)^(?:{_SLASH}|{_ISO}|.*)\z"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trimmed(value: Column | str) -> Column:
    """Strip blanks (U+0020) only; tabs and line ends stay."""
    return F.trim(as_column(value))


def last_chars(value: Column | str, n: int) -> Column:
    return F.right(as_column(value), F.lit(n))


def null_text(value: Column | str, token: str = "null") -> Column:
    """Trimmed text, with the literal ``token`` read as NULL."""
    return F.nullif(trimmed(value), F.lit(token))


def remove_all(value: Column | str, part: str) -> Column:
    """Drop every occurrence of ``part`` (case-sensitive), then trim."""
    return F.trim(F.replace(as_column(value), F.lit(part), F.lit("")))


def strip_suffix(value: Column | str, suffix: str) -> Column:
    """Drop one trailing ``suffix`` (any ASCII case) from the trimmed text."""
    text = trimmed(value)
    n = len(suffix)
    has_suffix = F.lower(F.right(text, F.lit(n))) == suffix.lower()
    return F.trim(F.when(has_suffix, F.left(text, F.char_length(text) - n)).otherwise(text))


def _prefix(text: Column, pattern: str) -> Column:
    """The matched prefix, or NULL: a failing numeric cast costs an exception per row."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def lenient_int(value: Column | str) -> Column:
    """Leading integer of a text as BIGINT; 0 when there is none; clamped to the BIGINT range."""
    text = as_column(value)
    out_of_range = F.when(text.rlike(r"^\s*-[0-9]"), F.lit(LONG_MIN)).when(
        text.rlike(r"^\s*[+]?[0-9]"), F.lit(LONG_MAX)
    )
    return F.coalesce(
        _prefix(text, _INT_PREFIX).try_cast("bigint"),
        out_of_range,
        F.when(text.isNotNull(), F.lit(0)),
    )


def lenient_real(value: Column | str) -> Column:
    """Leading decimal number of a text as DOUBLE; 0.0 when there is none."""
    text = as_column(value)
    return F.coalesce(
        _prefix(text, _REAL_PREFIX).try_cast("double"), F.when(text.isNotNull(), F.lit(0.0))
    )


def month_start(value: Column | str) -> Column:
    """First day of the month named by ``D/M/YYYY`` or ``YYYY-MM-DD`` text, else NULL.

    In the slash form the day is not looked at, so ``31/02/2024`` is February.
    The dashed form must not have leading blanks and needs two-digit parts.
    """
    raw = as_column(value)
    # The date cast reads the usual forms without a pattern, whatever the day says.
    middle = F.substring_index(F.substring_index(raw, "/", 2), "/", -1)
    slash = F.concat(last_chars(F.trim(raw), 4), F.lit("-"), middle, F.lit("-01"))
    is_iso = F.translate(raw, "123456789", "000000000") == "0000-00-00"
    usual = F.when(is_iso, raw).when(F.instr(raw, "/") > 0, slash).try_cast("date")
    # The pattern settles the rest; a text without a date becomes "--01", which is no date.
    unusual = F.regexp_replace(raw, _ANY_DATE, "$2$3-$1$4-01").try_cast("date")
    return F.coalesce(F.trunc(usual, "month"), unusual)


def recode(value: Column | str, labels: Mapping[str, str]) -> Column:
    """Map trimmed labels to their standard form; unmapped labels become NULL."""
    text = trimmed(value)
    out = F.lit(None).cast("string")
    for label, target in reversed(labels.items()):
        out = F.when(text == label, F.lit(target)).otherwise(out)
    return out
