"""Joins of large row sets to dimension-like tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32 * 1024 * 1024

_KINDS = ("inner", "left", "left_semi", "left_anti")


def _measure(dim: DataFrame, on: Sequence[str]) -> tuple[int, int, int]:
    """Rows, bytes, and rows beyond one per key, in one distributed pass.

    Rows are counted per key first, so the count of distinct keys needs no second pass; a NULL
    key matches nothing and may repeat.
    """
    width = F.lit(0).cast("bigint")
    for column in dim.schema.fields:
        if isinstance(column.dataType, (StringType, BinaryType)):
            size = F.coalesce(F.octet_length(F.col(f"`{column.name}`")), F.lit(0))
        else:
            size = F.lit(16)
        width = width + size
    keys = [F.col(f"`{name}`") for name in on]
    per_key = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(width).alias("__size"))
    known = F.lit(True)
    for key in keys:
        known = known & key.isNotNull()
    rows, size, extra = per_key.agg(
        F.sum("__n"), F.sum("__size"), F.sum(F.when(known, F.col("__n") - 1))
    ).first()
    return rows or 0, size or 0, extra or 0


def fits_broadcast(
    dim: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``dim`` (one distributed count and byte sum) against the broadcast bound."""
    rows, size, _ = _measure(dim, [])
    return rows <= max_rows and size <= max_bytes


def dim_join(
    rows: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
    unique: bool = True,
    known_small: bool = False,
) -> DataFrame:
    """Join ``rows`` to ``dim`` without a shuffle of ``rows`` when ``dim`` measures small.

    A dimension beyond the bound is joined as Spark plans it, by a shuffle on the key; adaptive
    execution splits the tasks of a hot key by what each map task wrote, so rows that are
    all equal are spread as well. Either way each left row meets all its partners, and each
    column of ``rows`` is computed once.

    With ``unique`` a key that occurs twice in ``dim`` raises ValueError, since it would multiply
    rows. ``known_small`` skips the measuring, for literal lists.
    """
    if how not in _KINDS:
        raise ValueError(f"how must be one of {_KINDS}, got {how!r}")
    on = list(on)
    if known_small:
        return rows.join(F.broadcast(dim), on, how)
    count, size, extra = _measure(dim, on)
    if unique and extra and how in ("inner", "left"):
        raise ValueError(f"{extra} rows of the dimension repeat a key of {on}")
    small = count <= max_rows and size <= BROADCAST_BYTES
    return rows.join(F.broadcast(dim) if small else dim, on, how)
