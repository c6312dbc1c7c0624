"""Which cells of the sources have changed since a table was built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AREA_MONTH = ("RTO_Code", "Month")


def _hash(label: str, salt: int, columns: Sequence[str]) -> Column:
    """64 bits of a row. A hash passes over NULLs, so each column's NULL flag is hashed too."""
    parts = [part for name in columns for part in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]
    return F.xxhash64(F.lit(salt), F.lit(label), *parts).cast("decimal(28,0)")


def cell_digests(
    sources: Mapping[str, DataFrame], keys: Sequence[str] = AREA_MONTH
) -> DataFrame:
    """One row per cell: ``Rows`` of all ``sources`` in it and two sums of 64-bit row hashes.

    Sums do not depend on the order of rows, count repeated rows, and are added up within each
    task, so one partial row per cell and task is shuffled. Two contents of a cell of equal
    digests are as unlikely as two equal 128-bit hashes. Columns count in order of their names:
    a table stored in another order has the same digest. Rows with a NULL key are in no cell.
    """
    hashed = [
        frame.select(
            *keys, *[_hash(name, salt, sorted(frame.columns)).alias(f"h{salt}") for salt in (1, 2)]
        )
        for name, frame in sources.items()
    ]
    return (
        reduce(DataFrame.unionByName, hashed)
        .dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("Rows"), F.sum("h1").alias("First"), F.sum("h2").alias("Second"))
    )


def changed_cells(
    before: DataFrame, after: DataFrame, keys: Sequence[str] = AREA_MONTH
) -> DataFrame:
    """Keys of the cells that are new, gone or of another digest; one shuffle and no join."""
    digest = [*keys, "Rows", "First", "Second"]
    sides = before.select(*digest).unionByName(after.select(*digest))
    once = sides.groupBy(*digest).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1")
    return once.select(*keys).distinct()
