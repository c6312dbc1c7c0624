"""Exact medians of groups of any size, by counting.

``median`` of Spark keeps the distinct values of a group in one state. Here a
group that is too large for that is narrowed first: quantile sketches propose
points, the rows between and at the points are counted, and the search goes on in
the one gap that holds the middle. The sketches only decide how fast that is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonstar.operators.joins import dim_join
from seasonstar.sources.tables import shared_folder

#: Rows of a group that are sorted by one task in the end, and gaps that a round cuts a group into.
SORTED_ROWS, GAPS = 100_000, 64


def _stored(state: DataFrame) -> DataFrame:
    path = shared_folder(state.sparkSession, "selection")
    state.write.parquet(path)
    return state.sparkSession.read.parquet(path)


def _inside(data: DataFrame, state: DataFrame) -> DataFrame:
    """Rows in the open gaps of the groups in ``state``, of which there is one row each."""
    v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
    rows = dim_join(data, state, ["__g"])
    return rows.where((low.isNull() | (v > low)) & (high.isNull() | (v < high)))


def _reached(counts: DataFrame, order: str) -> DataFrame:
    """Of the counted values or gaps of each group, the first that reaches rank ``__k``."""
    upto = Window.partitionBy("__g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__n").over(upto))
    return ranked.where((F.col("__upto") > F.col("__k")) & (F.col("__upto") - F.col("__n") <= F.col("__k")))


def _narrowed(data: DataFrame, state: DataFrame, gaps: int) -> DataFrame:
    """One round: of each group the gap that holds rank ``__k``, or the value at it."""
    grid = F.array(*[F.lit(i / gaps) for i in range(gaps + 1)])
    points = (
        _inside(data, state)
        .groupBy("__g")
        .agg(F.array_distinct(F.percentile_approx("__v", grid, 20 * gaps)).alias("__points"))
    )
    proposed = _stored(state.join(points, "__g"))
    below = F.size(F.filter("__points", lambda x: x < F.col("__v")))
    at = F.array_contains("__points", F.col("__v")).cast("int")
    counts = (
        _inside(data, proposed)
        # even: the gap before point number bin / 2; odd: rows equal to point number (bin - 1) / 2
        .select("__g", (2 * below + at).alias("__bin"))
        .groupBy("__g", "__bin")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    found = _reached(counts.join(proposed, "__g"), "__bin")
    number = F.floor(F.col("__bin") / 2).cast("int")
    exact = F.col("__bin") % 2 == 1

    def point(index: Column, otherwise: str) -> Column:
        return F.coalesce(F.get("__points", index), F.col(otherwise))

    return found.select(
        "__g",
        F.when(~exact, point(number - 1, "__low")).alias("__low"),
        F.when(~exact, point(number, "__high")).alias("__high"),
        (F.col("__k") - (F.col("__upto") - F.col("__n"))).alias("__k"),
        F.col("__n").alias("__size"),
        F.when(exact, F.get("__points", number)).alias("__found"),
        "__total",
    )


def exact_median(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    alias: str = "Median",
    sorted_rows: int = SORTED_ROWS,
    gaps: int = GAPS,
) -> DataFrame:
    """``keys``, ``Values`` (how many are not NULL) and their exact median as a double.

    Groups of up to ``sorted_rows`` take one aggregation per value and a window. A larger one is
    cut into ``gaps`` about equal parts a round, with a state of 2 * ``gaps`` + 1 counts at most and
    values that repeat counted at once, until so few rows are left; a group of 10 ** 12 rows
    takes four rounds, whose rows shrink alike. The median of an even number of values is the mean
    of the middle two. NULL keys are a group; a group without values, and an empty table, give no
    row. NaN is above all other values. ``rows`` are read in each round, so have them stored.
    """
    data = rows.select(
        F.struct(*keys).alias("__g"), F.col(value).cast("double").alias("__v")
    ).where("__v IS NOT NULL")
    none = F.lit(None).cast("double")
    n = F.count(F.lit(1))
    pending = _stored(
        data.groupBy("__g").agg(n.alias("__total")).select(
            "__g",
            none.alias("__low"),
            none.alias("__high"),
            F.floor((F.col("__total") - 1) / 2).cast("long").alias("__k"),
            F.col("__total").alias("__size"),
            none.alias("__found"),
            "__total",
        )
    )
    lower = pending.limit(0).select("__g", "__found", "__total")
    while True:
        large = pending.where(F.col("__size") > sorted_rows)
        small = pending.where(F.col("__size") <= sorted_rows)
        counts = _inside(data, small).groupBy("__g", "__v").agg(n.alias("__n"))
        done = _reached(counts.join(small, "__g"), "__v").withColumn("__found", F.col("__v"))
        lower = lower.unionByName(done.select("__g", "__found", "__total"))
        if large.isEmpty():
            break
        narrowed = _stored(_narrowed(data, large, gaps))
        known = F.col("__found").isNotNull()
        lower = lower.unionByName(narrowed.where(known).select("__g", "__found", "__total"))
        pending = narrowed.where(~known)
    lower = _stored(lower)
    # the upper middle is the same value again, or the least one above it
    v, found, total = F.col("__v"), F.col("__found"), F.col("__total")
    even = lower.where(total % 2 == 0)
    above = (
        dim_join(data, even, ["__g"])
        .groupBy("__g")
        .agg(F.count_if(v <= found).alias("__upto"), F.min(F.when(v > found, v)).alias("__next"))
    )
    upper = F.when(F.col("__upto") <= total / 2, F.col("__next")).otherwise(found)
    median = F.when(total % 2 == 1, found).otherwise((found + upper) / 2)
    return lower.join(above, "__g", "left").select(
        *[F.col(f"__g.`{name}`").alias(name) for name in keys],
        total.alias("Values"),
        median.alias(alias),
    )
