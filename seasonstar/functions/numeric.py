"""Sums, averages, ratios and rounding that do not depend on task order."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: A value is cut into signed digits of DIGIT bits at fixed powers of two, from 2 ** LOWEST up.
DIGIT = 24
LOWEST, HIGHEST = -96, 96


def exact_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """SUM of a real measure that does not depend on the order of additions.

    Every value is cut into digits at fixed powers of two, each of which is added as BIGINT
    (with room for 2 ** 40 rows of a group). Nothing is rounded on the way: the parts add up to
    the value. They are put together from the smallest to the largest, so the result is the
    true sum to about one rounding. NULL when every input is NULL.

    What lies outside the digits is added as doubles: parts below 2 ** -96, values from 2 ** 95
    (4.0e28) up, where the last bits may follow the order of additions, and infinities and
    NaN, which give what adding doubles gives.
    """
    number = value.cast("double")
    fits = F.abs(number) < float(2.0 ** (HIGHEST - 1))
    inside = F.when(fits, number).when(number.isNotNull(), F.lit(0.0))

    def total(part: Column) -> Column:
        summed = F.sum(part)
        return summed if window is None else summed.over(window)

    def units(power: int) -> Column:
        return F.rint(inside * F.lit(float(2.0**-power)))

    tail = F.when(fits, inside - units(LOWEST) * F.lit(float(2.0**LOWEST))).otherwise(number)
    result = total(tail)
    for power in range(LOWEST, HIGHEST, DIGIT):
        digit = units(power) - units(power + DIGIT) * F.lit(float(2.0**DIGIT))
        result = result + total(digit.cast("bigint")).cast("double") * F.lit(float(2.0**power))
    return result


def exact_avg(value: Column, window: WindowSpec | None = None) -> Column:
    """AVG over the non-NULL inputs, from the exact sum."""
    count = F.count(value)
    return F.try_divide(exact_sum(value, window), count if window is None else count.over(window))


def series_sum(value: Column, window: WindowSpec | None = None) -> Column:
    """SUM over a group that a calendar bounds, such as the months of one area; NULL when empty.

    One state per measure where ``exact_sum`` has nine: the values of the group, at most as many
    as the calendar has periods, are put in order and added with their rounding errors kept. So
    neither the order of tasks nor that of rows matters, and the sum is good to about one rounding.
    For groups that grow with the data take ``exact_sum``.
    """
    return _folded(_series(value, window))


def series_avg(value: Column, window: WindowSpec | None = None) -> Column:
    """AVG over the non-NULL inputs of a group that a calendar bounds; see ``series_sum``."""
    values = _series(value, window)
    return F.try_divide(_folded(values), F.size(values))


def _series(value: Column, window: WindowSpec | None) -> Column:
    values = F.collect_list(value.cast("double"))
    return F.sort_array(values if window is None else values.over(window))


def _folded(values: Column) -> Column:
    """Sum in the given order; what each addition rounds away is added up beside it."""

    def step(state: Column, x: Column) -> Column:
        total = state["total"] + x
        larger = F.abs(state["total"]) >= F.abs(x)
        error = F.when(larger, (state["total"] - total) + x).otherwise((x - total) + state["total"])
        return F.struct(total.alias("total"), (state["error"] + error).alias("error"))

    def finish(state: Column) -> Column:
        # beyond the doubles the errors are no numbers, and the plain total is what it is
        exact = state["total"] + state["error"]
        return F.when(F.isnan(exact), state["total"]).otherwise(exact)

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("error"))
    return F.when(F.size(values) > 0, F.aggregate(values, start, step, finish))


def percent_of(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL for a zero or NULL ``whole``."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0.0))


def percent_change(new: Column, base: Column) -> Column:
    return percent_of(new - base, base)


def round_half_up(value: Column, digits: int) -> Column:
    """Round a double once, half away from zero, on its shortest decimal digits."""
    return F.round(value, digits)
