"""Sums of doubles that do not depend on the order in which rows arrive.

A double is cut into three whole numbers: its part from 2^40 on, the rest down to 2^-20, the rest down to 2^-80. Their
sums are sums of integers in decimals, so they are exact, combine map-side, and give the same bits for any partitioning.
Values of 2^-27 and more lose nothing; of smaller ones what is below 2^-81 goes. The parts are joined as integers before
the total is rounded, so it is within an ulp of the exact sum, however much cancels.

Values from 2^90 on in absolute value, infinities and NaN are summed apart as doubles and decide the result if there are
any. Nulls are skipped; a group of nulls only has sum null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of two of the parts' units, and from which absolute value on a number is too large to be cut.
UNITS, LARGE = (40, -20, -80), 2.0**90
#: The ratio of two units.
STEP = 2**60


def _parts(x: Column) -> list[Column]:
    """The whole numbers of each part. All steps on doubles are exact: scaling by powers of two, rounding to whole
    numbers, and taking away a rounded part."""
    out, rest = [], x
    for unit in UNITS:
        n = F.rint(rest * F.lit(2.0**-unit))
        out.append(n)
        rest = rest - n * F.lit(2.0**unit)
    return out


def exact_sum(column: str | Column) -> Column:
    """An aggregate: the order-independent sum of a column of doubles."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    fine = F.abs(x) < LARGE  # false for NaN
    whole = "decimal(38,0)"
    # through long: the cast of a double to a decimal goes by its shortest decimal form and may change it
    top, mid, low = (F.sum(F.when(fine, n.cast("long").cast("decimal(20,0)"))) for n in _parts(F.when(fine, x).otherwise(F.lit(0.0))))
    odd = F.sum(F.when(~fine, x))
    step = F.lit(STEP).cast("decimal(19,0)")
    carry = F.floor(low / step).cast("decimal(19,0)")
    high = ((top * step).cast(whole) + mid.cast(whole) + carry.cast(whole)).cast(whole)
    rest = (low.cast(whole) - (carry * step).cast(whole)).cast(whole)
    total = high.cast("double") * F.lit(2.0 ** UNITS[1]) + rest.cast("double") * F.lit(2.0 ** UNITS[2])
    return F.coalesce(odd, total)


def exact_avg(column: str | Column) -> Column:
    """The order-independent mean: the exact sum over the number of values."""
    x = F.col(column) if isinstance(column, str) else column
    return exact_sum(x) / F.count(x)
