"""Rounding of the exact binary value, half to even: the library's round() and "%.nf" work on decimal digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves whose products with short numbers are exact.
_SPLIT = float((1 << 27) + 1)


def scaled(x: Column, digits: int) -> Column:
    """The integer nearest to x * 10**digits (up to six digits), of two equally near the even one; as double.

    2 * x * 10**digits is taken as product and rounding error, both exact, and compared with the odd number between
    the two candidates."""
    x, k = x.cast("double"), 2.0 * 10**digits
    p = x * k
    high = x * _SPLIT - (x * _SPLIT - x)
    error = (high * k - p) + (x - high) * k
    low = F.floor(p / 2).cast("double")
    odd = 2 * low + 1
    above = (p - odd) + error
    even = F.when(F.pmod(low, F.lit(2.0)) == 0, low).otherwise(low + 1)
    return F.when(above > 0, low + 1).when(above < 0, low).otherwise(even)


def python_round(x: Column, digits: int) -> Column:
    """Numbers from 2**51 / 10**digits on, whose own steps are about that coarse, stay as they are."""
    return F.when(F.abs(x.cast("double")) * 10.0**digits < 2.0**51, scaled(x, digits) / float(10**digits)).otherwise(x.cast("double"))


def hundredths(x: Column) -> Column:
    """A number of seconds from 0 as SS.cc, at least two digits before the point."""
    n = scaled(x, 2).cast("long")
    return F.format_string("%02d.%02d", F.floor(n / 100), n % 100)
