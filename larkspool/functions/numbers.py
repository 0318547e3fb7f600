"""Number formatting for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(value: Column) -> Column:
    """``value * 100`` rounded to a bigint by the exact binary value, ties to even.

    ``format_string('%.2f')`` rounds the shortest decimal form half up, which
    turns 0.125 into 0.13 and 1.005 (stored slightly below) into 1.01. Here the
    rounding error of the product is recovered by splitting the factor into two
    26-bit halves, so that the comparison with the half-way point is exact.
    """
    size = F.abs(value)
    product = size * 1000.0
    wide = size * 134217729.0  # 2**27 + 1
    high = wide - (wide - size)
    low = size - high
    error = (high * 1000.0 - product) + low * 1000.0
    # The exact product is thousandths + rest.
    thousandths = F.rint(product)
    rest = (product - thousandths) + error
    base = F.floor(thousandths / 10.0)
    last = thousandths - base * 10.0
    up = (last > 5.0) | ((last == 5.0) & ((rest > 0.0) | ((rest == 0.0) & (base % 2 == 1))))
    return F.when(up, base + 1).otherwise(base)


def two_decimals(value: Column, signed: bool = False) -> Column:
    """``value`` with two decimals; ``signed`` adds a plus in front of non-negative values."""
    cents = hundredths(value)
    sign = F.when(value < 0, "-").otherwise("+" if signed else "")
    text = F.format_string("%s%d.%02d", sign, F.floor(cents / 100), cents % 100)
    return F.when(value.isNotNull(), text)


def left_justified(text: Column, width: int) -> Column:
    """Text padded with spaces to ``width``; longer text is kept whole."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))
