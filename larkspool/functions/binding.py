"""Use a computed value several times in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Repeated subexpressions are not shared inside conditional branches; the
    element of a one-element array is.
    """
    return F.transform(F.array(value), body)[0]
