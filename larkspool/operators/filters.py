"""Row predicates. All are native expressions, so they run inside the scan stage."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspool.fixed_values import CONTAMINATED_SOURCE


def is_contaminated(source: Column, needle: str = CONTAMINATED_SOURCE) -> Column:
    """True if the lower-cased source contains ``needle``; a null source is clean."""
    return F.coalesce(F.contains(F.lower(source), F.lit(needle)), F.lit(False))


def drop_sources(df: DataFrame, needle: str = CONTAMINATED_SOURCE, source: str = "source") -> DataFrame:
    """Rows whose source does not contain ``needle``; rows without a source stay."""
    if source not in df.columns:
        return df
    return df.where(~is_contaminated(F.col(source), needle))


def both_filled(left: Column, right: Column) -> Column:
    """True if both texts are neither null nor empty."""
    return F.coalesce((left != "") & (right != ""), F.lit(False))


def compute_and_keep(
    df: DataFrame, keep: Sequence[str | Column], values: Mapping[str, Column], test: Callable[[Column], Column]
) -> DataFrame:
    """``keep`` and the computed ``values`` of all rows whose values pass ``test``.

    A filter on a computed column is pushed below its projection, where Catalyst
    computes the column a second time, ahead of any exchange. A generator over
    zero or one struct filters after computing once.
    """
    row = F.array(F.struct(*[value.alias(name) for name, value in values.items()]))
    return df.select(*keep, F.inline(F.filter(row, test)))
