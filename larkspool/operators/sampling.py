"""Exact samples in draw-key order, allocated per source.

A sample of k rows is "the k smallest draw keys of the stratum". Draw keys are uniform
hexadecimal digests, so the k-th of n keys lies near k/n, within a few times
sqrt(k (n - k) / n^3). One pass counts the strata, a second one counts the rows in front of
such a bracket and ranks those inside it: about 6 sqrt(n) rows of n, 200,000 of a billion.
If the k-th row is not in its bracket, which a count shows, the bracket gets wider, so the
cut is exact. The sample is then a comparison with the cut, evaluated in the scan; wide
rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larkspool.fixed_values import SEED
from larkspool.functions.draws import draw_key
from larkspool.operators.ranks import positions
from larkspool.operators.staging import lookup_join, stage

#: Standard deviations on either side of a cut's expected place where it is looked for first, and the factor of each next try.
SPREAD, WIDER = 6.0, 16.0
#: Draw keys are compared with brackets by this many leading digits; "g" is behind all digits.
_DIGITS = 12
_BEHIND = "g"
#: Quantiles that bracket the n-th row id; the rank error of a quantile is a tenth of their distance.
QUANTILES = 1_000


def _up_to(key: Column, row: Column, cut_key: Column, cut_row: Column) -> Column:
    return F.coalesce((key < cut_key) | ((key == cut_key) & (row <= cut_row)), F.lit(False))


def _edges(rows: DataFrame, quota: DataFrame | Column | int, strata: Sequence[str], fixed: int) -> DataFrame:
    """Per stratum: the rank ``_rank`` of the quota's last row, the lead ``_lead`` it has, its place among the ``_n`` rows of that lead."""
    for column in strata:
        rows = rows.where(F.col(column).isNotNull())
    counts = rows.groupBy(*strata, F.substring("_key", 1, fixed).alias("_lead")).agg(F.count("_key").alias("_n")).where("_n > 0")
    ahead, size = F.lit(0), F.col("_n")
    if fixed:
        whole = Window.partitionBy(*strata)
        earlier = whole.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
        ahead, size = F.coalesce(F.sum("_n").over(earlier), F.lit(0)), F.sum("_n").over(whole)
    counts = counts.withColumns({"_ahead": ahead, "_size": size})
    if isinstance(quota, DataFrame):
        counts = counts.join(quota.withColumnRenamed("quota", "_quota"), list(strata))
    else:
        counts = counts.withColumn("_quota", quota if isinstance(quota, Column) else F.lit(quota).cast("bigint"))
    rank = F.least("_quota", "_size")
    holds = (rank > F.col("_ahead")) & (rank <= F.col("_ahead") + F.col("_n"))
    return counts.where(holds).select(*strata, "_lead", "_n", (rank - F.col("_ahead")).alias("_place"), rank.alias("_rank"))


def _beside(rows: DataFrame, found: DataFrame | Row, strata: Sequence[str], row_id: str, how: str = "left") -> DataFrame:
    """Rows with what was found for their stratum: a staged table, or one row if the whole table is a stratum."""
    if isinstance(found, DataFrame):
        return lookup_join(rows, found, strata, row_id, how)
    return rows.withColumns({c: F.lit(v) for c, v in found.asDict().items()})


def _cuts(rows: DataFrame, edges: DataFrame | Row, strata: Sequence[str], spread: float) -> DataFrame:
    """Key and row id of the quota's last row, for each stratum where it lies within ``spread`` deviations of its expected place."""
    share = (F.col("_place") - 0.5) / F.col("_n")
    margin = spread * F.sqrt(share * (1 - share) / F.col("_n")) + spread * spread / F.col("_n")

    def digits(at: Column) -> Column:
        return F.lpad(F.lower(F.hex(F.floor(at * F.lit(16.0**_DIGITS)))), _DIGITS, "0")

    low = F.when(share > margin, digits(share - margin)).otherwise("")
    high = F.when(share + margin < 1, digits(share + margin)).otherwise(_BEHIND)
    bracket = {"_from": F.concat("_lead", low), "_to": F.concat("_lead", high)}
    if isinstance(edges, DataFrame):
        edges = edges.withColumns(bracket).select(*strata, "_from", "_to", "_rank")
        near = _beside(rows, edges, strata, "_row", "inner")
    else:
        near = _beside(rows, edges, strata, "_row").withColumns(bracket)
    # All rows in front of the bracket become one row per task and stratum before they are shuffled.
    inside = F.col("_key") >= F.col("_from")
    places = [F.when(inside, F.col(c)).alias(c) for c in ("_key", "_row")]
    seen = near.where(F.col("_key") < F.col("_to")).groupBy(*strata, *places).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_rank")
    )
    upto = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_key", "_row"))
    last = seen.withColumn("_upto", upto).where("_upto >= _rank and _upto - _n < _rank and _key is not null")
    return last.select(*strata, F.col("_key").alias("_cut_key"), F.col("_row").alias("_cut_row"))


def _all_cuts(rows: DataFrame, edges: DataFrame | Row, strata: Sequence[str]) -> DataFrame | Row:
    """The cut of every stratum, with wider brackets for those that have none yet."""
    spread = SPREAD
    if not isinstance(edges, DataFrame):
        while (cut := _cuts(rows, edges, strata, spread).first()) is None:
            spread *= WIDER
        return cut
    cuts = some = stage(_cuts(rows, edges, strata, spread), "cuts")
    while some.count() < edges.count():  # both from file footers
        spread *= WIDER
        edges = stage(edges.join(some, strata, "left_anti"), "strata")
        some = stage(_cuts(rows, edges, strata, spread), "cuts")
        cuts = stage(cuts.unionByName(some), "cuts")
    return cuts


def mark_first(
    df: DataFrame,
    quota: DataFrame | Column | int,
    key: str,
    row_id: str,
    strata: Sequence[str] = (),
    name: str = "picked",
    fixed: int = 0,
) -> DataFrame:
    """Add the boolean ``name``: whether the row is among the first of its stratum by (key, row id).

    ``quota`` is a number, an expression over the strata columns and the rows ``_size`` of
    the stratum, or a table of the strata columns and a bigint ``quota``; a stratum that is
    null or not in the table has no quota. The key consists of random hexadecimal digits
    after ``fixed`` leading characters of another kind, of which there are few. ``df`` is
    read three times, of which twice only its strata, key and row id.
    """
    strata = list(strata)
    rows = df.select(*strata, F.col(key).alias("_key"), F.col(row_id).alias("_row"))
    edges = _edges(rows, quota, strata, fixed)
    edges = stage(edges, "strata") if strata else edges.first()
    if edges is None:
        return df.withColumn(name, F.lit(False))
    marked = _beside(df, _all_cuts(rows, edges, strata), strata, row_id)
    picked = _up_to(F.col(key), F.col(row_id), F.col("_cut_key"), F.col("_cut_row"))
    return marked.withColumn(name, picked).drop("_cut_key", "_cut_row")


def source_distribution(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows per source and their share of all rows; null sources count only in the total."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("share", F.col("count") / total)


def allocate(df: DataFrame, size: int, source: str = "source") -> DataFrame:
    """Rows to draw per source: share of the table times ``size``, rounded down."""
    quota = _allocated(F.col("count"), F.col("share"), size)
    return source_distribution(df, source).select(source, quota.alias("quota"))


def _allocated(count: Column, share: Column, size: int) -> Column:
    return F.least(F.floor(share * F.lit(size)), count).cast("bigint")


def _drawn(df: DataFrame, row_id: str, purpose: str, seed: int) -> DataFrame:
    return df.withColumn("_draw", draw_key(F.col(row_id), purpose, seed))


def _mark_strata(df: DataFrame, size: int, row_id: str, source: str, seed: int) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    quota = _allocated(F.col("_size"), F.col("_size") / total, size)
    return mark_first(_drawn(df, row_id, "strata", seed), quota, "_draw", row_id, [source], "_picked").drop("_draw")


def stratified_sample(df: DataFrame, size: int, row_id: str, source: str = "source", seed: int = SEED) -> DataFrame:
    """The allocated number of rows of each source; at most ``size`` in all because shares round down."""
    return _mark_strata(df, size, row_id, source, seed).where("_picked").drop("_picked")


def plain_sample(df: DataFrame, size: int, row_id: str, seed: int = SEED) -> DataFrame:
    """``size`` rows of the whole table."""
    marked = mark_first(_drawn(df, row_id, "plain", seed), size, "_draw", row_id, name="_picked")
    return marked.where("_picked").drop("_picked", "_draw")


def top_up(df: DataFrame, size: int, picked: str, row_id: str, seed: int = SEED) -> DataFrame:
    """Set ``picked`` on further rows, drawn from all others, until ``size`` rows have it.

    Rows already picked sort ahead of all others, so they stay and the rest of the
    quota goes to the smallest draw keys among the others.
    """
    turn = F.concat(F.when(F.col(picked), "0").otherwise("1"), draw_key(F.col(row_id), "topup", seed))
    marked = mark_first(df.withColumn("_turn", turn), size, "_turn", row_id, name="_more", fixed=1)
    return marked.withColumn(picked, F.col("_more")).drop("_more", "_turn")


def proportional_sample(
    df: DataFrame,
    size: int,
    row_id: str,
    source: str = "source",
    seed: int = SEED,
    total: int | None = None,
) -> DataFrame:
    """Exactly ``size`` rows (all, if there are fewer) in the proportions of the sources.

    What rounding down and null sources leave over is drawn from all other rows.
    Without a source column it is a plain sample. Pass a staged table, as ``df``
    is read several times, and its row count as ``total`` if it is known.
    """
    if size >= (df.count() if total is None else total):
        return df
    if source not in df.columns:
        return plain_sample(df, size, row_id, seed)
    marked = _mark_strata(df, size, row_id, source, seed)
    return top_up(marked, size, "_picked", row_id, seed).where("_picked").drop("_picked")


def shuffled(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    """All rows in random order: one range shuffle on a unique key."""
    return _drawn(df, row_id, "shuffle", seed).orderBy("_draw", row_id).drop("_draw")


def shuffle_positions(df: DataFrame, row_id: str, seed: int = SEED) -> DataFrame:
    """Row ids with their position ``pos`` in the random order."""
    return positions(_drawn(df.select(row_id), row_id, "shuffle", seed), ["_draw", row_id]).drop("_draw")


def head(df: DataFrame, size: int | None, row_id: str) -> DataFrame:
    """The ``size`` rows with the smallest row ids; everything if there are no more.

    The last id wanted becomes a range predicate, which reaches the scan of ``df``. Of integer
    ids only those between two quantiles around it are sorted, others are sorted as a whole.
    """
    if not size:
        return df
    ids = df.select(F.col(row_id).alias("_own"))
    if isinstance(ids.schema["_own"].dataType, IntegralType):
        last = _nth(ids, size)
    else:
        last = positions(ids, ["_own"]).where(F.col("pos") == size - 1).first()
    return df.where(F.col(row_id) <= F.lit(last["_own"])) if last else df


def _nth(ids: DataFrame, n: int) -> Row | None:
    """The n-th smallest of integers ``_own``; None if there are fewer.

    One pass takes quantiles, merged from partial sketches; two more, both with a range predicate
    on the scan, count the ids up to the bracket and sort those inside. If the n-th isn't inside, which
    the counts show, the bracket gets wider.
    """
    grid = [k / QUANTILES for k in range(QUANTILES + 1)]
    total, quantiles = ids.agg(F.count("_own"), F.percentile_approx("_own", grid, 10 * QUANTILES)).first()
    if n > total:
        return None
    row, at, wide = F.col("_own"), n * QUANTILES // total, 1
    while True:
        low, high = at - wide, at + 1 + wide
        below, inside = 0, ids
        if low > 0:
            below = ids.where(row <= quantiles[low]).count()
            inside = inside.where(row > quantiles[low])
        if high < QUANTILES:
            inside = inside.where(row <= quantiles[high])
        found = positions(inside.where(row.isNotNull()), ["_own"]).where(F.col("pos") == n - below - 1).first()
        if found or (low <= 0 and high >= QUANTILES):
            return found
        wide *= 4
