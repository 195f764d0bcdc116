"""As-of, nearest, band and interval joins.

As-of joins are one pass over the union of both sides in time order, cut into
bins of time, so that a key with very many rows is spread over many tasks:
within a bin the last (or next) right row is carried by a window. A bin also
gets the right rows that it needs from other bins: those within the tolerance,
or else the one last before it (or first after).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _guests(mine: DataFrame, yours: DataFrame, by: list[str], back: bool) -> DataFrame:
    """by, _bin and _p: for bins with left rows the last right row of all earlier bins (or the first of all later ones)."""
    ends = yours.groupBy(*by, "_bin").agg((F.max if back else F.min)("_p").alias("_p"))
    asked = mine.where("_bin is not null").select(*by, "_bin").distinct()
    both = asked.withColumn("_end", F.lit(0)).unionByName(ends.withColumn("_end", F.lit(1)), allowMissingColumns=True)
    across = Window.partitionBy(*by).orderBy(F.col("_bin").asc() if back else F.col("_bin").desc(), "_end").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_p", F.last("_p", ignorenulls=True).over(across)).where("_end = 0 and _p is not null").select(*by, "_bin", "_p")


def _whole(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], bin_width: int, right_rank: int, back: bool, ahead: bool, tolerance: int | None) -> DataFrame:
    """Both sides under one another: the keys, _bin, _at, _rank (1: of the left), the left's other columns as _c0, _c1 ..., and _p, a row of the right.

    back, ahead: whether left rows look for right rows before them, after them.
    """
    others = [c for c in left.columns if c not in by and c != on]
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [on, *by]])
    mine = left.select(*by, F.floor(F.col(on) / bin_width).alias("_bin"), F.col(on).alias("_at"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)])
    rows = right.where(known).select(*by, F.col(on).alias("_at"), F.struct(on, *take).alias("_p"))
    own = F.floor(F.col("_at") / bin_width)
    if tolerance is not None and tolerance <= bin_width:
        first, last = F.floor((F.col("_at") - (tolerance if ahead else 0)) / bin_width), F.floor((F.col("_at") + (tolerance if back else 0)) / bin_width)
        yours = rows.withColumn("_bin", F.explode(F.sequence(first, last)))
    else:
        yours = rows.withColumn("_bin", own)
        guests = [_guests(mine, yours, by, side).withColumn("_at", F.col(f"_p.{on}")) for side, asked in ((True, back), (False, ahead)) if asked]
        yours = reduce(DataFrame.unionByName, [yours, *guests])
    return mine.withColumn("_rank", F.lit(1)).unionByName(yours.withColumn("_rank", F.lit(right_rank)), allowMissingColumns=True)


def _again(left: DataFrame, by: list[str], on: str) -> list[Column]:
    """The left's columns from those of ``_whole``, in their order and types."""
    others = [c for c in left.columns if c not in by and c != on]
    at = {on: "_at", **{b: b for b in by}, **{c: f"_c{i}" for i, c in enumerate(others)}}
    return [F.col(at[c]).cast(left.schema[c].dataType).alias(c) for c in left.columns]


def _carried(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], bin_width: int, back: bool, inclusive: bool, tolerance: int | None) -> DataFrame:
    """left and _r: the struct (on, take...) of the last right row before (or first after); ``on`` is a number."""
    # At equal times right rows come first where they count, else after the left ones.
    whole = _whole(left, right, by, on, take, bin_width, 0 if inclusive else 2, back, not back, tolerance)
    order = [F.col("_at").asc() if back else F.col("_at").desc(), F.col("_rank"), *[(F.col(f"_p.{c}").asc_nulls_first() if back else F.col(f"_p.{c}").desc_nulls_last()) for c in take]]
    inside = Window.partitionBy(*by, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return whole.withColumn("_r", F.last("_p", ignorenulls=True).over(inside)).where("_rank = 1").select(*_again(left, by, on), "_r")


def _carried_both(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], bin_width: int, tolerance: int | None) -> DataFrame:
    """left, _before (the last right row up to its time) and _after (the first from it on), from one exchange of both sides."""
    whole = _whole(left, right, by, on, take, bin_width, 0, True, True, tolerance)
    so_far = (Window.unboundedPreceding, 0)
    up = Window.partitionBy(*by, "_bin").orderBy("_at", "_rank", *[F.col(f"_p.{c}").asc_nulls_first() for c in take]).rowsBetween(*so_far)
    down = Window.partitionBy(*by, "_bin").orderBy(F.col("_at").desc(), "_rank", *[F.col(f"_p.{c}").desc_nulls_last() for c in take]).rowsBetween(*so_far)
    met = whole.withColumns({"_before": F.last("_p", ignorenulls=True).over(up), "_after": F.last("_p", ignorenulls=True).over(down)}).where("_rank = 1")
    return met.select(*_again(left, by, on), "_before", "_after")


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], on: str, take: list[str], direction: str = "backward", inclusive: bool = True, tolerance: int | None = None, strict_tolerance: bool = False, tie: str = "earlier", bin_width: int = 365) -> DataFrame:
    """Left rows with ``on`` and ``take`` of the matching right row, named with ``_right`` at the end; null if none.

    on: an integer (days or seconds). direction: backward, forward or nearest
    (ties go to the earlier or the later right row). tolerance: the largest
    distance allowed, or the least that is not. Of right rows at the same time the one with the
    greatest ``take`` wins backward, the least forward. Rows with a null time or key match nothing.
    """
    if direction != "nearest":
        met = _carried(left, right, by, on, take, bin_width, direction == "backward", inclusive, tolerance)
    else:
        met = _carried_both(left, right, by, on, take, bin_width, tolerance)
        before, after = F.col(on) - F.col(f"_before.{on}"), F.col(f"_after.{on}") - F.col(on)
        first = before <= after if tie == "earlier" else before < after
        met = met.withColumn("_r", F.when(F.col("_after").isNull() | first, F.coalesce("_before", "_after")).otherwise(F.col("_after"))).drop("_before", "_after")
    if tolerance is not None:
        gap = F.abs(F.col(on) - F.col(f"_r.{on}"))
        met = met.withColumn("_r", F.when(gap < tolerance if strict_tolerance else gap <= tolerance, F.col("_r")))
    return met.select(*left.columns, *[F.col(f"_r.{c}").alias(f"{c}_right") for c in [on, *take]])


def interval_join(left: DataFrame, right: DataFrame, *, by: list[str], on: str, low: int, high: int, closed_high: bool = True, bin_width: int = 30) -> DataFrame:
    """Pairs of rows with equal keys and right time within [left + low, left + high] (or [..., high)).

    Left rows are copied to the few bins that their interval touches, so the
    join is on key and bin; right columns other than the keys get ``_right`` at the end.
    """
    wide = left.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(on) + low) / bin_width), F.floor((F.col(on) + high) / bin_width))))
    other = right.select(*by, *[F.col(c).alias(f"{c}_right") for c in right.columns if c not in by]).withColumn("_bin", F.floor(F.col(f"{on}_right") / bin_width))
    gap = F.col(f"{on}_right") - F.col(on)
    return wide.join(other, [*by, "_bin"]).where((gap >= low) & (gap <= high if closed_high else gap < high)).drop("_bin")


def interval_aggregate(left: DataFrame, right: DataFrame, *, key: str, by: list[str], on: str, low: int, high: int, aggregates: Callable[[], list[Column]], closed_high: bool = True, bin_width: int = 30) -> DataFrame:
    """Aggregates over the right rows in each left row's interval; null where there are none."""
    pairs = interval_join(left.select(key, *by, on), right, by=by, on=on, low=low, high=high, closed_high=closed_high, bin_width=bin_width)
    return left.join(pairs.groupBy(key).agg(*aggregates()), key, "left")
