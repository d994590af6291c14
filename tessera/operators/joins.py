"""Joins that Spark has no keyword for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused


def as_of_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], slices: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the values of right's latest row at or before left's time, for equal `by` columns.

    Instead of an inequality join, rows of both sides are put in one order, right before left at equal times, and the last right row is
    carried forward.  Of right rows at one time the one with the greatest values counts.  With `slices`, a function of the
    time that never falls (such as F.to_date), each key's order is cut into slices that are tasks' work of their own: the last right row
    of each slice, found by a grouped maximum, is carried over a key's slices first, so no task holds a hot key.

    Nulls: null keys and null times meet nothing, so such left rows stay with null values, and such right rows are not looked at.  Repeated
    left rows stay.  A value whose name left has is called <name>_right; no other name clashes.  Empty sides give no values or no rows.
    """
    side, row, part, first, known = unused([*left.columns, *right.columns], "side", "row", "slice", "first", "known")
    picked = right.select(*by, on, F.struct(*values).alias(row)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, on]))
    cut = slices(F.col(on)) if slices else F.lit(0)
    a = left.withColumns({side: F.lit(1), row: F.lit(None).cast(picked.schema[row].dataType)})
    both = a.unionByName(picked.withColumn(side, F.lit(0)), allowMissingColumns=True).withColumns({part: cut, first: F.lit(1)})
    if slices:
        last = both.groupBy(*by, part).agg(F.max_by(row, F.when(F.col(side) == 0, F.struct(on, row))).alias(row))
        before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        carry = last.withColumn(row, F.last(row, ignorenulls=True).over(before)).where(F.col(row).isNotNull())
        both = both.unionByName(carry.withColumns({side: F.lit(0), first: F.lit(0)}), allowMissingColumns=True)
    along = Window.partitionBy(*by, part).orderBy(first, on, side, row).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn(known, F.last(row, ignorenulls=True).over(along)).where(F.col(side) == 1)
    found = F.when(F.col(on).isNotNull(), F.col(known))
    taken = {c.lower() for c in left.columns}
    return carried.select(*[F.col(f"`{c}`") for c in left.columns], *[found[v].alias(f"{v}_right" if v.lower() in taken else v) for v in values])


def range_join(left: DataFrame, right: DataFrame, at: Column, begin: Column, end: Column, width: int) -> DataFrame:
    """Rows with begin <= at < end (whole numbers), by an equi-join on bins of the given width.

    A right row goes to every bin that it touches, so width should be near the usual length of a range; no side
    is broadcast and no pair outside a common bin is looked at.  Nulls and empty ranges meet nothing.  The three columns should
    be told apart by name.
    """
    (place,) = unused([*left.columns, *right.columns], "bin")
    a = left.withColumn(place, F.floor(at / width))
    b = right.where(begin < end).withColumn(place, F.explode(F.sequence(F.floor(begin / width), F.floor((end - 1) / width))))
    return a.join(b, place).where((at >= begin) & (at < end)).drop(place)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner", hot_rows: int = 1_000_000) -> DataFrame:
    """An equi-join that deals left rows of hot keys, those of more than `hot_rows` left rows, to `salts` tasks.  Right rows of hot keys
    alone are repeated that often.  Hot keys are counted first, combined before the shuffle; there are at most left rows / hot_rows.

    Null keys match nothing, as in any equi-join.  Repeated rows stay; columns of both sides that are not keys should differ in name.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("right rows are repeated: inner and left joins only")
    salt, hot = unused([*left.columns, *right.columns], "salt", "hot")
    keys = left.groupBy(*on).agg(F.count("*").alias(hot)).where(F.col(hot) > hot_rows).select(*on, F.lit(True).alias(hot))
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts))
    a = left.join(keys, on, "left").withColumn(salt, F.when(F.col(hot), own).otherwise(F.lit(0).cast("long"))).drop(hot)
    most = F.when(F.col(hot), F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    b = right.join(keys, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), most))).drop(hot)
    return a.join(b, [*on, salt], how).drop(salt)
