"""Window frames counted in groups of peers, with rows left out: GROUPS and EXCLUDE."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import unused

EXCLUDE = ("no others", "current row", "group", "ties")


def groups_frame(df: DataFrame, by: list[str], order: list[str], value: str, before: int | None, after: int | None, exclude: str = "no others") -> DataFrame:
    """df with sum and count of `value` over the frame GROUPS BETWEEN before PRECEDING AND after FOLLOWING (None: unbounded),
    as <value>_sum and <value>_count.

    Peers, rows alike in `by` and `order`, are summed first, which combines before the shuffle; the frame runs over peers numbered
    without gaps, and its sums go back to the rows by an equi-join.  So the task of a hot group holds its peers, not its rows.
    EXCLUDE subtracts: the row, its peers, or its peers but the row.  Values should be whole numbers or decimals, whose sums don't
    depend on order.  Nulls don't count; a frame without values has a null sum; null keys are peers of each other, and first.
    """
    if exclude not in EXCLUDE:
        raise ValueError(f"exclude is one of {EXCLUDE}")
    total, n, place, own_sum, own_n = unused(df.columns, "total", "n", "place", "own_sum", "own_n")
    keys = unused([*df.columns, total, n, place, own_sum, own_n], *[f"key{i}" for i in range(len(by) + len(order))])
    along = Window.partitionBy(*keys[: len(by)])
    peers = df.groupBy(*[F.col(c).alias(k) for c, k in zip([*by, *order], keys, strict=True)]).agg(F.sum(value).alias(own_sum), F.count(value).alias(own_n))
    peers = peers.withColumn(place, F.dense_rank().over(along.orderBy(*keys[len(by) :])))
    frame = along.orderBy(place).rangeBetween(
        Window.unboundedPreceding if before is None else -before, Window.unboundedFollowing if after is None else after
    )
    peers = peers.withColumns({total: F.coalesce(F.sum(own_sum).over(frame), F.lit(0)), n: F.coalesce(F.sum(own_n).over(frame), F.lit(0))})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip([*by, *order], keys, strict=True)])
    rows = df.join(peers, same)
    in_frame = F.lit((before is None or before >= 0) and (after is None or after >= 0))  # else the own peers are not in the frame
    row_sum, row_n = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    peer_sum = F.coalesce(F.col(own_sum), F.lit(0))
    less_sum, less_n = {
        "no others": (F.lit(0), F.lit(0)),
        "current row": (row_sum, row_n),
        "group": (peer_sum, F.col(own_n)),
        "ties": (peer_sum - row_sum, F.col(own_n) - row_n),
    }[exclude]
    count = F.col(n) - F.when(in_frame, less_n).otherwise(F.lit(0))
    return rows.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.when(count > 0, F.col(total) - F.when(in_frame, less_sum).otherwise(F.lit(0))).alias(f"{value}_sum"),
        count.alias(f"{value}_count"),
    )
