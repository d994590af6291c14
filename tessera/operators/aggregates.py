"""Aggregates composed of built-in ones."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact(value: str | Column, scale: int = 2) -> Column:
    """A double as a decimal, so that sums don't depend on the order of rows."""
    return (F.col(value) if isinstance(value, str) else value).cast(f"decimal(18,{scale})")


def hundredths(value: str | Column) -> Column:
    """A double of two decimals in whole hundredths."""
    return F.floor((F.col(value) if isinstance(value, str) else value) * 100 + 0.5)


def exact_sum(units: Column, scale: int = 2) -> Column:
    """The sum of whole units of 10 ** -scale as a double, in any order of rows the same.

    High and low bits are summed as longs, which compiled code adds at once where decimals are objects; only a group's two sums
    become decimals.  Units up to 2 ** 40 overflow after 2 ** 43 rows of a group.  Nulls don't count; a group of nulls alone has null."""
    high, low = F.sum(F.shiftright(units, 20)).cast("decimal(20,0)"), F.sum(units.bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(20,0)")
    return ((high * (1 << 20) + low) * F.lit(Decimal(10) ** -scale)).cast("double")


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts by bins of the given width; nulls are a bin of their own, empty bins have no row."""
    return df.groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, by: str, value: str, quantiles: list[float], accuracy: int = 1000) -> DataFrame:
    """(by, q, value): exact quantiles of each group, interpolated between two neighbours; nulls don't count.

    Approximate ones bracket each rank between two values.  Rows below a bracket are counted, combined before the
    shuffle; only those inside, some five in `accuracy` of a group, are put in order.  No task holds a group.
    A group of nulls alone has no row, an empty table none.  A bracket that misses its rank, beyond the sketch's bounds, is an error.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    spans = [(q, max(0.0, q - 2.5 / accuracy), min(1.0, q + 2.5 / accuracy)) for q in quantiles]
    ends = F.percentile_approx("v", [x for _, low, high in spans for x in (low, high)], accuracy)
    known = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), ends.alias("ends"))
    # Where a rank lies by an end of the group, its bracket does, too; a small group is one bracket.
    small = F.col("n") <= accuracy
    low = lambda i, lo: F.when(small | (F.lit(lo) <= 1.0 / accuracy), F.col("least")).otherwise(F.col("ends")[2 * i])
    high = lambda i, hi: F.when(small | (F.lit(hi) >= 1 - 1.0 / accuracy), F.col("most")).otherwise(F.col("ends")[2 * i + 1])
    bracket = [F.struct(F.lit(q).alias("q"), low(i, lo).alias("low"), high(i, hi).alias("high")) for i, (q, lo, hi) in enumerate(spans)]
    known = known.select(F.col(by).alias("_by"), "n", F.explode(F.array(*bracket)).alias("b")).select("_by", "n", "b.*")
    met = rows.join(known, F.col(by).eqNullSafe(F.col("_by"))).where("v <= high")
    below = met.groupBy(F.col("_by").alias("_of"), F.col("q").alias("_q")).agg(F.count_if(F.col("v") < F.col("low")).alias("below"))
    inside = met.where("v >= low").groupBy("_by", "q", "n", "v").agg(F.count("*").alias("times"))
    ranked = inside.join(below, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("q") == F.col("_q")))
    upto = F.sum("times").over(Window.partitionBy("_by", "q").orderBy("v")) + F.col("below")
    at = F.col("q") * (F.col("n") - 1)
    ranked = ranked.withColumn("upto", upto).withColumns({"at": at, "first": F.col("upto") - F.col("times")})
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("upto")), F.col("v")))
    ends = ranked.groupBy(F.col("_by").alias(by), "q", "at").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    missed = F.raise_error(F.lit("a rank lies outside its bracket: raise accuracy")).cast("double")
    return ends.select(by, "q", F.when(value.isNull(), missed).otherwise(value).alias("value"))
