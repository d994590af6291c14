"""Per-group orders, sessions and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, fewer where there are fewer; null keys are a group.  Spark keeps k rows a task before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, by: list[str], order: str, tie: str) -> DataFrame:
    """The last row of each group, by a grouped maximum: no sort, and hot groups are combined before the shuffle."""
    row = F.max_by(F.struct(*[c for c in df.columns if c not in by]), F.struct(order, tie)).alias("row")
    return df.groupBy(*by).agg(row).select(*by, "row.*")


def sessions(df: DataFrame, by: str, at: str, gap: str) -> DataFrame:
    """A row for each run of events with less than `gap` between them: bounds and count.  Events without a time are in no session;
    null keys are a group; an empty table gives none."""
    return (
        df.groupBy(by, F.session_window(F.col(at).cast("timestamp"), gap).alias("s"))
        .agg(F.count("*").alias("n_events"))
        .select(by, F.col("s.start").cast("timestamp_ntz").alias("begins"), F.col("s.end").cast("timestamp_ntz").alias("ends"), "n_events")
    )


def gap_filled(df: DataFrame, by: str, day: str, value: str) -> DataFrame:
    """A row for every day between each group's first and last, with the last known value carried forward: null before the
    first known one.  Null keys have no days."""
    days = df.groupBy(by).agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    along = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return days.join(df, [by, day], "left").select(by, day, F.last(value, ignorenulls=True).over(along).alias(value))
