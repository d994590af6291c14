"""Samples that depend on rows' keys alone: the same rows at any partitioning, on any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused

DIGITS = 13  # hexadecimal, 52 bits: whole in a double


def uniform(key: str | Column, seed: int = 0) -> Column:
    """A number over 0 and up to 1 from a key's text."""
    text = F.concat_ws(":", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") + 1) / 16.0**DIGITS


def bottom_k(df: DataFrame, by: list[str], key: str, k: int, weight: str | None = None, seed: int = 0) -> DataFrame:
    """Exactly k rows of each group (all, where there are fewer), each set of k equally likely; with a weight, rows are drawn one after
    another in proportion to it.  `key` should tell rows apart.

    A row's rank is its hash, with a weight -ln(hash) / weight; the smallest win, ties by key.  Spark keeps k rows of each group in a
    task before the shuffle, so a hot group moves k rows a task.  Rows without a weight over 0 are not drawn; null groups are groups;
    null keys have one hash.
    """
    rank, place = unused(df.columns, "rank", "place")
    draw = uniform(key, seed)
    if weight:
        df, draw = df.where(F.col(weight) > 0), -F.ln(draw) / F.col(weight)
    ordered = Window.partitionBy(*by).orderBy(rank, key)
    return df.withColumn(rank, draw).withColumn(place, F.row_number().over(ordered)).where(F.col(place) <= k).drop(rank, place)
