"""Recursion level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import unused


def descend(roots: DataFrame, edges: DataFrame, key: str, parent: str, path: str) -> DataFrame:
    """(key, depth): every key that can be reached from roots by edges (key, parent), once, with its least depth.

    Each level is one equi-join with the level before and one anti-join with all levels so far, written as a folder under `path`, so
    the lineage of a level is a file and no limit of rows holds.  Levels end where one is empty; cycles end, since a key is met once.
    Null keys and parents meet nothing.  Empty roots give none.
    """
    spark, (above,) = roots.sparkSession, unused(edges.columns, "above")
    kind = roots.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, depth int"
    level, depth = roots.where(F.col(key).isNotNull()).select(key).distinct(), 0
    while True:
        level.write.parquet(f"{path}/depth={depth}")
        last = spark.read.schema(f"`{key}` {kind.simpleString()}").parquet(f"{path}/depth={depth}")
        seen = spark.read.schema(schema).parquet(path)
        if not last.take(1):
            return seen
        below = edges.join(last.select(F.col(key).alias(above)), F.col(parent) == F.col(above)).select(F.col(key).cast(kind).alias(key))
        level, depth = below.where(F.col(key).isNotNull()).distinct().join(seen.select(key), key, "left_anti"), depth + 1
