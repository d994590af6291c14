"""Sketches and bitmaps as stored states: made once for fine groups, merged for coarse ones without the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LG_HLL, LG_THETA, KLL_K = 12, 12, 400

# Three standard errors of each sketch, as a share of the count (HLL, Theta) or of ranks (KLL).
BOUNDS = {"hll": 3 * 1.04 / 2 ** (LG_HLL / 2), "theta": 3 / 2 ** (LG_THETA / 2), "kll": 3 * 2.3 / KLL_K}


def sketch_states(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """A row for each group: by, n, hll and theta (distinct keys), kll (values).  Each state is of bounded size whatever the group's.

    Null keys and values are in no sketch but count in n; a group without any key or value has empty states; null groups are groups."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(key, LG_HLL).alias("hll"),
        F.theta_sketch_agg(key, LG_THETA).alias("theta"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("kll"),
    )


def merged_states(states: DataFrame, by: list[str | Column]) -> DataFrame:
    """The states of coarser groups, combined in each task before the shuffle."""
    return states.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", LG_THETA).alias("theta"), F.kll_merge_agg_double("kll", KLL_K).alias("kll")
    )


def estimates(states: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """by, n, keys (by HLL), keys_theta, and an array of the values' quantiles."""
    return states.select(
        *by,
        "n",
        F.hll_sketch_estimate("hll").alias("keys"),
        F.theta_sketch_estimate("theta").alias("keys_theta"),
        F.kll_sketch_get_quantile_double("kll", F.array(*map(F.lit, quantiles))).alias("quantiles"),
    )


def overlap(states: DataFrame, by: list[str], kind: str, a: str, b: str) -> DataFrame:
    """by, n_a, n_b, n_both: distinct keys of two kinds and of both, from Theta states; exact below 2 ** LG_THETA keys of a group.
    A group that lacks a kind has 0 there."""
    of = lambda x: F.max(F.when(F.col(kind) == x, F.col("theta")))
    pairs = states.groupBy(*by).agg(of(a).alias("a"), of(b).alias("b"))
    count = lambda x: F.coalesce(F.theta_sketch_estimate(x), F.lit(0)).cast("long")
    return pairs.select(*by, count("a").alias("n_a"), count("b").alias("n_b"), count(F.theta_intersection("a", "b")).alias("n_both"))


def key_run(key: str) -> Column:
    """The run of 2 ** (LG_THETA - 1) whole numbers that a key lies in; null for null.  A state of one run's keys is half full at most,
    so its Theta never samples, whatever the number of rows and keys."""
    return F.shiftright(key, LG_THETA - 1)


def exact_overlap(states: DataFrame, by: list[str], run: str, kind: str, a: str, b: str) -> DataFrame:
    """As `overlap`, exact at any size: from states by `run` as well (a `key_run`), as sums over runs, which share no key.
    Two keys of a run would have to share a hash of 63 bits to count as one."""
    runs = overlap(states, [*by, run], kind, a, b)
    return runs.groupBy(*by).agg(*(F.sum(n).alias(n) for n in ("n_a", "n_b", "n_both")))


def bitmaps(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, bucket, bits: exact sets of whole numbers, a bitmap of 4 KB for each group and run of 32,768 numbers that holds any.
    Nulls are in no set, so a group of nulls alone has no row."""
    rows = df.where(F.col(value).isNotNull()).withColumn("bucket", F.bitmap_bucket_number(value))
    return rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits"))


def merged_bitmaps(sets: DataFrame, by: list[str | Column]) -> DataFrame:
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_counts(sets: DataFrame, by: list[str], alias: str) -> DataFrame:
    """Exact distinct counts: sums over buckets, which share no number."""
    return sets.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(alias))


def heavy_hitters(df: DataFrame, column: str, share: float) -> DataFrame:
    """(column, n) of the values that are at least `share` of all that are not null.

    First pass: freqItems keeps 1 / share' counters a task, with share' a little under `share`, and takes one from each where all are in
    use.  Every take removes 1 / share' occurrences of different values, so at most n * share' are taken from one value, and one
    with more is left: nothing frequent is lost.  Second pass: the candidates, 1 / share' at most, are counted exactly, combined
    in each task, together with all other rows as one group.  Only candidates are broadcast.  An empty table gives none.
    """
    rows = df.where(F.col(column).isNotNull()).select(column)
    found = rows.stat.freqItems([column], share * 0.9).select(F.explode(f"{column}_freqItems").alias("_found")).distinct()
    met = rows.join(F.broadcast(found), F.col(column) == F.col("_found"), "left")
    counted = met.groupBy(F.col("_found").alias(column)).agg(F.count("*").alias("n"))
    return counted.withColumn("_all", F.sum("n").over(Window.partitionBy())).where(F.col(column).isNotNull() & (F.col("n") >= share * F.col("_all"))).drop("_all")
