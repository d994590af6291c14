import os
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators.frames import groups_frame
from tessera.operators.samples import bottom_k, uniform
from tessera.operators.sketches import BOUNDS, bitmap_counts, bitmaps, estimates, heavy_hitters, merged_bitmaps, merged_states, overlap, sketch_states

from tessera.plans import advanced  # noqa: F401  registers its queries
from tessera.plans.registry import ORACLES, QUERIES

from .conftest import MID, SMALL, TABLES


def test_merged_sketches_are_within_their_bounds(spark, tmp_path):
    lineitem = spark.read.parquet(f"{MID}/lineitem.parquet").withColumn("key", F.col("l_orderkey") * 7 + F.col("l_linenumber"))
    sketch_states(lineitem, ["l_suppkey", "l_returnflag"], "key", "l_extendedprice").write.parquet(f"{tmp_path}/fine")
    merged = merged_states(spark.read.parquet(f"{tmp_path}/fine"), ["l_returnflag"])
    got = {r["l_returnflag"]: r for r in estimates(merged, ["l_returnflag"], [0.1, 0.5, 0.9]).collect()}
    exact = lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.sort_array(F.collect_list("l_extendedprice")).alias("prices")).collect()
    assert len(got) == len(exact) == 3
    for r in exact:
        near = got[r["l_returnflag"]]
        assert near["n"] == r["n"]
        assert abs(near["keys"] - r["keys"]) <= BOUNDS["hll"] * r["keys"]
        assert abs(near["keys_theta"] - r["keys"]) <= BOUNDS["theta"] * r["keys"]
        for q, price in zip((0.1, 0.5, 0.9), near["quantiles"], strict=True):
            assert abs(sum(p <= price for p in r["prices"]) / len(r["prices"]) - q) <= BOUNDS["kll"]


def test_overlap_of_sketches_and_odd_rows(spark):
    rows = [("x", "a", i, 1.0) for i in range(100)] + [("x", "b", i, None) for i in range(60, 200)] + [("y", "a", 1, 2.0), (None, "b", None, 1.0)]
    states = sketch_states(spark.createDataFrame(rows, "g string, kind string, k long, v double"), ["g", "kind"], "k", "v")
    assert set(map(tuple, overlap(states, ["g"], "kind", "a", "b").collect())) == {("x", 100, 140, 40), ("y", 1, 0, 0), (None, 0, 0, 0)}
    assert merged_states(states.limit(0), ["g"]).count() == 0
    got = {r["g"]: (r["n"], r["keys"]) for r in estimates(merged_states(states, ["g"]), ["g"], [0.5]).collect()}
    assert got["y"] == (1, 1) and got[None] == (1, 0) and got["x"][0] == 240


def test_overlap_agrees_with_its_sql_beyond_the_size_of_a_sketch(spark, agrees, tmp_path):
    for t in set(TABLES) - {"orders"}:
        os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    duckdb.sql(f"""COPY (SELECT i AS o_orderkey, CASE WHEN i % 50 > 0 THEN (i * 7919 % 9001 - 700) * CASE WHEN i % 11 = 0 THEN 1099511627776 ELSE 1 END END AS o_custkey, 1.5 * i AS o_totalprice,
        CASE WHEN i % 40 > 0 THEN TIMESTAMP '2023-07-01' + to_days((i % 400)::INT) END AS o_orderdate, CASE i % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '5-LOW' WHEN 2 THEN '3-MEDIUM' END AS o_orderpriority
        FROM range(80000) t(i) UNION ALL SELECT -i, i, 1, TIMESTAMP '2023-01-31', '5-LOW' FROM range(9000) t(i) UNION ALL SELECT -9000 - i, i, 1, NULL, '5-LOW' FROM range(50) t(i)
        UNION ALL SELECT -9050 - i, NULL, NULL, TIMESTAMP '2021-01-01', '1-URGENT' FROM range(3) t(i)) TO '{tmp_path}/orders.parquet'""")
    df = QUERIES["agg_sketch_overlap"](spark, str(tmp_path))
    agrees(df, ORACLES["agg_sketch_overlap"], str(tmp_path))
    counts = {r["year"]: (r["n_a"], r["n_b"], r["n_both"]) for r in df.collect()}
    assert min(counts["2023"][:2]) > 4_096 and counts["2021"] == (0, 0, 0) and min(counts[None][:2]) > 0 == counts[None][2]


def test_bitmaps_count_exactly_through_two_levels(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.randrange(5), r.choice([None, r.randrange(-70_000, 70_000), r.randrange(20), 2**40 + r.randrange(9)])) for _ in range(3_000)]
    df = spark.createDataFrame(rows + [("c", 0, None)], "g string, day int, x long")
    monthly = merged_bitmaps(bitmaps(df, ["g", "day"], "x"), ["g"])
    assert {x["g"]: x["n"] for x in bitmap_counts(monthly, ["g"], "n").collect()} == {g: len({x for h, _, x in rows if h == g and x is not None}) for g in "ab"}
    assert bitmap_counts(bitmaps(df.limit(0), ["g"], "x"), ["g"], "n").count() == 0


def test_heavy_hitters_are_all_found_and_exact(spark):
    r = random.Random(3)
    words = [f"hot{i}" for i in range(6) for _ in range(200 * (6 - i))] + [f"cold{r.randrange(3_000)}" for _ in range(4_000)] + [None] * 500
    r.shuffle(words)
    df = spark.createDataFrame([(w, 1) for w in words], "w string, _found int").repartition(7)
    counts = Counter(w for w in words if w is not None)
    total = sum(counts.values())
    for share in (0.2, 0.05, 0.02):
        assert {x["w"]: x["n"] for x in heavy_hitters(df, "w", share).collect()} == {w: n for w, n in counts.items() if n >= share * total}
    assert heavy_hitters(df.limit(0), "w", 0.1).count() == heavy_hitters(df.where("w IS NULL"), "w", 0.1).count() == 0


def test_samples_have_their_size_and_do_not_depend_on_partitions(spark):
    group = F.when(F.col("id") < 8, "few").when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "some")
    df = spark.range(2_000).select("id", group.alias("g"), F.lit(1).alias("rank"))
    a, b = bottom_k(df.repartition(1), ["g"], "id", 30, seed=1), bottom_k(df.repartition(9, "rank"), ["g"], "id", 30, seed=1)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == df.columns
    sizes = {r["g"]: r["count"] for r in a.groupBy("g").count().collect()}
    assert sizes == {"hot": 30, "some": 30, None: 30, "few": 8}
    assert {r["id"] for r in a.collect()} != {r["id"] for r in bottom_k(df, ["g"], "id", 30, seed=2).collect()}
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once before the shuffle


def test_samples_are_fair_and_weights_count(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).alias("g"), F.when(F.col("id") % 3 == 0, 9.0).when(F.col("id") % 3 == 1, 1.0).otherwise(0.0).alias("w"))
    assert abs(df.agg(F.avg(uniform("id"))).first()[0] - 0.5) < 0.01
    even = bottom_k(df, ["g"], "id", 30).groupBy((F.col("id") % 3).alias("k")).count().collect()
    assert all(800 < r["count"] < 1_200 for r in even)
    heavy = {r["k"]: r["count"] for r in bottom_k(df, ["g"], "id", 10, weight="w").groupBy((F.col("id") % 3).alias("k")).count().collect()}
    assert sum(heavy.values()) == 1_000 and 2 not in heavy and 860 < heavy[0] < 930  # nine to one


def frame_by_hand(rows, before, after, exclude):
    out = []
    for i, (g, o, v) in enumerate(rows):
        peers = sorted({x for h, x, _ in rows if h == g}, key=lambda x: (x is not None, x))
        at = peers.index(o)
        inside = [j for j, (h, x, _) in enumerate(rows) if h == g and (before is None or peers.index(x) >= at - before) and (after is None or peers.index(x) <= at + after)]
        same = [j for j in inside if rows[j][1] == o]
        gone = {"no others": [], "current row": [i], "group": same, "ties": [j for j in same if j != i]}[exclude]
        values = [rows[j][2] for j in inside if j not in gone and rows[j][2] is not None]
        out.append((g, o, v, sum(values) if values else None, len(values)))
    return sorted(out, key=str)


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
def test_groups_frames_equal_frames_by_hand(spark, exclude):
    r = random.Random(9)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1, 2, 3, 5, 8]), r.choice([None, 1, 2, 30])) for _ in range(60)]
    df = spark.createDataFrame(rows, "total string, n int, v long")
    for before, after in ((1, 1), (None, 0), (0, None), (2, -1)):
        got = sorted(map(tuple, groups_frame(df, ["total"], ["n"], "v", before, after, exclude).collect()), key=str)
        assert got == frame_by_hand(rows, before, after, exclude)
    with pytest.raises(ValueError, match="exclude"):
        groups_frame(df, ["total"], ["n"], "v", 1, 1, "others")
    assert groups_frame(df.limit(0), ["total"], ["n"], "v", 1, 1).count() == 0
