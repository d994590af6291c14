from pyspark.sql import functions as F

from tessera.operators.aggregates import exact_quantiles, exact_sum, histogram, hundredths
from tessera.operators.joins import as_of_join, range_join, salted_join
from tessera.operators.recursion import descend
from tessera.operators.windows import gap_filled, latest, sessions, top_k
from tessera.sources import files


def test_as_of_join_takes_the_latest_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 3), (None, 2)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 6, 60), ("b", 4, 44)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in as_of_join(left, right, "t", ["k"], ["v"]).collect()}
    assert got == {("a", 5): 40, ("a", 1): 10, ("b", 3): None, (None, 2): None}


def test_as_of_join_of_nulls_names_and_slices(spark):
    import random

    r = random.Random(6)
    pick = lambda *x: r.choice([None, *x])
    a = [(pick("a", "b"), pick(*range(40)), r.randrange(5)) for _ in range(120)]
    b = [(pick("a", "b", "c"), pick(*range(40)), pick(*range(9)), r.randrange(9)) for _ in range(60)]
    left = spark.createDataFrame(a, "k string, t int, _side int")
    right = spark.createDataFrame(b, "k string, t int, v int, _side int")

    def wanted(k, t):
        found = [(x[1], x[2] is not None, x[2] or 0, x[3]) for x in b if k is not None and x[0] == k and t is not None and x[1] is not None and x[1] <= t]
        return (max(found)[2] if max(found)[1] else None, max(found)[3]) if found else (None, None)

    expected = sorted(((k, t, s, *wanted(k, t)) for k, t, s in a), key=str)
    for slices in (None, lambda t: F.floor(t / 7), lambda t: t):
        got = as_of_join(left, right, "t", ["k"], ["v", "_side"], slices)
        assert got.columns == ["k", "t", "_side", "v", "_side_right"] and sorted(map(tuple, got.collect()), key=str) == expected
    assert as_of_join(left.limit(0), right, "t", ["k"], ["v"]).count() == 0
    assert {x["v"] for x in as_of_join(left, right.limit(0), "t", ["k"], ["v"], lambda t: t).collect()} == {None}


def test_range_join_leaves_nulls_and_empty_ranges(spark):
    left = spark.createDataFrame([(1,), (None,), (5,)], "at long").withColumn("_bin", F.lit(0))
    right = spark.createDataFrame([(0, 3), (3, 3), (6, 2), (None, 9), (4, None)], "b long, e long")
    got = range_join(left, right, F.col("at"), F.col("b"), F.col("e"), 4)
    assert [(r.at, r.b) for r in got.collect()] == [(1, 0)] and got.columns == ["at", "_bin", "b", "e"]


def test_range_join_meets_every_pair_once(spark):
    left = spark.range(30).select(F.col("id").alias("at"))
    right = spark.createDataFrame([(0, 7), (5, 6), (6, 25), (9, 9)], "b long, e long")
    got = sorted((r.at, r.b) for r in range_join(left, right, F.col("at"), F.col("b"), F.col("e"), 4).select("at", "b").collect())
    assert got == sorted((a, b) for a in range(30) for b, e in [(0, 7), (5, 6), (6, 25), (9, 9)] if b <= a < e)


def test_salted_join_equals_a_plain_one(spark):
    left = spark.range(200).select(F.when(F.col("id") % 50 > 0, F.col("id") % 3).alias("k"), F.col("id").alias("x"), F.lit(1).alias("_salt"))
    right = spark.createDataFrame([(0, "p"), (1, "q"), (1, "r"), (5, "s"), (None, "t")], "k long, y string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        for hot_rows in (0, 66, 1_000):
            got = salted_join(left, right, ["k"], 4, how, hot_rows)
            assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 9), ("b", 1, 1)], "k string, i int, v int")
    assert sorted((r.k, r.i) for r in top_k(df, ["k"], [F.desc("v"), F.col("i")], 2).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert sorted((r.k, r.v) for r in latest(df, ["k"], "i", "v").collect()) == [("a", 9), ("b", 1)]
    days = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-04", 4)], "k string, d string, v int").withColumn("d", F.to_date("d"))
    assert [r.v for r in gap_filled(days, "k", "d", "v").orderBy("d").collect()] == [1, 1, 1, 4]


def test_exact_quantiles(spark):
    import random

    rng = random.Random(1)
    rows = [(k, rng.choice([1.0, 2.0, rng.random() * 1000])) for k in ("a", "b", None) for _ in range(3000)] + [("c", 5.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.q): r.value for r in exact_quantiles(df, "k", "x", [0.0, 0.1, 0.5, 0.999, 1.0], 100).collect()}
    want = df.where("x is not null").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, [0.0, 0.1, 0.5, 0.999, 1.0]))).alias("v")).collect()
    assert len(got) == 5 * len(want) and all(abs(got[r.k, q] - v) < 1e-9 for r in want for q, v in zip([0.0, 0.1, 0.5, 0.999, 1.0], r.v, strict=True))
    assert exact_quantiles(df.limit(0), "k", "x", [0.5]).count() == 0


def test_sessions_and_histogram(spark):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 30), (None, 1), ("b", None)], "k string, m int").withColumn("t", F.timestamp_seconds(F.col("m") * 60))
    got = sorted((str(r.k), r.n_events, (r.ends - r.begins).seconds // 60) for r in sessions(df, "k", "t", "10 minutes").collect())
    assert got == [("None", 1, 10), ("a", 1, 10), ("a", 2, 15)]
    assert sorted(((r.bin is None, r.bin or 0), r.n) for r in histogram(df, "m", 10).collect()) == [((False, 0), 3), ((False, 3), 1), ((True, 0), 1)]
    assert sessions(df.limit(0), "k", "t", "1 minute").count() == histogram(df.limit(0), "m", 1).count() == 0


def test_formats_keep_values(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for kind in files.OPTIONS:
        files.write(df, f"{tmp_path}/{kind}", kind)
        back = files.read(spark, f"{tmp_path}/{kind}", kind, df.schema)
        assert back.exceptAll(df).count() == 0 and back.count() == df.count()
    files.write(df, f"{tmp_path}/by", by=["event_type"])
    plan = files.read(spark, f"{tmp_path}/by").where("event_type = 'click'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan


def test_bucketed_tables_join_without_a_shuffle(spark):
    files.write_bucketed(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "b_orders", "o_orderkey", 4)
    files.write_bucketed(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "b_lineitem", "l_orderkey", 4)
    joined = spark.table("b_orders").hint("merge").join(spark.table("b_lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE b_orders")
    spark.sql("DROP TABLE b_lineitem")


def test_descent_passes_a_million_rows(spark, tmp_path):
    keys = spark.range(1_500_000).select(F.col("id").alias("k"))
    edges = keys.where("k >= 4").select("k", F.floor(F.col("k") / 4.0).alias("parent"))
    got = descend(keys.where("k < 4"), edges, "k", "parent", f"{tmp_path}/tree")
    assert sorted((r["depth"], r["n"]) for r in got.groupBy("depth").agg(F.count("*").alias("n")).collect())[:3] == [(0, 4), (1, 12), (2, 48)]
    assert got.count() == got.select("k").distinct().count() == 1_500_000


def test_descent_of_nulls_repeats_and_cycles(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (1, 3), (None, 1), (9, None), (7, 8)], "k long, parent long")
    roots = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    got = descend(roots, edges, "k", "parent", f"{tmp_path}/a")
    assert sorted((r["k"], r["depth"]) for r in got.collect()) == [(1, 0), (2, 1), (3, 1)]
    assert descend(roots.limit(0), edges, "k", "parent", f"{tmp_path}/b").count() == 0


def test_quantiles_outside_their_bracket_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([("a", float(i)) for i in range(20)], "k string, x double")
    with pytest.raises(Exception, match="bracket"):
        from tessera.operators import aggregates

        wrong = aggregates.F.percentile_approx
        try:
            aggregates.F.percentile_approx = lambda c, q, n: F.array(F.lit(18.0), F.lit(19.0))
            exact_quantiles(df, "k", "x", [0.5], 10).collect()
        finally:
            aggregates.F.percentile_approx = wrong


def test_no_subquery_is_broadcast_whatever_its_size(spark):
    from tessera.plans import analytics, registry

    assert analytics.TREE

    plan = registry.QUERIES["join_subqueries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and "isnull" not in plan.lower().split("leftanti")[1].split("\n")[0]


def test_exact_sums_do_not_depend_on_order_or_size(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", -0.35), ("a", None), ("b", None), (None, 90071992547.41), (None, 0.03), (None, -12345678901.99)]
    df = spark.createDataFrame(rows, "k string, x double")
    assert {r.k: r.s for r in df.groupBy("k").agg(exact_sum(hundredths("x")).alias("s")).collect()} == {"a": -0.05, "b": None, None: 77726313645.45}
    many = spark.range(1_000_000).select(F.lit(92233720368547.0).alias("x"))  # more than a long of hundredths holds
    assert many.agg(exact_sum(hundredths("x")).alias("s")).first().s == 92233720368547.0 * 1_000_000
