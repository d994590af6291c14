import pytest

import __spark_entry__ as entry
from tessera.plans import advanced, analytics, queries  # noqa: F401  registers them
from tessera.plans.registry import ORACLES, QUERIES

from .conftest import MID, SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, agrees, name):
    agrees(QUERIES[name](spark, MID), ORACLES[name], MID)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_reads_given_tables_or_what_is_derived_from_them(spark, name, tmp_path_factory):
    files = QUERIES[name](spark, SMALL).inputFiles()
    if name in ("source_connector", "script_roots"):  # a connector has no files to tell of, a script's result is rows
        return
    assert files
    if not name.startswith(("source_", "script_", "agg_sketches", "join_recursive")):
        assert all(f.startswith(f"file://{SMALL}/") for f in files)


def test_every_twin_has_its_query():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


def test_approximate_aggregates_are_within_their_bounds(spark):
    from pyspark.sql import functions as F

    got = {r["s_nationkey"]: r for r in QUERIES["agg_approximate"](spark, SMALL).collect()}
    lineitem, supplier = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("lineitem", "supplier"))
    joined = lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    exact = joined.groupBy("s_nationkey").agg(F.count_distinct("l_partkey").alias("n"), F.sort_array(F.collect_list("l_extendedprice")).alias("prices"))
    for r in exact.collect():
        near = got[r["s_nationkey"]]
        assert abs(near["parts"] - r["n"]) <= max(3, 3 * 0.02 * r["n"])  # three deviations of the 2 % asked for
        for q, price in zip((0.5, 0.95), near["prices"], strict=True):
            rank = sum(p <= price for p in r["prices"]) / len(r["prices"])
            assert abs(rank - q) <= 1 / 1000 + 1 / len(r["prices"])


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_forecast"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan
    assert plan.count("Exchange") <= 1
