import random

import pytest

from pyspark.sql import functions as F

from tessera.functions import dates, tables
from tessera.functions.text import ascii_lower


def test_dates_by_boundary_and_by_whole_units(spark):
    rows = [("2024-01-31 23:59:59.75", "2024-02-01 00:00:00"), ("2024-01-31 00:00:00", "2024-02-29 00:00:00"), ("2023-12-31 12:00:00", "2024-01-01 11:00:00"), ("2024-05-05 00:00:00", "2024-05-06 00:00:00"), (None, "2024-01-01 00:00:00"), ("1969-12-31 23:59:59.5", "1971-12-30 00:00:00")]
    df = spark.createDataFrame(rows, "a string, b string").selectExpr("a::timestamp_ntz AS a", "b::timestamp_ntz AS b")
    got = df.select(dates.second_of("a"), dates.weekday("a"), dates.months_crossed("a", "b"), dates.whole_months("a", "b"), dates.quarters_crossed("a", "b"), dates.weeks_crossed("a", "b"), dates.whole_years("a", "b"))
    assert [tuple(r) for r in got.collect()] == [
        (59.75, 3, 1, 0, 0, 0, 0),
        (0.0, 3, 1, 0, 0, 4, 0),
        (0.0, 0, 1, 0, 1, 1, 0),
        (0.0, 0, 0, 0, 0, 1, 0),
        (None,) * 7,
        (59.5, 3, 24, 23, 8, 104, 1),
    ]


def test_runs_of_a_table_function(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.choice(["x", "x", None, "y"])) for i in range(200)]
    spark.createDataFrame(rows, "k string, at int, v string").createOrReplaceTempView("run_rows")
    tables.register(spark)
    wanted = []
    for k in ("a", "b", None):
        run = None
        for _, at, v in (x for x in rows if x[0] == k):
            if run and run[1] == v:
                run[3], run[4] = at, run[4] + 1
            else:
                run = [k, v, at, at, 1]
                wanted.append(run)
    got = spark.sql("SELECT * FROM runs(TABLE(run_rows) PARTITION BY k ORDER BY (at), 'k', 'v', 'at')")
    assert got.schema.simpleString() == "struct<k:string,v:string,begins:int,ends:int,n:bigint>"
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, wanted)))
    assert spark.sql("SELECT * FROM runs(TABLE(SELECT * FROM run_rows WHERE at < 0) PARTITION BY k ORDER BY (at), 'k', 'v', 'at')").count() == 0
    for call in ("'k', 'nothing', 'at'", "'k', 'k', 'at'"):
        with pytest.raises(Exception, match="no column nothing|two columns"):
            spark.sql(f"SELECT * FROM runs(TABLE(run_rows) PARTITION BY k ORDER BY (at), {call})")


def test_ascii_lower_leaves_other_letters(spark):
    rows = [("ABC xyz-Z[`{@",), ("ÀÉ A Z İ ẞ Σ",), ("",), (None,), ("\x00K\x7f",), ("😀Q",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(ascii_lower(F.col("t"))).collect()]
    assert got == [t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for (t,) in rows]
