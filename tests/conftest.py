import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", f"file://{tmp_path_factory.mktemp('warehouse')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


def plain(x):
    if not isinstance(x, (list, tuple)) and pd.isna(x):
        return "null"
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return str(x)


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def agrees():
    """Does a DataFrame have the rows of its SQL twin over the tables of a folder?"""

    def check(df, sql, sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        got, expected = rows_of(df.toPandas()), rows_of(con.execute(sql).df())
        assert got[0] == expected[0]
        assert got[1] == expected[1]

    return check
