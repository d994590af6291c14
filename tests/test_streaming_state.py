import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import events as S
from tessera.streaming import state

from .conftest import SMALL
from .test_streaming import drained, in_order, same


@pytest.fixture(autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def to_files(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_sessions_close_themselves_and_go_on_after_a_restart(spark, tmp_path):
    path, batch = in_order(spark, tmp_path)
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    aside = tmp_path / "aside"
    aside.mkdir()
    for f in files[2:]:
        f.rename(aside / f.name)
    to_files(state.closing_sessions(S.event_stream(spark, path)), tmp_path)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    for f in files[2:]:
        (aside / f.name).rename(f)
    to_files(state.closing_sessions(S.event_stream(spark, path)), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").where("user_id >= 0")
    wanted = S.user_sessions(batch)
    assert 0 < first < wanted.count() and same(got, wanted)


def test_rows_in_any_order_make_the_same_sessions(spark, tmp_path):
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    shuffled = df.unionAll(df.limit(100)).withColumn("user_id", F.when(F.col("user_id") > 2, F.col("user_id")))
    shuffled.orderBy(F.xxhash64("event_id")).repartition(3).write.parquet(f"{tmp_path}/in")
    end = df.limit(1).selectExpr("-1L AS event_id", "ts + INTERVAL 900 DAY AS ts", "-1L AS user_id", "'end' AS event_type", "value", "props")
    time.sleep(0.1)
    end.unionAll(end.withColumn("ts", F.lit(None).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = state.closing_sessions(S.event_stream(spark, f"{tmp_path}/in"), late="800 days")
    got = drained(stream, "any_order", "append").where("user_id IS NULL OR user_id >= 0")
    assert same(got, S.user_sessions(shuffled.withColumn("ts", F.col("ts").cast("timestamp"))))


@pytest.mark.parametrize(("live", "wanted"), [("1 hour", [50, 50]), ("1 second", [50, 100])])
def test_ids_are_remembered_for_their_time_alone(spark, tmp_path, live, wanted):
    df, counts = spark.read.parquet(f"{SMALL}/events.parquet").where("event_id < 50"), []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for _ in wanted:
        df.unionAll(df.limit(5)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        to_files(state.first_within(S.event_stream(spark, f"{tmp_path}/in"), live), tmp_path)
        counts.append(spark.read.parquet(f"{tmp_path}/out").count())
        time.sleep(1.5)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert counts == wanted


@pytest.mark.parametrize("late", ["1 hour", "31 days"])
def test_late_rows_are_dropped_and_counted(spark, tmp_path, late):
    """Events dealt round robin to four files: the later ones are behind the watermark of the first, or within 31 days of it."""
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(4):
        df.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = S.event_stream(spark, f"{tmp_path}/in").withWatermark("ts", late).dropDuplicates(["event_id", "ts"])
    q = stream.writeStream.format("memory").queryName(f"late_{late[0]}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    account = state.late_rows(q)
    dropped, kept = sum(a["dropped"] for a in account), spark.table(f"late_{late[0]}").count()
    assert sum(a["rows"] for a in account) == df.count() == kept + dropped
    assert account[0]["dropped"] == 0
    assert (dropped > 400) if late == "1 hour" else (dropped == 0)


def test_late_windows_are_in_the_account(spark, tmp_path):
    """The append cases: behind an hour's watermark windows are lost, and what is lost is told; behind 31 days none closes."""
    df = spark.read.parquet(f"{SMALL}/events.parquet")
    for i in range(4):
        df.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = {tuple(r) for r in S.tumbling_counts(df.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    found = {}
    for late in ("1 hour", "31 days"):
        stream = S.tumbling_counts(S.event_stream(spark, f"{tmp_path}/in"), late=late)
        q = stream.writeStream.format("memory").queryName(f"windows_{late[0]}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        found[late] = ({tuple(r) for r in spark.table(f"windows_{late[0]}").collect()}, sum(a["dropped"] for a in state.late_rows(q)))
    hour, dropped = found["1 hour"]
    assert 0 < len(hour) < len(whole) and dropped > 0
    assert found["31 days"] == (set(), 0)
