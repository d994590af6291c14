import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, Not

from tessera.sources import arrow_log

from .conftest import SMALL


@pytest.fixture(scope="module")
def events(spark):
    arrow_log.register(spark)
    return spark.read.parquet(f"{SMALL}/events.parquet")


def rows_of(df):
    return sorted(map(str, df.collect()))


def written(df, path, mode="append"):
    df.write.format("arrow_log").mode(mode).save(path)


def test_round_trip_of_many_types(spark, events, tmp_path):
    path = str(tmp_path / "t")
    odd = events.selectExpr("*", "ts::date AS day", "event_id % 2 = 0 AS even", "CAST(value AS DECIMAL(12, 3)) AS d", "array(value, null) AS a", "map('k', event_id) AS m", "struct(user_id, ts) AS s", "CAST(props AS BINARY) AS b", "nullif(event_type, 'click') AS maybe")
    written(odd, path)
    back = spark.read.format("arrow_log").load(path)
    assert back.schema.simpleString() == odd.schema.simpleString() and rows_of(back) == rows_of(odd)
    assert back.where("maybe IS NULL AND value > 5").count() == odd.where("maybe IS NULL AND value > 5").count()


def test_versions_append_replace_and_travel(spark, events, tmp_path):
    path = str(tmp_path / "t")
    a, b = events.where("event_id < 300"), events.where("event_id >= 300")
    written(a, path)
    written(b, path)
    read = lambda **o: spark.read.format("arrow_log").options(**o).load(path)
    assert read().count() == events.count() and read(version=0).count() == a.count()
    written(b, path, "overwrite")
    assert rows_of(read()) == rows_of(b) and read(version=1).count() == events.count()
    written(a.limit(0), path, "overwrite")
    assert read().count() == 0


def test_pushed_filters_leave_files_and_rows_out(spark, events, tmp_path):
    path = str(tmp_path / "t")
    written(events.repartitionByRange(8, "event_id"), path)
    source = arrow_log.ArrowLog({"path": path, "splitBytes": "1", "pushdown": "true"})
    reader = source.reader(events.schema)
    left = list(reader.pushFilters([GreaterThan(("event_id",), 900), GreaterThan(("value",), 1.0), Not(EqualTo(("event_id",), 950))]))
    assert [f.attribute for f in left if not isinstance(f, Not)] == [("value",)] and len(left) == 2  # doubles stay with Spark, where NaN is the largest
    assert 0 < len(reader.partitions()) < 8
    assert all(i > 900 for p in reader.partitions() for b in reader.read(p) for i in b.column("event_id").to_pylist())
    conditions = ("event_id = 77", "event_id IN (1, 5, null)", "ts >= timestamp_ntz '2024-01-20' AND event_type = 'click'", "event_type LIKE 'pur%'", "value >= 20 OR event_id < 3", "user_id IS NULL", "NOT event_id <= 990", "event_id = 5.5")
    once = spark.read.format("arrow_log").option("splitBytes", 1)
    for condition in conditions:
        assert rows_of(once.option("pushdown", True).load(path).where(condition)) == rows_of(events.where(condition)), condition
    assert once.option("pushdown", True).load(path).where("event_id = 77").rdd.getNumPartitions() == 1
    shared = spark.read.format("arrow_log").option("splitBytes", 1).load(path)
    for condition in conditions:
        assert rows_of(shared.where(condition)) == rows_of(events.where(condition)), condition
    both = shared.where("event_id < 10").unionAll(shared.where("event_type = 'click'"))
    assert rows_of(both) == rows_of(events.where("event_id < 10").unionAll(events.where("event_type = 'click'")))


def test_scan_takes_conditions_as_values(spark, events, tmp_path):
    path, day = str(tmp_path / "t"), datetime.datetime(2024, 1, 20)
    written(events.repartitionByRange(8, "ts"), path)
    got = arrow_log.scan(spark, path, ("ts", ">=", day), ("event_type", "in", ["click", "error"]), ("event_id", "<", 900))
    wanted = events.where("ts >= timestamp_ntz '2024-01-20' AND event_type IN ('click', 'error') AND event_id < 900")
    assert rows_of(got) == rows_of(wanted) and wanted.count()
    files = arrow_log.Log(path).files()
    left = [f for f in files if arrow_log.may_hold(GreaterThan(("ts",), day), f["bounds"], f["rows"])]
    assert 0 < len(left) < len(files) == 8
    with pytest.raises(Exception, match="no conditions on"):
        arrow_log.scan(spark, path, ("value", ">", 1)).count()


def test_a_failed_write_leaves_nothing(spark, events, tmp_path):
    path = str(tmp_path / "t")
    written(events, path)
    before = sorted(p.name for p in (tmp_path / "t").rglob("*"))
    bad = events.repartition(4).withColumn("value", F.when(F.col("event_id") == 500, F.raise_error(F.lit("broken"))).otherwise(F.col("value")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        written(bad, path)
    assert sorted(p.name for p in (tmp_path / "t").rglob("*")) == before
    assert spark.read.format("arrow_log").load(path).count() == events.count()


def test_commits_never_take_one_number_twice(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    logs = [arrow_log.Log(str(tmp_path)) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda log: [log.add({"schema": "", "replace": False, "files": [], "stream": None, "batch": None}) for _ in range(10)], logs))
    assert sorted(v for g in got for v in g) == list(range(80)) == logs[0].versions()


def test_streams_read_versions_and_go_on_after_a_restart(spark, events, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        stream = spark.readStream.format("arrow_log").load(path)
        q = stream.writeStream.format("arrow_log").option("path", out).option("stream", "copy").option("checkpointLocation", check).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()

    for low, high in ((0, 200), (200, 700), (700, 5000)):
        written(events.where(f"event_id >= {low} AND event_id < {high}").repartition(2), path)
        if low != 200:
            run()
    back = spark.read.format("arrow_log").load(out)
    assert rows_of(back) == rows_of(events)
    run()
    assert spark.read.format("arrow_log").load(out).count() == events.count()
    batches = [arrow_log.Log(out).commit_of(v)["batch"] for v in arrow_log.Log(out).versions()]
    assert batches == sorted(set(batches))


def test_a_batch_that_is_run_again_counts_once(events, tmp_path):
    writer = arrow_log.StreamWriter(str(tmp_path), events.schema, "s")
    batch = events.limit(10).toArrow().to_batches()
    for number in (0, 1, 1, 0):
        writer.commit([writer.write(iter(batch)), None], number)
    log = arrow_log.Log(str(tmp_path))
    assert [f["rows"] for f in log.files()] == [10, 10] and len(log.names("data")) == 2


def test_streams_do_not_go_past_a_replaced_table(events, tmp_path):
    path = str(tmp_path / "t")
    written(events, path)
    written(events, path, "overwrite")
    reader = arrow_log.StreamReader(path, 0, 1)
    with pytest.raises(ValueError, match="replaced"):
        reader.partitions({"version": 0}, reader.latestOffset())
