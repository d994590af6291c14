from pyspark.sql import functions as F

from tessera.streaming import events as S


def parts(spark, tmp_path, n=4):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    df.withColumn("p", F.col("event_id") % n).repartition(n, "p").drop("p").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def same(a, b):
    return sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


def test_windows_and_sessions_equal_their_batch_twins(spark, tmp_path):
    path, batch = parts(spark, tmp_path)
    assert same(drained(S.tumbling_counts(S.event_stream(spark, path)), "tumbling", "complete"), S.tumbling_counts(batch))
    assert same(drained(S.user_sessions(S.event_stream(spark, path), late="40 days"), "sessions", "complete"), S.user_sessions(batch))


def test_dedup_and_stream_join(spark, tmp_path):
    path, batch = parts(spark, tmp_path)
    batch.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(path)
    assert drained(S.first_seen(S.event_stream(spark, path, 99)), "seen", "append").count() == batch.count()
    path, batch = parts(spark, tmp_path / "two")
    got = drained(S.click_to_purchase(S.event_stream(spark, path, 99)), "bought", "append")
    assert same(got, S.click_to_purchase(batch))


def in_order(spark, tmp_path, n=4):
    """Events in n files by time, and a last one far ahead that lets the watermark pass all others."""
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    bounds = df.approxQuantile("event_id", [i / n for i in range(1, n)], 0.0)
    for i, (low, high) in enumerate(zip([-1, *bounds], [*bounds, 1e18], strict=True)):
        df.where((F.col("event_id") > low) & (F.col("event_id") <= high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = df.orderBy("event_id").limit(1).selectExpr("-1L AS event_id", "ts + INTERVAL 400 DAY AS ts", "-1L AS user_id", "'end' AS event_type", "value", "props")
    late.select(*df.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_append_mode_emits_every_closed_window(spark, tmp_path):
    path, batch = in_order(spark, tmp_path)
    assert same(drained(S.tumbling_counts(S.event_stream(spark, path)), "closed", "append"), S.tumbling_counts(batch))
    assert same(drained(S.user_sessions(S.event_stream(spark, path)), "ended", "append"), S.user_sessions(batch))


def test_custom_state_numbers_events(spark, tmp_path):
    path, batch = in_order(spark, tmp_path)
    got = drained(S.nth_of_user(S.event_stream(spark, path)), "numbered", "append").where("user_id >= 0")
    assert same(got, S.nth_of_user(batch))


def test_sink_keeps_the_latest_of_each_key(spark, tmp_path):
    path, batch = in_order(spark, tmp_path)
    stream = S.event_stream(spark, path).where("user_id >= 0 AND (user_id < 3 OR event_id < 600)")  # some keys rest later
    S.keep_latest(stream, f"{tmp_path}/out", f"{tmp_path}/check", buckets=8).awaitTermination()
    got = S.latest_kept(spark, f"{tmp_path}/out", stream.schema)
    kept = batch.where("user_id < 3 OR event_id < 600")
    want = kept.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    assert same(got.select("user_id", "event_id"), want) and got.columns == stream.columns
    last = max(int(p.name) for p in (tmp_path / "out" / "current").iterdir())
    folders = [p for p in (tmp_path / "out").glob("*/_bucket=*")]
    live = {(str(v), f"_bucket={b}") for n in (last, last - 1) for b, v in S.kept_in(spark, f"{tmp_path}/out", n).items()}
    assert len({n for n, _ in live}) > 1 and live <= {(p.parent.name, p.name) for p in folders} and len(folders) < 4 * 8
    assert S.latest_kept(spark, f"{tmp_path}/nothing", stream.schema).count() == 0
