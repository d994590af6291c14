"""Streaming forms of the event queries; each has the rows of its batch twin once all events have come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Events from the Parquet files of a folder, with ts as an instant, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by window and type; windows close once the watermark passes them."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("begins"), "event_type", "n")
    )


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return (
        events.groupBy("user_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("s.start").alias("begins"), F.col("s.end").alias("ends"), "n")
    )


def first_seen(events: DataFrame, within: str = "31 days") -> DataFrame:
    """One event of each id; the state of an id is dropped once the watermark passes it."""
    if events.isStreaming:
        return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def click_to_purchase(events: DataFrame, within: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Clicks and the same user's purchases up to an hour later: a stream-stream join bounded in time."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    a = events.where("event_type = 'click'").select(F.col("user_id").alias("click_user"), F.col("ts").alias("clicked"), F.col("event_id").alias("click_id"))
    b = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"), F.col("event_id").alias("purchase_id"))
    near = F.expr(f"click_user = user_id AND bought >= clicked AND bought <= clicked + INTERVAL {within}")
    return a.join(b, near).select("user_id", "click_id", "purchase_id", "clicked", "bought")


def nth_of_user(events: DataFrame) -> DataFrame:
    """Each event with its number among its user's, in order of time: custom state of one count for each user.

    Events must come in order of time from batch to batch, as event_stream() reads them; inside a batch they are sorted."""
    if not events.isStreaming:
        along = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return events.select("user_id", "event_id", F.row_number().over(along).cast("long").alias("nth"))

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        batch = pd.concat(frames).sort_values(["ts", "event_id"])
        state.update((n + len(batch),))
        yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"], "nth": range(n + 1, n + len(batch) + 1)})

    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(
        number, "user_id long, event_id long, nth long", "n long", "append", GroupStateTimeout.NoTimeout
    )


def keep_latest(events: DataFrame, path: str, checkpoint: str, by: str = "user_id", buckets: int = 64) -> StreamingQuery:
    """A sink of the latest event of each key, read back by latest_kept().

    Keys are dealt to buckets by hash.  A batch reads and writes anew the buckets that it touches, in a folder of its own, and then a
    small file that says in which batch each bucket was written last; before that file is there, nothing of the batch is seen.  A batch that is run
    again after a failure writes the same folder and file anew, so every batch counts once.  Buckets that neither this batch's
    file nor the one before names are deleted.  Null keys are a key; rows without a time lose against any other.
    """
    row = [c for c in events.columns if c != by]
    bucket = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int").alias("_bucket")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, older = kept_in(spark, path, number - 1), kept_in(spark, path, number - 2)
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most the number of buckets
        if parts := [f"{path}/{before[b]}/_bucket={b}" for b in touched if b in before]:
            batch = batch.unionByName(spark.read.schema(events.schema).parquet(*parts))
        latest = batch.groupBy(by).agg(F.max_by(F.struct(*row), F.struct("ts", "event_id")).alias("r")).select(by, "r.*")
        latest.select(*events.columns, bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{number}")
        after = {**before, **dict.fromkeys(touched, number)}
        rows = spark.createDataFrame(list(after.items()), "bucket int, batch long")
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/current/{number}")
        for b, version in older.items():
            if version not in (before.get(b), after.get(b)):
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/_bucket={b}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_in(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """In which batch each bucket was written last, as of a batch."""
    if number < 0:
        return {}
    return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch long").json(f"{path}/current/{number}").collect()}


def latest_kept(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table that keep_latest() has written last, as a whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    found = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getParent().getName()) for f in found.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current/*/_SUCCESS"))]
    parts = [f"{path}/{version}/_bucket={b}" for b, version in kept_in(spark, path, max(done, default=-1)).items()]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
