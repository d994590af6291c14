"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset on a local master (tests) is a temporary folder made and set; a cluster must name one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf)
        atexit.register(shutil.rmtree, conf[len("file://") :], True)
    return conf


_scratch: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends at a file that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes in here is deleted at the end, when nothing that reads it may be left to run."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            delete(spark, path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened where a column of that name, in any case, is there already."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def for_worker(name: str, make: Callable):
    """make(), once for each Python worker: functions travel by value, so their own globals end with a task.

    A worker outlives queries, so it keeps the memory of one name alone: another operator's goes when this one's is made."""
    kept = sys.modules.setdefault("_tessera_worker", types.ModuleType("_tessera_worker"))
    if getattr(kept, "name", None) != name:
        kept.name, kept.value = name, None
        kept.value = make()
    return kept.value


def latest_for_worker(name: str, key: str, make: Callable):
    """make(), once for each Python worker and key; only the latest key's object is kept."""
    kept = for_worker(name, dict)
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest reachable node.

    Alternating large-star and small-star steps: every round is two grouped minima and two
    equi-joins, so no task holds a component; a hub's rows are split by AQE's skew join.
    Rounds grow with the logarithm of the number of nodes; they end when one changes nothing.
    """
    cur = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(cur)
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = mark(cur)
        if after == before:
            break
        before = after
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
