"""Tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Formats and the options that keep a table's values whole.
OPTIONS = {
    "parquet": {},
    "orc": {},
    "json": {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"},
    "csv": {"header": "true", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "escape": '"', "multiLine": "true"},
    "xml": {"rowTag": "row", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"},
}


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | None = None) -> DataFrame:
    reader = spark.read.format(kind).options(**OPTIONS[kind])
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write df, in a folder for each value of the given columns if there are any."""
    writer = df.write.format(kind).options(**OPTIONS[kind]).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> None:
    """A table whose joins and groupings on `by` need no shuffle."""
    df.write.bucketBy(buckets, by).sortBy(by).mode("overwrite").saveAsTable(name)
