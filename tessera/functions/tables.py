"""Table functions: called in SQL with a whole table, which Spark deals to tasks by the PARTITION BY of the call."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class Runs:
    """Runs of equal values in a partition's order: runs(TABLE(t) PARTITION BY k ORDER BY (at), 'k', 'value', 'at').

    One row for each run: k, value, begins, ends (the first and last `at`) and n, with the types of the table's own columns, which are
    looked up when the call is analysed.  Null values are equal to each other; null keys are a partition; an empty table gives none.
    A partition's task holds one open run, whatever the partition's size.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, at: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table: TABLE(t) PARTITION BY .. ORDER BY (..)")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        for name in (key, value, at):
            if not name.isConstantExpression or name.value not in kinds:
                raise ValueError(f"no column {name.value} among {sorted(kinds)}")
        if len({key.value, value.value, "begins", "ends", "n"}) < 5:
            raise ValueError("the key and the value are two columns, not named begins, ends or n")
        schema = StructType().add(key.value, kinds[key.value]).add(value.value, kinds[value.value])
        return AnalyzeResult(schema.add("begins", kinds[at.value]).add("ends", kinds[at.value]).add("n", LongType()))

    def __init__(self) -> None:
        self.run: list | None = None

    def eval(self, row, key: str, value: str, at: str) -> Iterator[tuple]:
        run = self.run
        if run and run[1] == row[value]:
            run[3] = row[at]
            run[4] += 1
            return
        self.run = [row[key], row[value], row[at], row[at], 1]
        if run:
            yield tuple(run)

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    spark.udtf.register("runs", udtf(Runs))
