"""Places in a total order of any size: ranges sorted apart, and how many rows the ranges before have.

No task has more than a range, and a page reads the range that it lies in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Ranked:
    """Rows in ranges of an order, stored at `path` by range; `before` has the rows before each range, and their total at the end."""

    path: str
    order: tuple[Column, ...]
    columns: tuple[str, ...]
    before: tuple[int, ...]
    frame: DataFrame

    @classmethod
    def of(cls, df: DataFrame, order: list[Column], path: str, ranges: int | None = None) -> Ranked:
        """df laid out by ranges of the order, which must be total for places to be the same in every run. ranges: by default as many as shuffles have partitions."""
        spark = df.sparkSession
        n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        laid = df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id())
        laid.write.partitionBy("__range").parquet(path)
        frame = spark.read.schema(laid.schema).parquet(path)
        counts = {r["__range"]: r["n"] for r in frame.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
        before = [0]
        for k in range(max(counts, default=-1) + 1):
            before.append(before[-1] + counts.get(k, 0))
        return cls(path, tuple(order), tuple(df.columns), tuple(before), frame)

    @property
    def total(self) -> int:
        return self.before[-1]

    def rows(self, name: str = "position") -> DataFrame:
        """All rows with their places from 1."""
        return self._placed(self.frame, name)

    def page(self, number: int = 1, size: int = 100, name: str | None = None) -> DataFrame:
        """The rows of a page, in order; only the ranges that it lies in are read."""
        first = (number - 1) * size
        own = [k for k in range(len(self.before) - 1) if self.before[k] < first + size and self.before[k + 1] > first]
        read = self.frame.sparkSession.read.schema(self.frame.schema).option("basePath", self.path)
        rows = self._placed(read.parquet(*[f"{self.path}/__range={k}" for k in own]) if own else self.frame.limit(0), "__place")
        rows = rows.filter((F.col("__place") > first) & (F.col("__place") <= first + size)).orderBy("__place")
        return rows.withColumnRenamed("__place", name) if name else rows.drop("__place")

    def _placed(self, df: DataFrame, name: str) -> DataFrame:
        offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in self.before]), F.col("__range") + 1)
        w = Window.partitionBy("__range").orderBy(*self.order)
        return df.withColumn(name, offset + F.row_number().over(w)).select(*self.columns, name)
