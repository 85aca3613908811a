"""Event ingest as a stream that takes what is there and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_new_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def dedupe(stream: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each key once; the state forgets keys older than the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def ingest_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new since the checkpoint, stamped with inserted_at, and end."""
    stamped = stream.withColumn("inserted_at", F.current_timestamp())
    return stamped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and key, closed by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
