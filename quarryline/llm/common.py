"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import ship

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder that the cluster names. Where none is set, a local one serves a local master only."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that lost executors don't lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared checkpoint folder and read again: smaller than a checkpoint, and read by columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(column: str = "doc_id") -> Column:
    """crc32 of the id as text: the fold key of every train/held-out split."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key with more rows than this is joined by broadcast, and at most BROADCAST_KEYS such keys are.
HEAVY_ROWS, BROADCAST_KEYS = 1000, 100_000


def join_heavy(rows: DataFrame, keyed: DataFrame, on: str, n: str = "n") -> DataFrame:
    """rows joined to `keyed`, which has one row per key and in `n` how many of rows have it.

    Keys of many rows are joined by broadcast, so that their rows stay where they are; the others
    by shuffle. If there are more than BROADCAST_KEYS such keys, only those with more than
    their share of all rows are broadcast, which are again at most so many.
    """
    heavy, total = keyed.agg(F.count_if(F.col(n) > HEAVY_ROWS), F.sum(n)).first()
    if not heavy:
        return rows.join(keyed.drop(n), on)
    limit = HEAVY_ROWS if heavy <= BROADCAST_KEYS else total // BROADCAST_KEYS
    top = keyed.filter(F.col(n) > limit).drop(n)
    rest = rows.join(F.broadcast(top.select(on)), on, "left_anti").join(keyed.filter(F.col(n) <= limit).drop(n), on)
    return rows.join(F.broadcast(top), on).unionByName(rest)
