"""Distinct counts whose partial results can be merged: over children, over frames, over anything grouped again.

The state of a group is a bitmap for each bucket of 32,768 keys that it has (whole numbers), or its distinct values
themselves (anything else, and numbers that lie far apart). Merging ORs bitmaps; the count is that of the bits, so it is exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WHOLE = ("tinyint", "smallint", "int", "bigint")


def state(df: DataFrame, by: list[str], value: str, bitmaps: bool | None = None) -> DataFrame:
    """(by.., __bucket, __bits) or (by.., __value): what a group has of `value`; nulls don't count. bitmaps: by default for whole numbers."""
    rows = df.filter(F.col(value).isNotNull())
    if bitmaps is None:
        bitmaps = df.schema[value].dataType.simpleString() in WHOLE
    if not bitmaps:
        return rows.select(*by, F.col(value).alias("__value")).distinct()
    v = F.col(value).cast("long")
    return rows.groupBy(*by, F.bitmap_bucket_number(v).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("__bits"))


def merge(states: DataFrame, by: list[str]) -> DataFrame:
    """States of coarser groups."""
    if "__bits" in states.columns:
        return states.groupBy(*by, "__bucket").agg(F.bitmap_or_agg("__bits").alias("__bits"))
    return states.select(*by, "__value").distinct()


def count(states: DataFrame, by: list[str], name: str) -> DataFrame:
    """(by.., name) of merged states; a group without values isn't there."""
    n = F.sum(F.bitmap_count("__bits")) if "__bits" in states.columns else F.count(F.lit(1))
    return states.groupBy(*by).agg(n.alias(name))


def rolling(groups: DataFrame, states: DataFrame, name: str, order: str, partition: list[str], frame: int) -> DataFrame:
    """groups with the distinct count of each one's last `frame` groups of its partition, itself included.

    A group's state goes to the frames that it is in, at most `frame` of them, and is merged there; rows aren't looked at again.
    """
    if frame < 1:
        raise ValueError("a frame has a group at the least")
    by = [*partition, order]
    w = Window.partitionBy(*partition).orderBy(order)
    numbered = groups.withColumn("__at", F.row_number().over(w))
    same = lambda columns: reduce(Column.__and__, [F.col(f"g.{c}").eqNullSafe(F.col(f"s.{c}")) for c in columns], F.lit(True))
    rest = [c for c in states.columns if c not in by]
    placed = states.alias("s").join(numbered.select(*by, "__at").alias("g"), same(by)).select(*[F.col(f"s.{c}") for c in [*partition, *rest]], F.explode(F.sequence(F.col("g.__at"), F.col("g.__at") + frame - 1)).alias("__at"))
    counts = count(merge(placed, [*partition, "__at"]), [*partition, "__at"], name)
    out = numbered.alias("g").join(counts.alias("s"), same([*partition, "__at"]), "left")
    return out.select(*[F.col(f"g.{c}") for c in groups.columns], F.coalesce(F.col(f"s.{name}"), F.lit(0)).alias(name))
