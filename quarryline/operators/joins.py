"""Joins that need a plan of their own: containment in JSON arrays, and history as of a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import json_list
from ..plans.model import is_open


def array_items(column: Column, scalars: bool = False) -> Column:
    """Distinct items of a JSON array column; with scalars, a plain value is its own item; null has none."""
    items = F.coalesce(json_list(column), F.array(column.cast("string"))) if scalars else json_list(column)
    return F.array_distinct(items)


def json_array_contains(left: DataFrame, right: DataFrame, value: str, array: Column, how: str = "left", prefix: str = "") -> DataFrame:
    """left rows with the right rows whose JSON array holds prefix + value; each pair once. An equi-join on the exploded array."""
    items = right.withColumn("__item", F.explode(array_items(array)))
    return left.join(items, F.concat(F.lit(prefix), left[value].cast("string")) == items["__item"], how).drop("__item")


def scalar_or_array_contains(left: DataFrame, right: DataFrame, value: str, column: str, how: str = "left") -> DataFrame:
    """As above, the right column being a JSON array or a plain value; null matches nothing."""
    items = right.withColumn("__item", F.explode(array_items(F.col(column), scalars=True)))
    return left.join(items, left[value].cast("string") == items["__item"], how).drop("__item")


#: Keys with more rows than this are cut into blocks of time; at most HEAVY_KEYS are (any other has less than that part of all rows).
HEAVY_ROWS, HEAVY_KEYS = 1_000_000, 10_000
#: Bytes that a row has at the least in the planner's sizes: smaller inputs can't have a key of HEAVY_ROWS, and aren't looked through for one.
ROW_BYTES = 16


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of a table's size; without statistics, a very large number."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def as_of(left: DataFrame, history: DataFrame, key: list[tuple[str, str]], at: str, valid_from: str = "valid_from", valid_to: str = "valid_to", heavy_rows: int = HEAVY_ROWS, cuts: int = 256) -> DataFrame:
    """left rows with the history row that holds at their time, or nulls: valid_from <= time, and open or valid_to > time.

    A merge: rows and versions of a key in one order of time, where each row takes the last version
    before it; so the work is that of a sort, however many of both a key has. A key of more than heavy_rows is
    cut at about `cuts` of its times; what a block begins with comes from a small table of
    what the blocks before end with. The versions of a key mustn't overlap, as every history load
    keeps them (`overlapping` finds those that do); versions that never hold are ignored.
    Null keys and null times have no version; keys without versions stay, with nulls.
    """
    ks = [f"__k{i}" for i in range(len(key))]
    kind = left.schema[at].dataType
    since, until = F.col(valid_from).try_cast(kind), F.when(~is_open(F.col(valid_to)), F.col(valid_to).try_cast(kind))
    version = F.struct(F.struct(*history.columns).alias("row"), since.alias("since"), until.alias("until"))
    events = left.select(*[F.col(a).alias(k) for (a, _), k in zip(key, ks, strict=True)], F.col(at).alias("__t"), F.lit(1).alias("__kind"), F.struct(*left.columns).alias("__left"))
    versions = history.filter(since.isNotNull() & (is_open(F.col(valid_to)) | (until > since)))
    versions = versions.select(*[F.col(b).alias(k) for (_, b), k in zip(key, ks, strict=True)], since.alias("__t"), F.lit(0).alias("__kind"), version.alias("__version"))
    versions = versions.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in ks]))
    rows = events.unionByName(versions, allowMissingColumns=True)

    holds = F.col("__version.until").isNull() | (F.col("__version.until") > F.col("__t"))
    result = F.when(F.col("__t").isNotNull() & holds, F.col("__version.row")).alias("__row")
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in ks])
    spread = F.when(no_key, -1 - F.pmod(F.xxhash64("__left"), F.lit(1024)))
    order = Window.partitionBy(*ks, "__block").orderBy(F.col("__t").asc_nulls_first(), "__kind", F.col("__version.until").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    if plan_bytes(left) + plan_bytes(history) < heavy_rows * ROW_BYTES:
        merged = rows.withColumn("__block", F.coalesce(spread, F.lit(0)))
        return merged.withColumn("__version", F.last("__version", ignorenulls=True).over(order)).filter("__kind = 1").select("__left", result).select("__left.*", "__row.*")

    # Both small tables are of at most HEAVY_KEYS keys.
    heavy = rows.groupBy(*ks).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > heavy_rows)
    heavy = heavy.filter(reduce(Column.__and__, [F.col(k).isNotNull() for k in ks])).orderBy(F.desc("__n"), *ks).limit(HEAVY_KEYS)
    some = F.pmod(F.xxhash64("__t"), F.greatest(F.expr(f"__n div {cuts}"), F.lit(1))) == 0
    ends = rows.select(*ks, "__t").join(F.broadcast(heavy), ks).filter(some & F.col("__t").isNotNull()).groupBy(*ks).agg(F.array_sort(F.collect_set("__t")).alias("__cuts"))
    block = spread.when(F.col("__cuts").isNull() | F.col("__t").isNull(), 0).otherwise(F.size(F.filter("__cuts", lambda c: c <= F.col("__t"))))
    blocked = rows.join(F.broadcast(ends), ks, "left").withColumn("__block", block)

    last = blocked.filter((F.col("__kind") == 0) & F.col("__cuts").isNotNull()).groupBy(*ks, "__block").agg(F.max_by("__version", F.struct(F.col("__t"), F.col("__version.until").isNull(), F.col("__version.until"))).alias("__version"))
    every = ends.select(*ks, F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__block"))
    before = Window.partitionBy(*ks).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.join(last, [*ks, "__block"], "left").withColumn("__version", F.last("__version", ignorenulls=True).over(before)).filter(F.col("__version").isNotNull())
    carry = carry.withColumn("__t", F.col("__version.since")).withColumn("__kind", F.lit(0))

    merged = blocked.drop("__cuts").unionByName(carry, allowMissingColumns=True).withColumn("__version", F.last("__version", ignorenulls=True).over(order)).filter("__kind = 1")
    return merged.select("__left", result).select("__left.*", "__row.*")


def overlapping(history: DataFrame, key: list[str], valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Versions that begin before an earlier version of their key has ended."""
    w = Window.partitionBy(*key).orderBy(valid_from, F.col("__until").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    kind = history.schema[valid_from].dataType
    until = F.when(~is_open(F.col(valid_to)), F.col(valid_to).try_cast(kind))
    rows = history.withColumn("__until", until).filter(F.col(valid_from).isNotNull() & (F.col("__until").isNull() | (F.col("__until") > F.col(valid_from))))
    open_before, latest = F.max(F.col("__until").isNull()).over(w), F.max("__until").over(w)
    return rows.withColumn("__late", F.coalesce(open_before | (latest > F.col(valid_from)), F.lit(False))).filter("__late").drop("__late", "__until")


def related(parents: DataFrame, children: DataFrame, key: str, fk: str) -> DataFrame:
    """Children of the given parents."""
    return children.join(parents.select(F.col(key).alias(fk)).distinct(), fk, "left_semi")
