"""Comparing and checking tables: diffs, parity, keys, versions, timelines, run logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyed_diff(old: DataFrame, new: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """(key.., change) created, updated or deleted between two snapshots; equal rows are left out, null keys are equal."""
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in key], F.struct(*compare).alias("o"), F.lit(True).alias("__o"))
    n = new.select(*[F.col(k).alias(f"n_{k}") for k in key], F.struct(*compare).alias("n"), F.lit(True).alias("__n"))
    both = o.join(n, reduce(Column.__and__, [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key]), "full_outer")
    change = F.when(F.col("__o").isNull(), "created").when(F.col("__n").isNull(), "deleted").when(~F.col("o").eqNullSafe(F.col("n")), "updated")
    return both.select(*[F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in key], change.alias("change")).filter("change is not null")


def bucket_digests(df: DataFrame, key: list[str], compare: list[str], buckets: int) -> DataFrame:
    """(bucket, n, digest): how many rows of keys of each bucket there are, and a digest of their values, whatever their order."""
    h = F.xxhash64(*key, *compare)
    rows = df.select(_bucket(key, buckets).alias("bucket"), h.alias("a"), F.xxhash64(F.lit("second"), *key, *compare).alias("b"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.struct(F.bit_xor("a").alias("a"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")).alias("digest"))


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets))


def digest_diff(old: DataFrame, new: DataFrame, key: list[str], compare: list[str], buckets: int = 4096) -> DataFrame:
    """As keyed_diff, by digests first: both sides are summed up per bucket of keys, and only the rows of buckets that differ are joined.

    The table of buckets is what is broadcast, at most `buckets` rows. Rows with the types of both sides alike are compared.
    """
    kinds = {c: new.schema[c].dataType for c in [*key, *compare]}
    old = old.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if old.schema[c].dataType != t})
    a, b = (bucket_digests(df, key, compare, buckets) for df in (old, new))
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest"))
    differ = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer").filter(~same).select(F.coalesce("a.bucket", "b.bucket").alias("__bucket"))
    some = lambda df: df.withColumn("__bucket", _bucket(key, buckets)).join(F.broadcast(differ), "__bucket", "left_semi").drop("__bucket")
    return keyed_diff(some(old), some(new), key, compare)


def column_stats(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null) of each column, in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"z_{c}") for c in df.columns])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"z_{c}").alias("n_null")) for c in df.columns])).alias("s")).select("s.column", F.col("n").alias("n_rows"), "s.n_null")


def table_stats(tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table, present, n_rows) of each named table; one that is missing (None) has null rows."""
    there = {n: df for n, df in tables.items() if df is not None}
    spark = next(iter(there.values())).sparkSession if there else SparkSession.active()
    names = spark.createDataFrame([(n, df is not None) for n, df in tables.items()], "table string, present boolean")
    if not there:
        return names.withColumn("n_rows", F.lit(None).cast("long"))
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in there.items()])
    return names.join(counts, "table", "left")


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row and null counts of two tables side by side, and whether they agree."""
    a = column_stats(left).toDF("column", "left_rows", "left_null")
    b = column_stats(right).toDF("column", "right_rows", "right_null")
    same = F.col("left_rows").eqNullSafe(F.col("right_rows")) & F.col("left_null").eqNullSafe(F.col("right_null"))
    return a.join(b, "column", "full_outer").withColumn("same", same)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Children whose foreign key isn't null and has no parent."""
    return children.filter(F.col(fk).isNotNull()).join(parents.select(F.col(key).alias(fk)).distinct(), fk, "left_anti")


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def drop_noop_versions(df: DataFrame, key: list[str], version: str, content: list[str]) -> DataFrame:
    """Versions whose content hash differs from the one before."""
    before = F.lag("__h").over(Window.partitionBy(*key).orderBy(version))
    return df.withColumn("__h", F.sha2(F.to_json(F.struct(*content)), 256)).withColumn("__b", before).filter(~F.col("__h").eqNullSafe(F.col("__b"))).drop("__h", "__b")


def failures_since_success(log: DataFrame, key: list[str], failed: Column, succeeded: Column, time: str) -> DataFrame:
    """(key.., failures) after the last success of each key, or all if there is none."""
    last = log.groupBy(*key).agg(F.max(F.when(succeeded, F.col(time))).alias("__last"))
    rows = log.join(last, key)
    return rows.groupBy(*key).agg(F.count_if(failed & (F.col("__last").isNull() | (F.col(time) > F.col("__last")))).alias("failures"))


def timeline(sources: list[DataFrame], time: str, key: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the union of event sources, newest first, with has_more."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    order = [F.col(time).desc(), *key]
    rows = every.orderBy(*order).offset(offset).limit(limit + 1)  # one more tells whether there are more
    numbered = rows.withColumn("__n", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.max("__n").over(Window.partitionBy(F.lit(0))) > limit)
    return numbered.filter(F.col("__n") <= limit).drop("__n")


def record_with_counts(df: DataFrame, key: str, value, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """One record and the number of its children in each relation."""
    out = df.filter(F.col(key) == value)
    for name, (rows, fk) in children.items():
        n = rows.filter(F.col(fk) == value).groupBy(F.col(fk).alias("__k")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(n, out[key] == F.col("__k"), "left").drop("__k").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out
