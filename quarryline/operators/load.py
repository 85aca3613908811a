"""Entity loads: mapping, upsert, history, event dedupe, prune."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.model import is_open
from ..sources.ingest import align


def same_key(left: str, right: str, key: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in key])


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def keep_last(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key: the last by `order`; among equals the one whose values come last, so that reruns agree."""
    return keep_first(df, key, [order.desc(), *[F.col(c).cast("string").desc() for c in df.columns if c not in key]])


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: Column) -> DataFrame:
    """existing with new's rows replacing or joining it by key; the last of a batch by `order` wins; columns are united.

    A table that is all key keeps its own rows.
    """
    if not key:
        raise ValueError("an upsert needs a key")
    latest = keep_last(new, key, order)
    old, latest = align(existing, latest)
    kept = old.alias("o").join(latest.alias("n"), same_key("o", "n", key), "left_anti")
    return kept.unionByName(latest)


def staged_overwrite(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones and return its path; readers of the old one aren't disturbed."""
    target = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return target


def append(df: DataFrame, now: Column | None = None) -> DataFrame:
    return df.withColumn("inserted_at", F.current_timestamp() if now is None else now)


def merge_groups(groups: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several sources merged by key: per column the first group's value that isn't null or ''."""
    columns = [c for c in groups[0].columns if c not in key]
    each = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.withColumn("__g", F.lit(k)) for k, g in enumerate(groups)])
    filled = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("__g"))
    return each.groupBy(*key).agg(*[F.min_by(c, filled(c)).alias(c) for c in columns])


def scd2(history: DataFrame, candidates: DataFrame, key: list[str], tracked: list[str], now: Column, valid_from: str = "valid_from", valid_to: str = "valid_to", initial: Column | None = None, order: Column | None = None) -> DataFrame:
    """history after a load: new keys open, changed ones close at `now` and open again, others stay; values compare as text, nulls as equal.

    Of several candidates for a key the last by `order` counts, else the one whose values come last; null keys are equal.
    """
    candidates = keep_last(candidates, key, F.lit(0) if order is None else order)
    open_rows = history.filter(is_open(F.col(valid_to)))
    closed = history.filter(~is_open(F.col(valid_to)))
    names = [*key, *tracked]
    both = open_rows.select(F.struct(*history.columns).alias("old"), *[F.col(k).alias(f"__o_{k}") for k in key]).join(candidates.select(F.struct(*names).alias("new"), *[F.col(k).alias(f"__n_{k}") for k in key]), reduce(Column.__and__, [F.col(f"__o_{k}").eqNullSafe(F.col(f"__n_{k}")) for k in key]), "full_outer")
    differs = reduce(Column.__or__, [~F.col(f"old.{c}").cast("string").eqNullSafe(F.col(f"new.{c}").cast("string")) for c in tracked], F.lit(False))
    fresh, gone = F.col("old").isNull(), F.col("new").isNull()
    changed = ~fresh & ~gone & differs
    kind = history.schema[valid_from].dataType
    kept = both.filter(~fresh).select(F.col("old").withField(valid_to, F.when(changed, now.cast(kind)).otherwise(F.col(f"old.{valid_to}"))).alias("r"))
    since = F.when(fresh, (initial if initial is not None else now).cast(kind)).otherwise(now.cast(kind))
    opened = both.filter(fresh | changed).select(F.struct(*[(F.col(f"new.{c}") if c in names else since if c == valid_from else F.lit(None).cast(history.schema[c].dataType)).alias(c) for c in history.columns]).alias("r"))
    return closed.unionByName(kept.select("r.*")).unionByName(opened.select("r.*"))


def scd2_stats(history: DataFrame, candidates: DataFrame, key: list[str], tracked: list[str], valid_to: str = "valid_to", order: Column | None = None) -> DataFrame:
    """One row: how many keys are new, changed (versioned) and unchanged."""
    candidates = keep_last(candidates, key, F.lit(0) if order is None else order)
    old = history.filter(is_open(F.col(valid_to))).withColumn("__there", F.lit(True)).alias("o")
    differs = reduce(Column.__or__, [~F.col(f"o.{c}").cast("string").eqNullSafe(F.col(f"n.{c}").cast("string")) for c in tracked], F.lit(False))
    on = same_key("o", "n", key)
    fresh = F.col("o.__there").isNull()
    flag = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return candidates.alias("n").join(old, on, "left").agg(flag(fresh).alias("new_keys"), flag(~fresh & differs).alias("versioned"), flag(~fresh & ~differs).alias("unchanged"))


def load_events(existing: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """existing plus the rows of new, once each, that it doesn't have in all columns but inserted_at."""
    identity = [c for c in new.columns if c != "inserted_at"]
    unseen = new.select(*identity).distinct().alias("n").join(existing.alias("e"), same_key("n", "e", identity), "left_anti")
    return existing.unionByName(append(unseen, now))


def prune(target: DataFrame, candidates: DataFrame, key: list[str], failed: DataFrame | None = None) -> DataFrame:
    """target's rows whose key is among the candidates; all of them if any row failed, as the candidates may lack keys then."""
    if failed is not None and not failed.isEmpty():
        return target
    return target.alias("t").join(candidates.select(*key).distinct().alias("c"), same_key("t", "c", key), "left_semi")


def map_rows(source: DataFrame, columns: dict[str, Column], required: list[str] = (), static: dict[str, object] | None = None, fails: dict[str, Column] | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad): mapped rows, and the source rows that failed, with `failed` naming their columns.

    A column fails where it is required and null, or where its condition in `fails` holds; strict
    makes any failure an error.
    """
    bad = {c: F.col(f"__{c}").isNull() for c in required}
    for c, when in (fails or {}).items():
        bad[c] = bad[c] | when if c in bad else when
    names = list(columns)
    out = source.withColumns({f"__{k}": c for k, c in columns.items()})
    failed = F.filter(F.array(*[F.when(when, F.lit(c)) for c, when in bad.items()]), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    out = out.withColumn("__failed", failed)
    good = out.filter(F.size("__failed") == 0).select(*[F.col(f"__{c}").alias(c) for c in names], *[F.lit(v).alias(k) for k, v in (static or {}).items()])
    wrong = out.filter(F.size("__failed") > 0).select(*source.columns, F.col("__failed").alias("failed"))
    if strict and (row := wrong.select("failed").first()):
        raise ValueError(f"a row failed in {row.failed}")
    return good, wrong


def load_stats(parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(target, written, failed) of targets' (good, bad) rows, each worked out for its count; mapper.stats counts the targets of a mapper in one pass."""
    one = lambda name, good, bad: good.select(F.lit(name).alias("target"), F.lit(1).alias("w")).unionByName(bad.select(F.lit(name).alias("target"), F.lit(0).alias("w")))
    every = reduce(DataFrame.unionByName, [one(n, g, b) for n, (g, b) in parts.items()])
    return every.groupBy("target").agg(F.sum("w").cast("long").alias("written"), F.count_if(F.col("w") == 0).alias("failed"))


def fan_out_keys(grain: list[str], joined: DataFrame) -> DataFrame:
    """Grain tuples that occur more than once after the joins."""
    return joined.groupBy(*grain).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_fan_out(grain: list[str], joined: DataFrame) -> None:
    if not fan_out_keys(grain, joined).isEmpty():
        raise ValueError(f"a join repeats rows of grain {grain}")


def since_marks(run_log: DataFrame) -> DataFrame:
    """(task, since): the last successful start of each task."""
    return run_log.filter("status = 'success'").groupBy("task").agg(F.max("started_at").alias("since"))


def since_mark(run_log: DataFrame, task: str, override: str | None = None, declared: str | None = None, param_key: str | None = None) -> str | None:
    """override, else the later of the declared mark and the last successful start, by parameter set, then by task."""
    if override:
        return override
    done = run_log.filter((F.col("task") == task) & (F.col("status") == "success"))
    row = done.agg(F.max(F.when(F.col("param_key") == param_key, F.col("started_at"))).alias("own"), F.max("started_at").alias("any")).first()
    marks = [m for m in (declared, (row.own if param_key is not None else None) or row.any) if m]
    return max(marks) if marks else None


def record_run(log: DataFrame, task: str, started_at: str, ended_at: str, records: int, status: str, param_key: str | None = None) -> DataFrame:
    """The run log with one more run; a column that it lacks is added."""
    row = log.sparkSession.createDataFrame([(task, started_at, ended_at, records, status, param_key)], "task string, started_at string, ended_at string, records long, status string, param_key string")
    old, new = align(log, row)
    return old.unionByName(new)


def changed_since(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows whose time, as ISO text or timestamp, isn't before the mark; all rows without a mark."""
    return df if mark is None else df.filter(F.col(column).cast("timestamp") >= F.lit(mark).cast("timestamp"))
