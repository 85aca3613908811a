"""Chart data: pivots, series order, shares, calendars, and how telling a series is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import display_hours, display_number, display_percent
from ..plans.query import UNSET


def pivot(df: DataFrame, x: str, series: str, value: str, names: list, order: str | None = None) -> DataFrame:
    """One row per x, a column per series name (null is '(unset)'); of several values the last by `order`, else the largest."""
    last = F.max_by(value, order) if order else F.max(value)
    return df.withColumn(series, F.coalesce(F.col(series).cast("string"), F.lit(UNSET))).groupBy(x).pivot(series, names).agg(last)


def series_order(df: DataFrame, x: str, series: str, value: str) -> DataFrame:
    """(series, position) by the value at the latest x, descending, ties by name; series without one come last."""
    name = F.coalesce(F.col(series).cast("string"), F.lit(UNSET))
    top = df.agg(F.max(x).alias("__x"))
    at_last = df.join(F.broadcast(top), F.col(x) == F.col("__x"), "left").groupBy(name.alias("series")).agg(F.max(F.when(F.col("__x").isNotNull(), F.col(value))).alias("v"))
    return at_last.select("series", F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "series")).alias("position"))


def percent_stack(df: DataFrame, x: str, value: str, name: str = "share") -> DataFrame:
    """value over its x's total; a total of 0 leaves it as it is."""
    total = F.sum(value).over(Window.partitionBy(x))
    return df.withColumn(name, F.when(total == 0, F.col(value).cast("double")).otherwise(F.col(value) / total))


def calendar(df: DataFrame, group: str, day: str, value: str) -> DataFrame:
    """(group, day, value) for each day from the first to the last of all, 0 where there is none."""
    first, last = df.agg(F.min(day), F.max(day)).first()
    frame = df.select(group).distinct().select(group, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(day))
    sums = df.groupBy(group, day).agg(F.sum(value).alias("__v"))
    return frame.join(sums, [group, day], "left").select(group, day, F.coalesce("__v", F.lit(0.0)).alias(value))


def checked_columns(df: DataFrame, declared: list[str]) -> DataFrame:
    """df's declared columns; an unknown one is an error."""
    missing = [c for c in declared if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*declared)


def execute_view(df: DataFrame, declared: list[str], formats: dict[str, str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """The declared columns, those with a format as text beside them in <name>_display. The view's formats come before the query's defaults.

    A format is percent, hours, or a number pattern.
    """
    out = checked_columns(df, declared)
    wanted = {**(defaults or {}), **(formats or {})}
    show = {"percent": display_percent, "hours": display_hours}
    return out.withColumns({f"{c}_display": show[f](F.col(c)) if f in show else display_number(F.col(c), f) for c, f in wanted.items() if c in declared})


def significance_of(df: DataFrame, group: list[str], values: list[str], time: str | None = None) -> DataFrame:
    """(group.., significance): the largest over several numeric columns."""
    rows = reduce(DataFrame.unionByName, [significance(df, group, v, time) for v in values])
    return rows.groupBy(*group).agg(F.max("significance").alias("significance"))


def significance(df: DataFrame, group: list[str], value: str, time: str | None = None) -> DataFrame:
    """(group.., significance) 0 to 10.

    With a time column: the last point's deviation from the mean of those before it, 3 population
    deviations giving 10, or its change from the one before, 100 % giving 10; else the largest
    deviation of any point. Groups of fewer than two points have 0.
    """
    rows = df.filter(F.col(value).isNotNull())
    whole = Window.partitionBy(*group)
    if time is None:
        z = F.try_divide(F.abs(F.col(value) - F.avg(value).over(whole)), F.stddev_pop(value).over(whole))
        out = rows.withColumn("__z", z).groupBy(*group).agg(F.max("__z").alias("z"), F.count(F.lit(1)).alias("n"))
        score = F.least(F.coalesce("z", F.lit(0.0)) * 10 / 3, F.lit(10.0))
    else:
        back = whole.orderBy(F.col(time).desc())
        ranked = rows.withColumn("__r", F.row_number().over(back))
        pick = lambda r: F.max(F.when(F.col("__r") == r, F.col(value)))
        before = F.when(F.col("__r") > 1, F.col(value))
        out = ranked.groupBy(*group).agg(pick(1).alias("last"), pick(2).alias("prev"), F.avg(before).alias("mu"), F.stddev_pop(before).alias("sigma"), F.count(F.lit(1)).alias("n"))
        z = F.when(F.col("sigma") > 0, F.abs(F.col("last") - F.col("mu")) / F.col("sigma")).otherwise(0.0)
        pop = F.when(F.abs("prev") > 1e-9, F.abs(F.col("last") - F.col("prev")) / F.abs("prev")).when(F.abs("last") > 1e-9, 1.0).otherwise(0.0)
        score = F.greatest(F.least(z * 10 / 3, F.lit(10.0)), F.least(pop * 10, F.lit(10.0)))
    return out.select(*group, F.when(F.col("n") < 2, 0.0).otherwise(F.round(score, 4)).alias("significance"))
