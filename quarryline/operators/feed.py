"""A ranked feed: freshness-weighted significance, diversity by dataset, candidates, engagement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HALF_LIFE_HOURS = 72.0
REPEAT_PENALTY = 0.5


def base_score(significance: Column, published_at: Column, now: Column) -> Column:
    """significance / (1 + age in hours / 72); null time counts as new, null significance as 0."""
    age = F.greatest(F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(published_at.cast("timestamp"))) / 3.6e9, F.lit(0.0)), F.lit(0.0))
    return F.coalesce(significance, F.lit(0.0)) / (1 + age / HALF_LIFE_HOURS)


def diversity_rank(items: DataFrame, score: str, dataset: str, key: str, penalty: float = REPEAT_PENALTY) -> DataFrame:
    """Adds effective and position. The greedy order, in which each earlier pick of a dataset halves a score, is one sort:
    within a dataset picks go by score, so the n-th effective score is score * penalty ** (n - 1) and doesn't grow.
    """
    own = Window.partitionBy(dataset).orderBy(F.col(score).desc(), key)
    ranked = items.withColumn("effective", F.col(score) * F.pow(F.lit(penalty), F.row_number().over(own) - 1))
    return ranked.withColumn("position", F.row_number().over(Window.orderBy(F.col("effective").desc(), key)))


def pool_size(offset: int, limit: int) -> int:
    return min(max(5 * (offset + limit), 100), 500)


def feed(items: DataFrame, now: Column, offset: int = 0, limit: int = 20, dataset: str = "dataset_ref", significance: str = "significance_score", published: str = "published_at", key: str = "id", where: Column | None = None, saved: DataFrame | None = None) -> DataFrame:
    """A page of the newest candidates, ranked. The pool is a bounded top-k, so the global ranks see at most 500 rows."""
    pool = items.filter(where) if where is not None else items
    if saved is not None:
        pool = pool.join(saved.select(key).distinct(), key, "left_semi")
    pool = pool.orderBy(F.col(published).desc(), key).limit(pool_size(offset, limit))
    scored = pool.withColumn("base", base_score(F.col(significance), F.col(published), now))
    return diversity_rank(scored, "base", dataset, key).filter((F.col("position") > offset) & (F.col("position") <= offset + limit))


def engagement(events: DataFrame, item: str, kind: str, user: str, kinds: list[str], viewer=None) -> DataFrame:
    """Per item the number of each kind, and whether the viewer did it."""
    one = lambda k: F.col(kind) == k
    counts = [F.count_if(one(k)).alias(f"n_{k}") for k in kinds]
    flags = [F.coalesce(F.max(one(k) & (F.col(user) == viewer)), F.lit(False)).alias(f"did_{k}") for k in kinds] if viewer is not None else []
    return events.groupBy(item).agg(*counts, *flags)
