import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.operators import joins
from quarryline.plans.model import is_open

EVENTS = "id long, who long, at timestamp, valid_from string"
VERSIONS = "key long, state string, since timestamp, until timestamp"
ZERO = datetime(2024, 1, 1)


def minutes(n):
    return ZERO + timedelta(minutes=n)


def by_range(events, versions):
    """The plain plan: a join on the key with the range as residual condition."""
    on = (events.who == versions.key) & (versions.since <= events["at"]) & (is_open(versions.until) | (versions.until > events["at"]))
    return events.join(versions, on, "left")


def rows(df):
    return sorted(map(str, df.collect()))


def draw(seed, hot):
    """Histories with gaps, ties, empty intervals and open ends; events with null keys and times, on and between the bounds."""
    rng = random.Random(seed)
    versions, events = [], []
    for key in range(12):
        t = rng.randint(0, 20)
        for k in range(400 if key == 0 and hot else rng.randint(0, 6)):
            end = t + rng.randint(0, 5)
            versions.append((key, f"s{k}", minutes(t), minutes(end)))
            t = end + rng.choice([0, 0, 0, 3])
        if rng.random() < 0.7:
            versions.append((key, "open", minutes(t), None))
    versions += [(None, "none", minutes(0), None), (3, "never", None, None)]
    events = [(i, rng.choice([None, *range(14)]) if not hot or i % 2 else 0, None if rng.random() < 0.05 else minutes(rng.randint(-5, 900 if hot else 40)), "clash") for i in range(800)]
    return events, versions


@pytest.mark.parametrize("heavy_rows", [1_000_000, 20, 10**19])
@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_is_the_range_join(spark, seed, heavy_rows):
    """Also where most keys are cut into blocks of time, and where the input is too small for that."""
    events, versions = draw(seed, hot=True)
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    assert joins.overlapping(v.filter("key is not null"), ["key"], "since", "until").isEmpty()
    got = joins.as_of(e, v, [("who", "key")], "at", "since", "until", heavy_rows=heavy_rows, cuts=8)
    assert got.columns == by_range(e, v).columns
    assert rows(got) == rows(by_range(e, v))


def test_as_of_with_text_times_and_two_keys(spark):
    v = spark.createDataFrame([("a", 1, "2024-01-01", "2024-01-05"), ("a", 1, "2024-01-05", ""), ("a", 2, "2024-01-02", None), ("b", 1, "", "")], "k string, n int, valid_from string, valid_to string")
    e = spark.createDataFrame([(1, "a", 1, "2024-01-04"), (2, "a", 1, "2024-01-05"), (3, "a", 2, "2024-01-01"), (4, "a", 2, "2025-01-01"), (5, "b", 3, "2025-01-01")], "id int, x string, y int, t string")
    got = {r.id: r.valid_from for r in joins.as_of(e, v, [("x", "k"), ("y", "n")], "t").collect()}
    assert got == {1: "2024-01-01", 2: "2024-01-05", 3: None, 4: "2024-01-02", 5: None}


def test_as_of_edges(spark):
    e, v = spark.createDataFrame([(1, 1, ZERO, "x")], EVENTS), spark.createDataFrame([], VERSIONS)
    assert joins.as_of(e, v, [("who", "key")], "at", "since", "until").collect()[0].state is None
    assert joins.as_of(e.limit(0), v, [("who", "key")], "at", "since", "until").collect() == []


def test_overlapping_versions_are_found(spark):
    v = spark.createDataFrame([(1, "a", minutes(0), minutes(9)), (1, "b", minutes(5), None), (2, "c", minutes(0), None), (2, "d", minutes(1), minutes(2)), (3, "e", minutes(0), minutes(4)), (3, "f", minutes(4), None), (3, "g", minutes(2), minutes(2))], VERSIONS)
    assert sorted(r.state for r in joins.overlapping(v, ["key"], "since", "until").collect()) == ["b", "d"]


def test_one_key_with_many_events_and_versions(spark):
    """100,000 of both under one key: the pairs that a join on the key alone makes would be ten thousand million."""
    n = 100_000
    v = spark.range(n).select(F.lit(1).cast("long").alias("key"), F.col("id").cast("string").alias("state"), F.timestamp_seconds(F.col("id") * 60).alias("since"), F.timestamp_seconds(F.col("id") * 60 + 60).alias("until"))
    e = spark.range(n).select("id", F.lit(1).cast("long").alias("who"), F.timestamp_seconds(F.col("id") * 60 + 30).alias("at"))
    began = time.time()
    got = joins.as_of(e, v, [("who", "key")], "at", "since", "until", heavy_rows=10_000)
    assert got.filter(F.col("state") == F.col("id").cast("string")).count() == n
    assert time.time() - began < 60
