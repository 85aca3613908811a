import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarryline.operators import tables
from quarryline.sources.versioned import VersionedTable
from quarryline.streaming import events, state

ZERO = datetime(2024, 1, 1)
LOG = "task string, at timestamp, status string"


def feed(spark, home, name, parts, schema):
    """Each part as files of a folder, one after the other, handing out the stream anew each time."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(f"{home}/{name}")
        yield k, events.read_new_files(spark, f"{home}/{name}", spark.createDataFrame([], schema).schema)


def counts(df):
    return sorted((str(r.task), r.failures) for r in df.select("task", "failures").collect())


def test_failures_in_three_parts_are_those_of_the_batch(spark, tmp_path):
    """Across restarts, rows out of order within the lateness, ties of time, null keys and times."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", None]), ZERO + timedelta(minutes=rng.randint(0, 40)) + timedelta(hours=2 * part) if rng.random() > 0.02 else None, rng.choice(["failed", "failed", "failed", "success", "other", None])) for part in range(3) for _ in range(60)]
    parts = [rows[:60], rows[60:120], rows[120:]]
    none = spark.createDataFrame([], "task string, failures long")
    table = VersionedTable.create(none, f"file://{tmp_path}/t", ["task"], buckets=4)
    for _, stream in feed(spark, tmp_path, "log", parts, LOG):
        flagged = stream.withColumn("bad", F.col("status") == "failed").withColumn("ok", F.col("status") == "success")
        state.upsert_into(state.failures_since_success(flagged, ["task"], "bad", "ok", "at"), table, f"{tmp_path}/c", "update").awaitTermination()
    log = spark.createDataFrame(rows, LOG).filter("at is not null")
    batch = tables.failures_since_success(log.fillna("null", ["task"]), ["task"], F.col("status") == "failed", F.col("status") == "success", "at")
    assert counts(table.read().fillna("null", ["task"])) == counts(batch)


def test_idle_keys_are_forgotten(spark, tmp_path):
    """After the timer a key begins anew."""
    hours = lambda n: ZERO + timedelta(hours=n)
    parts = [[("a", hours(0), "failed"), ("b", hours(0), "failed")], [("b", hours(90), "failed")], [("b", hours(180), "failed")], [("a", hours(181), "failed")]]
    table = VersionedTable.create(spark.createDataFrame([], "task string, failures long"), f"file://{tmp_path}/t", ["task"], buckets=4)
    for _, stream in feed(spark, tmp_path, "log", parts, LOG):
        flagged = stream.withColumn("bad", F.col("status") == "failed").withColumn("ok", F.col("status") == "success")
        state.upsert_into(state.failures_since_success(flagged, ["task"], "bad", "ok", "at", idle_hours=100), table, f"{tmp_path}/c", "update").awaitTermination()
    assert counts(table.read()) == [("a", 1), ("b", 3)]


def test_events_in_three_parts_are_those_of_the_batch(spark, tmp_path):
    """Events that come again in later parts, after a restart, are in the table once."""
    rows = [(k % 70, f"x{k % 70}") for k in range(200)]
    none = spark.createDataFrame([], "id long, kind string, inserted_at timestamp")
    table = VersionedTable.create(none, f"file://{tmp_path}/t", ["id"], buckets=8)
    for k, stream in feed(spark, tmp_path, "events", [rows[:60], rows[60:130], rows[130:]], "id long, kind string"):
        state.load_events_into(stream, table, f"{tmp_path}/c").awaitTermination()
        assert table.read().count() == (60, 70, 70)[k]
    assert sorted((r.id, r.kind) for r in table.read().collect()) == sorted(set(rows))
    # A part that is run again after a failure, as with a lost checkpoint, adds nothing.
    again = events.read_new_files(spark, f"{tmp_path}/events", spark.createDataFrame([], "id long, kind string").schema)
    before = len(table.versions())
    state.load_events_into(again, table, f"{tmp_path}/c2").awaitTermination()
    assert table.read().count() == 70 and len(table.versions()) >= before


def test_a_part_that_fails_leaves_the_table(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], "id long, kind string, inserted_at timestamp"), f"file://{tmp_path}/t", ["id"], buckets=2)
    for _, stream in feed(spark, tmp_path, "events", [[(1, "a")]], "id long, kind string"):
        bad = stream.withColumn("kind", F.raise_error(F.lit("broken")).cast("string"))
        with pytest.raises(Exception, match="broken"):
            state.load_events_into(bad, table, f"{tmp_path}/c").awaitTermination()
        assert table.versions() == [1]
        state.load_events_into(stream, table, f"{tmp_path}/c3").awaitTermination()
    assert table.read().count() == 1
