import pytest
from pyspark.sql import functions as F

from quarryline.operators import load
from quarryline.sources import versioned
from quarryline.sources.versioned import VersionedTable


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return VersionedTable.create(df, f"file://{tmp_path}/t", ["k"], buckets=16)


def seq(spark, values, schema="k long, v long, seq int"):
    return spark.createDataFrame(values, schema)


def test_upsert_rewrites_its_buckets_only(spark, table):
    before, old = table.manifest(), rows(table.read())
    batch = seq(spark, [(5, -1, 1), (5, -2, 2), (5000, 7, 1), (None, 1, 1)])
    want = load.upsert(table.read(), batch, ["k"], F.col("seq"))
    want = rows(want)
    assert table.upsert(batch, F.col("seq")) == 2
    after = table.manifest()
    assert rows(table.read()) == want and rows(table.read(1)) == old
    changed = {b for b in range(16) if before.folders.get(b) != after.folders.get(b)}
    assert 1 <= len(changed) <= 3
    # Once more with a null key: it is replaced, not doubled.
    table.upsert(seq(spark, [(None, 2, 1)]), F.col("seq"))
    assert [r.v for r in table.read().filter("k is null").collect()] == [2]


def test_new_columns_are_null_before(spark, table):
    table.upsert(spark.createDataFrame([(3, "x", 1)], "k long, note string, seq int"), F.col("seq"))
    assert table.read().columns == ["k", "v", "note", "seq"]
    assert table.read().filter("note is not null").count() == 1 and table.read().count() == 1000


def test_a_failed_load_leaves_the_old_version(spark, table):
    before = rows(table.read())
    bad = spark.range(3).select(F.col("id").alias("k"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken")).cast("long")).otherwise(0).alias("v"), F.lit(1).alias("seq"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad, F.col("seq"))
    assert table.versions() == [1] and rows(table.read()) == before


def test_an_overtaken_load_is_refused(spark, table):
    base = table.manifest()
    table.upsert(seq(spark, [(1, 1, 1)]), F.col("seq"))
    with pytest.raises(versioned.Overtaken):
        table._commit(versioned.replace(base, version=2))
    assert table.read().filter("k = 1").first().v == 1 and table.versions() == [1, 2]


def test_replace_and_vacuum(spark, table):
    assert table.replace(table.read().filter("k < 10")) == 2  # reads what it replaces
    assert table.read().count() == 10 and table.read(1).count() == 1000
    assert table.replace(table.read().limit(0)) == 2
    assert table.vacuum(keep=1) >= 1 and table.versions() == [2] and table.read().count() == 10
    with pytest.raises(ValueError):
        table.read(1)


def test_prune(spark, table):
    keep = table.read().filter("k <> 77").select("k")
    before = table.manifest()
    assert table.prune(keep, failed=keep) == 1
    assert table.prune(keep) == 2 and table.read().count() == 999
    assert sum(before.folders[b] != f for b, f in table.manifest().folders.items()) == 1
    assert table.prune(keep) == 2  # nothing to lose


def test_history(spark, tmp_path):
    none = spark.createDataFrame([], "k long, s string, valid_from timestamp, valid_to timestamp")
    t = VersionedTable.create(none, f"file://{tmp_path}/h", ["k"], buckets=8)
    at = lambda d: F.expr(f"TIMESTAMP '2024-01-0{d}'")
    want = none
    for day, values in ((1, [(1, "a"), (2, "a"), (3, "a")]), (2, [(1, "b"), (2, "a")]), (3, [(1, "c"), (4, "d"), (4, "e")])):
        new = spark.createDataFrame(values, "k long, s string")
        want = load.scd2(want, new, ["k"], ["s"], at(day))
        t.load_history(new, ["s"], at(day))
    assert rows(t.read()) == rows(want) and t.read().count() == 6
    assert t.load_history(none.select("k", "s"), ["s"], at(4)) == 4


def test_events(spark, tmp_path):
    e = spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("kind"))
    first = load.append(e.filter("k < 30"), F.expr("TIMESTAMP '2024-01-01'"))
    t = VersionedTable.create(first, f"file://{tmp_path}/e", ["k"], buckets=4, splits=2)
    t.load_events(e.unionByName(e), F.expr("TIMESTAMP '2024-01-02'"))
    assert t.read().count() == 50 and t.read().filter("inserted_at = TIMESTAMP '2024-01-01'").count() == 30


def test_needs_a_key_and_a_free_path(spark, table):
    with pytest.raises(ValueError):
        VersionedTable.create(table.read(), table.path, ["k"])
    with pytest.raises(ValueError):
        VersionedTable.create(table.read(), table.path + "2", [])
