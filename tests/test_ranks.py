import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import tables
from quarryline.plans.ranks import Ranked
from quarryline.sources.versioned import VersionedTable


@pytest.mark.parametrize("n, ranges", [(1000, 7), (3, 8), (0, 4)])
def test_places_and_pages(spark, tmp_path, n, ranges):
    """Places are those of one sort, with ties and nulls; a page's rows come in order from its own ranges."""
    rng = random.Random(n)
    values = [(k, rng.choice([None, *range(9)])) for k in range(n)]
    df = spark.createDataFrame(values, "id long, v int")
    r = Ranked.of(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], f"file://{tmp_path}/r", ranges)
    want = [k for k, _ in sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
    assert r.total == n and r.before[0] == 0
    assert {x.id: x.position for x in r.rows().collect()} == {k: i + 1 for i, k in enumerate(want)}
    for number, size in ((1, 10), (4, 33), (n // 10 + 1, 10), (10**6, 5)):
        page = r.page(number, size)
        assert [x.id for x in page.collect()] == want[(number - 1) * size : number * size] and page.columns == ["id", "v"]
    if n == 1000:
        assert len(r.page(3, 10).inputFiles()) < len(r.rows().inputFiles())


def keyed(df):
    return sorted((str(r.k), r.change) for r in df.collect())


@pytest.mark.parametrize("buckets", [1, 16, 512])
def test_digest_diff_is_the_plain_diff(spark, buckets):
    rng = random.Random(buckets)
    old = [(k, rng.choice([None, "x", "y"]), rng.random()) for k in [*range(300), None]]
    new = [(k, "z" if rng.random() < 0.05 else v, w) for k, v, w in old if rng.random() > 0.03] + [(1000, "n", 0.5)]
    a, b = (spark.createDataFrame(x, "k long, v string, w double") for x in (old, new))
    assert keyed(tables.digest_diff(a, b, ["k"], ["v", "w"], buckets)) == keyed(tables.keyed_diff(a, b, ["k"], ["v", "w"]))
    assert tables.digest_diff(a, a.orderBy(F.rand(1)), ["k"], ["v", "w"], buckets).isEmpty()
    assert keyed(tables.digest_diff(a, a.withColumn("k", F.col("k").cast("int")), ["k"], ["v"], buckets)) == []
    assert keyed(tables.digest_diff(a.limit(0), b, ["k"], ["v"], buckets)) == keyed(tables.keyed_diff(a.limit(0), b, ["k"], ["v"]))


def test_a_diff_of_versions_reads_other_buckets_only(spark, tmp_path):
    t = VersionedTable.create(spark.range(500).select(F.col("id").alias("k"), F.lit("a").alias("v")), f"file://{tmp_path}/t", ["k"], buckets=20)
    t.upsert(spark.createDataFrame([(7, "b"), (900, "c")], "k long, v string"), F.lit(0))
    d = t.diff(1, 2)
    assert keyed(d) == [("7", "updated"), ("900", "created")]
    assert len(d.inputFiles()) <= 4 < len(t.read().inputFiles())
    assert keyed(t.diff(2, 1)) == [("7", "updated"), ("900", "deleted")] and t.diff(2, 2).isEmpty()
