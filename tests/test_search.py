import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import search


def brute(rows, queries, k):
    out = []
    for i, q in queries:
        if q is None or None in q or not any(q) or i is None:
            continue
        near = []
        for j, v in rows:
            if j is None or j == i or v is None or len(v) != len(q) or None in v or not any(v):
                continue
            a, b = np.array(q), np.array(v)
            near.append((round(1 - float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)), 9), j))
        out += [(i, j, d + 0.0, n + 1) for n, (d, j) in enumerate(sorted(near)[:k])]
    return sorted(out)


def run(df, queries, k, **kw):
    got = search.find_each(df, queries, k, "id", "v", **kw)
    return sorted((r.query_id, r.id, round(r.distance, 9) + 0.0, r.position) for r in got.collect())


@pytest.mark.parametrize("kw", [{}, {"block": 7}, {"centres": 3}, {"centres": 0}, {"block": 9, "centres": 40}])
def test_equals_brute_force(spark, kw):
    """Random rows, a large group of copies, a null, an empty, a zero and a shorter vector, and one with a null in it."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for k in range(150)]
    rows += [(1000 + k, rows[3][1]) for k in range(60)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0, 2.0]), (2004, [1.0, 3.0]), (2005, [None] + [1.0] * 7), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    queries = [r for r in rows if r[0] is None or r[0] % 3 == 0 or r[0] > 2000]
    asked = df.filter("id is null or id % 3 = 0 or id > 2000")
    want = brute(rows, queries, 5)
    assert [w for w in want if w[0] != 2005] == [g for g in run(df, asked, 5, **kw)]


def test_clusters_are_left_out(spark):
    """Tight clusters: most pairs aren't compared, and the rows are those of brute force; the plan doesn't grow with the passes."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(20, 16)) * 5
    rows = [(k, [float(x) for x in middle[k % 20] + rng.normal(size=16) * 0.05]) for k in range(2000)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    compared = spark.sparkContext.accumulator(0)
    asked = df.filter("id % 10 = 0")
    got = run(df, asked, 5, centres=64, block=50, compared=compared)
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert 0 < compared.value < 0.35 * 200 * 2000


def test_string_keys_and_nothing_asked(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "id string, v array<double>")
    assert [r.id for r in search.find_each(df, df.filter("id = 'a'"), 2, "id", "v").orderBy("position").collect()] == ["b", "c"]
    assert search.find_each(df, df.limit(0), 2, "id", "v").collect() == []
    assert search.find_each(df.limit(0), df, 2, "id", "v").collect() == []
    assert search.find_each(df, df, 2, "id", "v").agg(F.count("*")).first()[0] == 6
