import random

import pytest
from pyspark.sql import functions as F

from quarryline.plans import distinct
from quarryline.plans import query as q
from quarryline.plans.model import Entity, Model, Relation
from quarryline.plans.query import child, measure

ROWS = [(g, d, v) for r in [random.Random(4)] for g in ("a", "b", None) for d in range(12) if r.random() < 0.8 for v in [r.choice([None, -5, 0, 32767, 32768, 2**40, *range(20)]) for _ in range(6)]]


@pytest.mark.parametrize("bitmaps", [None, False])
def test_states_merge_to_the_count(spark, bitmaps):
    df = spark.createDataFrame(ROWS, "g string, d int, v long")
    fine = distinct.state(df, ["g", "d"], "v", bitmaps)
    for by in (["g"], ["d"], []):
        got = {tuple(r[c] for c in by): r.n for r in distinct.count(distinct.merge(fine, by), by, "n").collect()}
        want = {}
        for g, d, v in ROWS:
            if v is not None:
                want.setdefault(tuple({"g": g, "d": d}[c] for c in by), set()).add(v)
        assert got == {k: len(x) for k, x in want.items()}


@pytest.mark.parametrize("frame", [1, 3, 100])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_rolling(spark, frame, kind):
    """Over the last groups that are there, with null partitions and groups without values."""
    df = spark.createDataFrame(ROWS + [("a", 99, None)], "g string, d int, v long").withColumn("v", F.col("v").cast(kind))
    got = {(r.g, r.d): r.n for r in distinct.rolling(df.select("g", "d").distinct(), distinct.state(df, ["g", "d"], "v"), "n", "d", ["g"], frame).collect()}
    want = {}
    for g in ("a", "b", None):
        days = sorted({d for x, d, _ in ROWS + [("a", 99, None)] if x == g})
        for k, day in enumerate(days):
            inside = set(days[max(0, k - frame + 1) : k + 1])
            want[g, day] = len({v for x, d, v in ROWS if x == g and d in inside and v is not None})
    assert got == want
    with pytest.raises(ValueError):
        distinct.rolling(df, df, "n", "d", ["g"], 0)


def test_over_children_of_filtered_parents(spark):
    team = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "team string, area string")
    person = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "person int, of_team string")
    task = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (3, "q"), (4, "p"), (5, "z"), (4, None)], "by_person int, kind string")
    m = Model.of(
        (Entity("Team", "team", (Relation("people", "Person", ("team",), ("of_team",), "o2m"),)), team),
        (Entity("Person", "person", (Relation("tasks", "Task", ("person",), ("by_person",), "o2m"),)), person),
        (Entity("Task", "by_person"), task),
    )
    got = q.aggregate(m, "Team", {"area": "area"}, {"kinds": child("people.tasks.kind", "count_distinct"), "share": child("people.person", "count_distinct") / measure("count")})
    assert {r.area: (r.kinds, r.share) for r in got.collect()} == {"x": (2, 1.5), "y": (1, 1.0), None: (0, 0.0)}
    every = q.aggregate(m, "Team", {}, {"kinds": child("people.tasks.kind", "count_distinct")}, [lambda r: r["team"] != "b"])
    assert every.columns == ["kinds"] and every.first().kinds == 2
