import pytest
from pyspark.sql import functions as F

from quarryline.operators import features
from quarryline.operators.features import Feature

NONE = "feature_id string, entity_id string, value string, computed_at timestamp"


def at(text):
    return F.lit(text).cast("timestamp")


def values(df):
    return {(r.feature_id, r.entity_id): r.value for r in df.collect()}


@pytest.fixture
def tables(spark):
    team = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "team string, size double")
    issue = spark.createDataFrame([(1, "a", 3.0, "2024-01-01"), (2, "a", 5.0, "2024-01-02"), (3, "b", 8.0, "2024-01-03"), (4, None, 1.0, "2024-01-03")], "issue long, of_team string, points double, changed string")
    return {"team": team, "issue": issue}


TWICE = Feature("twice", "issue", "issue", "points * 2")
MORE = Feature("more", "issue", "issue", "twice + 1", needs=("twice",))
STEP = Feature("step", "issue", "issue", "more - lag(more) OVER (PARTITION BY of_team ORDER BY issue)", needs=("more",))
TOTAL = Feature("total", "issue", "of_team", "sum(more)", aggregate=True, needs=("more",))
LOAD = Feature("load", "team", "team", "total / size", needs=("total",))
BUSY = Feature("busy", "team", "team", "load > 10", kind="boolean", needs=("load",), mode="dynamic")
NOTE = Feature("note", "team", "team", "CASE WHEN busy THEN 'busy' ELSE 'calm' END", kind="string", needs=("busy",))
EVERY = [NOTE, BUSY, LOAD, TOTAL, STEP, MORE, TWICE]
FULL = {
    ("twice", "1"): "6.0", ("twice", "2"): "10.0", ("twice", "3"): "16.0", ("twice", "4"): "2.0", ("more", "1"): "7.0", ("more", "2"): "11.0", ("more", "3"): "17.0", ("more", "4"): "3.0",
    ("step", "1"): None, ("step", "2"): "4.0", ("step", "3"): None, ("step", "4"): None, ("total", "a"): "18.0", ("total", "b"): "17.0", ("total", None): "3.0",
    ("load", "a"): "18.0", ("load", "b"): "8.5", ("load", "c"): None, ("note", "a"): "busy", ("note", "b"): "calm", ("note", "c"): "calm",
}


def test_features_on_features(spark, tables):
    """Over rows, windows, aggregates and another table, in one run; the dynamic one isn't stored."""
    got = features.reconcile(spark, EVERY, tables, spark.createDataFrame([], NONE), at("2024-01-01"))
    assert values(got) == FULL
    assert [{f.id for f in level} for level in features.stages(EVERY)] == [{"twice", "more", "step", "total"}, {"load", "busy", "note"}]


def test_one_pass_for_a_stage(spark, tables):
    """A chain of features over rows of one table reads it once."""
    new = features.compute(spark, [STEP, MORE, TWICE], tables, spark.createDataFrame([], NONE), at("2024-01-01"), dict.fromkeys(("step", "more", "twice"), "new"))
    assert new._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_only_what_is_stale_is_computed(spark, tables):
    first = features.run(spark, EVERY, tables, spark.createDataFrame([], NONE), at("2024-01-01"))
    assert set(first.steps.values()) == {"new", "dynamic"} and values(first.values) == FULL
    # Stored values that differ show what isn't computed again.
    marked = first.values.withColumn("value", F.lit("0"))
    again = features.run(spark, EVERY, tables, marked, at("2024-01-02"), first.registry)
    assert set(again.steps.values()) == {"fresh", "dynamic"} and set(values(again.values).values()) == {"0"}
    # A changed definition, and all that need it; what it needs itself comes from the store.
    more = Feature("more", "issue", "issue", "twice + 2", needs=("twice",))
    third = features.run(spark, [NOTE, BUSY, LOAD, TOTAL, STEP, more, TWICE], tables, marked, at("2024-01-02"), first.registry)
    assert third.steps == {"twice": "fresh", "more": "changed", "step": "needs", "total": "needs", "load": "needs", "busy": "dynamic", "note": "needs"}
    got = values(third.values)
    assert got["twice", "1"] == "0" and got["more", "1"] == "2.0" and got["total", "a"] == "4.0" and got["note", "a"] == "calm"
    # Older than its ttl, and left out.
    total = Feature("total", "issue", "of_team", "sum(more)", aggregate=True, needs=("more",), ttl_seconds=60)
    assert features.steps([TWICE, MORE, total, LOAD], marked, first.registry, at("2024-01-02")) == {"twice": "fresh", "more": "fresh", "total": "expired", "load": "needs"}
    assert features.steps([TWICE, MORE], marked.limit(0), None, at("2024-01-02"), only={"more"}) == {"twice": "left out", "more": "new"}


def test_changed_entities_only(spark, tables):
    """With a mark, the entities of later rows and all that depends on them; the others keep what is stored."""
    first = features.run(spark, EVERY, tables, spark.createDataFrame([], NONE), at("2024-01-01"))
    marked = first.values.withColumn("value", F.lit("0"))
    got = features.run(spark, EVERY, tables, marked, at("2024-01-05"), first.registry, since={"issue": ("changed", "2024-01-03")})
    assert got.steps["twice"] == "rows" and got.steps["load"] == "rows"
    v = values(got.values)
    assert v["twice", "3"] == "16.0" and v["twice", "1"] == "0" and v["total", "b"] == "17.0" and v["total", "a"] == "0"
    assert v["load", "b"] == "8.5" and v["load", "a"] == "0" and v["note", "b"] == "calm" and v["note", "a"] == "0"
    assert v["step", "2"] == "4.0"  # a window's rows depend on others, so all are computed


def test_changes_reach_through_a_dynamic_feature(spark, tables):
    """Also where the one that needs it is of another table."""
    mark = Feature("mark", "issue", "of_team", "max(CASE WHEN busy THEN 1 ELSE 0 END)", aggregate=True, kind="long", needs=("busy",))
    every = [mark, BUSY, LOAD, TOTAL, MORE, TWICE]
    first = features.run(spark, every, tables, spark.createDataFrame([], NONE), at("2024-01-01"))
    marked = first.values.withColumn("value", F.lit("0"))
    got = features.run(spark, every, tables, marked, at("2024-01-05"), first.registry, since={"issue": ("changed", "2024-01-02")})
    v = values(got.values)
    assert got.steps["mark"] == "rows" and v["mark", "a"] == "1" and v["mark", "b"] == "0" and v["load", "a"] == "18.0"


def test_sql_reads_stored_and_new_values(spark, tables):
    best = Feature("best", "team", "team", sql="SELECT t.team AS entity_id, CAST(v.value AS DOUBLE) AS value FROM team t, __feature_value v WHERE v.feature_id = 'total' AND v.entity_id = t.team", needs=("total",))
    got = values(features.reconcile(spark, [best, TOTAL, MORE, TWICE], tables, spark.createDataFrame([], NONE), at("2024-01-01")))
    assert got["best", "a"] == "18.0" and got["best", "b"] == "17.0"


def test_a_returning_feature_goes_on_with_its_version(spark, tables):
    one = features.register(spark, [TWICE, MORE])
    two = features.register(spark, [TWICE], one)
    assert {r.feature_id: (r.version, r.active, r.position) for r in two.collect()} == {"twice": (1, True, 0), "more": (1, False, None)}
    assert {r.feature_id: r.state for r in features.diff(spark, [TWICE, STEP], one).collect()} == {"twice": "WOULD RECOMPUTE", "step": "NEW", "more": "DELETED"}
    more = Feature("more", "issue", "issue", "twice + 9", needs=("twice",))
    three = features.register(spark, [TWICE, more], two)
    assert {r.feature_id: (r.version, r.active) for r in three.collect()} == {"twice": (1, True), "more": (2, True)}


def test_names_in_sql(spark, tables):
    sql = "SELECT team AS entity_id, '{from team}' AS value FROM team WHERE team IN (SELECT of_team FROM issue)"
    assert {r.value for r in features.evaluate(spark, Feature("x", "team", "team", sql=sql, kind="string"), tables).collect()} == {"{from team}"}


def test_nothing_to_do(spark, tables):
    none = spark.createDataFrame([], NONE)
    assert features.run(spark, [], tables, none, at("2024-01-01")).values.collect() == []
    assert features.run(spark, [BUSY], tables, none, at("2024-01-01")).values.collect() == []
    with pytest.raises(ValueError):
        features.run(spark, [Feature("a", "team", "team", "b", needs=("b",)), Feature("b", "team", "team", "a", needs=("a",))], tables, none, at("2024-01-01"))
