import pytest
from pyspark.sql import functions as F

from quarryline.plans import query as q
from quarryline.plans.model import Entity, Model, Relation
from quarryline.plans.query import child, measure


@pytest.fixture(scope="module")
def teams(spark):
    team = spark.createDataFrame([("t1", "One"), ("t2", None)], "team_key string, display_name string")
    person = spark.createDataFrame([("p1", "Ann", "t1"), ("p2", "Bo", "t1"), ("p3", "Cy", None)], "person_key string, name string, team_key string")
    identity = spark.createDataFrame([("i1", "p1"), ("i2", "p1"), ("i3", "p2")], "identity_key string, subject_key string")
    pull = spark.createDataFrame([("r1", "i1"), ("r2", "i1"), ("r3", "i2"), ("r4", "i3")], "pull_request_key string, author_identity_key string")
    return Model.of(
        (Entity("Team", "team_key"), team),
        (Entity("Person", "person_key", (Relation("in_team", "Team", ("team_key",)), Relation("identities", "Identity", ("person_key",), ("subject_key",), "o2m"))), person),
        (Entity("Identity", "identity_key", (Relation("of_person", "Person", ("subject_key",)),)), identity),
        (Entity("PullRequest", "pull_request_key", (Relation("by_identity", "Identity", ("author_identity_key",)),)), pull),
    )


def test_multi_hop_child_measures_do_not_multiply(teams):
    got = q.aggregate(teams, "Person", {"team": "Team.display_name"}, {"people": measure("count"), "ids": child("identities.identity_key"), "pulls": child("identities.PullRequest.pull_request_key")}, order=["team"])
    assert [tuple(r) for r in got.collect()] == [("(unset)", 1, 0, 0), ("One", 2, 3, 4)]


def test_traversed_null_is_unset_but_attribute_is_not(teams):
    got = q.aggregate(teams, "Person", {"name": "name"}, {"n": measure("count")}, attributes={"team": "Team.display_name"}, order=["name desc"])
    assert [(r.name, r.team) for r in got.collect()] == [("Cy", None), ("Bo", "One"), ("Ann", "One")]


def test_shortest_path_and_inferred_child(teams):
    assert teams.path("PullRequest", "Team") == ["by_identity", "of_person", "in_team"]
    assert teams.relation("Team", "Person").kind == "o2m"
    assert teams.child_field("Person", "identities")[1] == "identity_key"
    teams.check()


@pytest.mark.parametrize("call", [
    lambda m: q.detail(m, "Person", {}),
    lambda m: q.detail(m, "Nobody", {"a": "a"}),
    lambda m: q.detail(m, "Person", {"a": "nope"}),
    lambda m: q.detail(m, "Person", {"a": "identities.identity_key"}),
    lambda m: q.aggregate(m, "Person", {}, {"a": measure("median", "name")}),
    lambda m: q.windowed(m.table("Person"), "w", "name", "simple", "name", []),
    lambda m: q.windowed(m.table("Person"), "w", "name", "lag", "name", []),
    lambda m: q.windowed(m.table("Person"), "w", "name", "weighted", "name", [], "sum", 3),
    lambda m: q.window_keys(["a"], "rows", {}),
    lambda m: q.window_keys(["a", "b"], "month", {"a": "day"}),
    lambda m: m.path("Team", "Person"),
    lambda m: q.check_time_slice(m, "Person", "name", "YYYY"),
])
def test_bad_definitions(teams, call):
    with pytest.raises(ValueError):
        call(teams)


def test_history_root_shows_open_rows(spark):
    h = spark.createDataFrame([("a", "1", ""), ("a", "0", "1"), ("b", "1", None)], "k string, valid_from string, valid_to string")
    m = Model.of((Entity("H", "k", history=("valid_from", "valid_to")), h))
    assert q.detail(m, "H", {"k": "k"}).count() == 2
    assert q.aggregate(m, "H", {}, {"n": measure("count")}, as_of=F.lit("0")).first().n == 1


def test_ratio_of_zero_is_null_and_thresholds(spark):
    m = Model.of((Entity("A", "k"), spark.createDataFrame([("a", 1.0, 0.0), ("b", 4.0, 2.0), ("c", None, 1.0)], "k string, x double, y double")))
    got = q.aggregate(m, "A", {"k": "k"}, {"r": measure("sum", "x") / measure("sum", "y")}, thresholds={"r": [(">", 1, "high"), (">=", 0, "low")]}, order=["k"])
    assert [(x.r, x.r_status) for x in got.collect()] == [(None, None), (2.0, "high"), (None, None)]


def test_page_params_and_positional_order(spark):
    rows, total = q.page(spark.range(25), 3, 10, ["id"])
    assert [r.id for r in rows.collect()] == [20, 21, 22, 23, 24] and tuple(total.first()) == (25, False)
    keep = q.apply_params([("a", lambda v: v), ("b", lambda v: v), ("c", lambda v: v)], {"a": 1, "b": 2}, {"b": "", "c": None})
    assert keep == [1, 2]
    assert q.positional_order({"x": "2", "y": "1, desc"}) == ["y desc", "x asc"]
