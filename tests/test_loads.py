import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scalars
from quarryline.operators import features, feed, joins, load, mapper, search, tables, views
from quarryline.sources import ingest
from quarryline.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_composite_heterogeneous_and_all_key(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (None, "c", "z")], "k int, l string, v string")
    new = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 6, 2), (None, "c", 7, 1), (2, "d", 8, 1)], "k int, l string, w int, seq int")
    got = load.upsert(old, new, ["k", "l"], F.col("seq")).select("k", "l", "v", "w")
    assert rows(got) == sorted([(1, "a", None, 6), (1, "b", "y", None), (None, "c", None, 7), (2, "d", None, 8)], key=str)
    with pytest.raises(ValueError):
        load.upsert(old, new, [], F.col("seq"))
    tied = spark.createDataFrame([(9, "z", "p", 1), (9, "z", "q", 1)], "k int, l string, v string, seq int")
    assert load.upsert(old, tied, ["k", "l"], F.col("seq")).filter("k = 9").first().v == "q"


def test_scd2(spark):
    h = spark.createDataFrame([("same", "1", "2023", None), ("diff", "1", "2023", ""), ("gone", "1", "2023", None), ("diff", "0", "2022", "2023"), ("null", None, "2023", None)], "k string, v string, valid_from string, valid_to string")
    c = spark.createDataFrame([("same", "1"), ("diff", "2"), ("new", "9"), ("null", None)], "k string, v string")
    got = load.scd2(h, c, ["k"], ["v"], F.lit("2024"))
    assert rows(got) == sorted([("same", "1", "2023", None), ("diff", "1", "2023", "2024"), ("diff", "2", "2024", None), ("gone", "1", "2023", None), ("diff", "0", "2022", "2023"), ("null", None, "2023", None), ("new", "9", "2024", None)], key=str)
    assert tuple(load.scd2_stats(h, c, ["k"], ["v"]).first()) == (1, 1, 2)


def test_event_load_prune_groups(spark):
    there = spark.createDataFrame([("e1", None, "t0")], "id string, v string, inserted_at string")
    new = spark.createDataFrame([("e1", None), ("e2", "x"), ("e2", "x")], "id string, v string")
    assert [r[0] for r in rows(load.load_events(there, new, F.lit("t1")))] == ["e1", "e2"]
    assert load.prune(there, new.filter("false"), ["id"]).count() == 0
    a = spark.createDataFrame([("k", "", None)], "k string, x string, y string")
    b = spark.createDataFrame([("k", "b", "y"), ("j", None, "z")], "k string, x string, y string")
    assert rows(load.merge_groups([a, b], ["k"])) == [("j", None, "z"), ("k", "b", "y")]


def test_fan_out_and_failures(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        load.check_fan_out(["k"], df)
    load.check_fan_out(["k", "v"], df)
    good, bad = load.map_rows(df, {"n": F.col("v").try_cast("int"), "k": F.col("k")}, ["n"])
    assert good.count() == 0 and [r.failed for r in bad.collect()] == [["n"], ["n"]]


def test_since_mark(spark):
    log = spark.createDataFrame([("t", "success", "2024-01-02", "p"), ("t", "success", "2024-01-05", "q"), ("t", "failed", "2024-01-09", "p")], "task string, status string, started_at string, param_key string")
    assert load.since_mark(log, "t", "2020") == "2020"
    assert load.since_mark(log, "t") == "2024-01-05" and load.since_mark(log, "t", param_key="p") == "2024-01-02"
    assert load.since_mark(log, "t", declared="2024-02-01") == "2024-02-01" and load.since_mark(log, "u") is None


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"key": "K1",\n "fields": {"status": {"name": "Open"}, "labels": ["x", "y"]}, "changes": [{"id": 1}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('{"key": "K2", "changes": "none"}')
    records = ingest.read_json(spark, str(tmp_path / "*.json"))
    got = ingest.project(records, {"key": ("key", "STRING"), "status": ("fields.status", "STRING"), "labels": ("fields.labels", "STRING"), "raw": ("fields.status", "JSON")}, {"run": 1})
    assert rows(got) == [("K1", "Open", "x, y", '{"name":"Open"}', 1), ("K2", None, None, None, 1)]
    items = ingest.explode_path(records, "changes", {"key": "key"})
    assert rows(items) == [("K1", '{"id":1}'), ("K1", '{"id":2}')]
    (tmp_path / "OWNERS").write_text("# c\n\n*.py @a  @b\nlonely\n")
    assert rows(ingest.read_ownership(spark, str(tmp_path / "OWNERS"))) == [("*.py", "@a"), ("*.py", "@b")]
    (tmp_path / "x.csv").write_text("a,b\n1,\n")
    assert ingest.read_csv(spark, str(tmp_path / "x.csv")).dtypes == [("a", "string"), ("b", "string")]
    out = str(tmp_path / "out")
    ingest.export_tables({"t": got}, out)
    assert ingest.import_table(spark, out, "t").count() == 2
    ingest.attach(spark, out, "other", ["t"])
    assert spark.table("other_t").count() == 2
    assert ingest.replace_table(got.filter("false"), out + "/t") is False and ingest.import_table(spark, out, "t").count() == 2


def test_containment_joins(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    right = spark.createDataFrame([(1, '["a","a","c"]'), (2, "b"), (3, None)], "id int, items string")
    assert rows(joins.scalar_or_array_contains(left, right, "v", "items").select("v", "id")) == sorted([("a", 1), ("b", 2), (None, None)], key=str)
    assert rows(joins.json_array_contains(left, right, "v", F.col("items"), "inner").select("v", "id")) == [("a", 1)]


def test_diversity_rank_equals_greedy(spark):
    rng = random.Random(3)
    for _ in range(3):
        items = [(k, rng.choice("abc"), rng.choice([0.0, 1.0, 2.0, 4.0, rng.random()])) for k in range(30)]
        left, seen, order = list(items), {}, []
        while left:
            best = max(left, key=lambda x: (x[2] * 0.5 ** seen.get(x[1], 0), -x[0]))
            left.remove(best)
            seen[best[1]] = seen.get(best[1], 0) + 1
            order.append(best[0])
        got = feed.diversity_rank(spark.createDataFrame(items, "id int, d string, s double"), "s", "d", "id").orderBy("position")
        assert [r.id for r in got.collect()] == order
    assert feed.pool_size(0, 5) == 100 and feed.pool_size(90, 20) == 500


def test_significance(spark):
    series = {"flat": [5.0] * 4, "spike": [5.0, 6.0, 5.0, 50.0], "zero": [0.0, 0.0, 3.0], "one": [1.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "g string, t int, v double")
    got = {r.g: r.significance for r in views.significance(df, ["g"], "v", "t").collect()}
    assert got == {"flat": 0.0, "spike": 10.0, "zero": 10.0, "one": 0.0}


def test_views(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, None, 2.0), (2, "a", 0.0)], "x int, s string, v double")
    assert rows(views.pivot(df, "x", "s", "v", ["a", "(unset)"])) == [(1, 2.0, 2.0), (2, 0.0, None)]
    assert rows(views.percent_stack(df, "x", "v").select("share")) == [(0.0,), (0.5,), (0.5,)]
    with pytest.raises(ValueError):
        views.checked_columns(df, ["nope"])


def test_search_and_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id int, embedding array<float>")
    assert [r.id for r in search.find(v, [1.0, 0.1], 2, "id", max_distance=2.0).collect()] == [1, 2]
    assert search.find_each(v, v.filter("id = 1"), 1, "id").first().id in (2, 3)
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    old = spark.createDataFrame([(1, "x"), (3, "c")], "k int, v string")
    assert rows(tables.keyed_diff(old, new, ["k"], ["v"])) == [(1, "updated"), (2, "created"), (3, "deleted")]
    assert all(r.same for r in tables.parity(new, new).collect())


def test_features(spark):
    w = spark.createDataFrame([("a", 3.5), ("b", None)], "k string, v double")
    f = features.Feature("v2", "w", "k", "v * 2")
    store = features.long_values(spark, [f], {"w": w}, F.lit("t"))
    assert rows(store.select("entity_id", "value")) == [("a", "7.0"), ("b", None)]
    again = features.reconcile(spark, [f], {"w": w}, store, F.lit("t2"))
    assert again.count() == 2 and features.null_rates(again).first().null_rate == 0.5
    assert features.feature_column(w, again, "v2", "k").filter("k = 'a'").first().v2 == 7.0
    known = spark.createDataFrame([("v2", f.checksum())], "feature_id string, checksum string")
    states = {r.feature_id: r.state for r in features.diff(spark, [f, features.Feature("n", "w", "k", "1")], known).collect()}
    assert states == {"v2": "WOULD RECOMPUTE", "n": "NEW"}
    assert features.preview(spark, f, {"w": w}, ["a"]).count() == 1
    for bad in ("SELECT 1 AS value", "SELECT k AS entity_id, v AS value FROM w LIMIT 1"):
        with pytest.raises(ValueError):
            features.evaluate(spark, features.Feature("x", "w", "k", sql=bad), {"w": w})


def test_stream_takes_only_what_is_new(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")], "event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    for part in itertools.count():
        e.withColumn("event_id", F.col("event_id") + 10 * part).write.mode("append").parquet(src)
        stream = events.dedupe(events.read_new_files(spark, src, e.schema), ["event_id"], "ts")
        events.ingest_available(stream, out, cp).awaitTermination()
        assert spark.read.parquet(out).count() == 2 * (part + 1)
        if part:
            break


def test_scd2_of_repeated_and_null_keys(spark):
    h = spark.createDataFrame([("a", "1", "2023", None), (None, "1", "2023", None)], "k string, v string, valid_from string, valid_to string")
    c = spark.createDataFrame([("a", "2", 1), ("a", "2", 1), ("a", "3", 2), (None, "1", 1), ("new", "9", 1), ("new", "9", 1)], "k string, v string, seq int")
    got = load.scd2(h, c, ["k"], ["v"], F.lit("2024"), order=F.col("seq"))
    assert rows(got) == sorted([("a", "1", "2023", "2024"), ("a", "3", "2024", None), (None, "1", "2023", None), ("new", "9", "2024", None)], key=str)
    assert tuple(load.scd2_stats(h, c, ["k"], ["v"], order=F.col("seq")).first()) == (1, 1, 1)


def test_prune_only_if_nothing_failed(spark):
    t = spark.createDataFrame([(1,), (2,)], "k int")
    assert load.prune(t, t.filter("k = 1"), ["k"]).count() == 1
    assert load.prune(t, t.filter("k = 1"), ["k"], failed=t).count() == 2


def test_replace_reads_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    assert ingest.replace_table(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_raw_sql_leaves_the_sessions_views_alone(spark):
    spark.range(3).createOrReplaceTempView("w")
    own = spark.createDataFrame([("a", 3.5)], "k string, v double")
    f = features.Feature("x", "w", "k", sql="SELECT k AS entity_id, v AS value FROM w JOIN w u USING (k, v) WHERE k <> '{}'")
    assert rows(features.evaluate(spark, f, {"w": own})) == [("a", 3.5)] and spark.table("w").count() == 3


def test_sql_functions_and_fan_out(spark):
    scalars.register_sql(spark, "plus_two", "x + 2", "x INT", "INT")
    f = features.Feature("x", "w", "k", sql="SELECT k AS entity_id, plus_two(v) AS value FROM w", kind="long")
    assert rows(features.evaluate(spark, f, {"w": spark.createDataFrame([("a", 3)], "k string, v int")})) == [("a", 5)]
    records = spark.createDataFrame([('{"a": 1, "b": {"name": "n"}}',)], "record string")
    out = ingest.fan_out(records, {"one": {"a": ("a", "INTEGER")}, "two": {"b": ("b", "STRING"), "raw": ("b", "JSON")}})
    assert rows(out["one"]) == [(1,)] and rows(out["two"]) == [("n", '{"name":"n"}')]


def test_registry_order_ttl_and_mode(spark):
    a, b = features.Feature("a", "w", "k", "v", needs=("b",)), features.Feature("b", "w", "k", "v", ttl_seconds=60)
    live = features.Feature("c", "w", "k", "v", mode="dynamic")
    assert [f.id for f in features.in_order([a, b, live])] == ["b", "a", "c"]
    reg = features.register(spark, [a, b, live])
    assert {r.feature_id: r.version for r in features.register(spark, [a, b, live], reg).collect()} == {"a": 1, "b": 1, "c": 1}
    store = spark.createDataFrame([("a", "x", "1", "2024-01-01 00:00:00"), ("b", "x", "1", "2024-01-01 00:00:00")], "feature_id string, entity_id string, value string, computed_at string")
    at = lambda t: F.lit(t).cast("timestamp")
    assert features.stale([a, b, live], store, reg, at("2024-01-01 00:00:30")) == []
    assert [f.id for f in features.stale([a, b, live], store, reg, at("2024-01-01 00:02:00"))] == ["b"]
    changed = features.Feature("a", "w", "k", "v + 1")
    assert [f.id for f in features.stale([changed, b], store, reg, at("2024-01-01 00:00:30"))] == ["a"]
    with pytest.raises(ValueError):
        features.in_order([a, features.Feature("b", "w", "k", "v", needs=("a",))])


def test_run_log_since_and_declared_tables(spark):
    log = spark.createDataFrame([("t", "success", "2024-01-02")], "task string, status string, started_at string")
    log = load.record_run(log, "t", "2024-02-01", "2024-02-02", 7, "success", "p")
    assert load.since_mark(log, "t") == "2024-02-01" and log.count() == 2
    df = spark.createDataFrame([("2024-02-01T10:00:00",), ("2024-01-01T00:00:00",), (None,)], "at string")
    assert load.changed_since(df, "at", "2024-02-01").count() == 1 and load.changed_since(df, "at", None).count() == 3
    made = ingest.declared_table(spark, {"k": "STRING", "n": "INTEGER", "x": "FLOAT"}, event=True, history=("valid_from", "valid_to"))
    assert made.dtypes == [("k", "string"), ("n", "bigint"), ("x", "double"), ("valid_from", "string"), ("valid_to", "string"), ("inserted_at", "timestamp")] and made.count() == 0
    with pytest.raises(ValueError):
        ingest.declared_table(spark, {"k": "DECIMAL"})


def test_mapper_checks_and_strict(spark):
    t = {"a": spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), "b": spark.createDataFrame([(1, "p"), (1, "q")], "k int, w string")}
    join = [(mapper.Source("b", ("b",)), mapper.Join("b", (("a.k", "k"),)))]
    keep = mapper.Target("t", {"k": lambda j: j["a.k"], "v": lambda j: j["v"]}, required=("v",))
    got = mapper.run_mapper(t, mapper.Source("a", ("a", "a"), ("k", "v"), dedupe=("k",)), [], [keep])["t"]
    assert rows(got[0]) == [(1, "x")] and got[1].count() == 1
    with pytest.raises(ValueError):
        mapper.run_mapper(t, mapper.Source("a", ("a",)), join, [keep], ["k"])
    with pytest.raises(ValueError):
        mapper.run_mapper(t, mapper.Source("a", ("a",)), [], [keep], strict=True)
    for bad in (lambda: mapper.Source("a", ("nope",)).read(t), lambda: mapper.join_sources(t, mapper.Source("a", ("a",)), [(mapper.Source("a", ("b",)), mapper.Join("a", (("a.k", "k"),)))]), lambda: mapper.join_sources(t, mapper.Source("a", ("a",)), [(mapper.Source("b", ("b",)), mapper.Join("b", (("a.k", "k"),), "full"))])):
        with pytest.raises(ValueError):
            bad()


def test_search_without_a_limit_on_queries(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(40)], "id int, embedding array<float>")
    one = rows(search.find_each(v, v.filter("id % 2 = 0"), 3, "id").select("query_id", "id", "position"))
    assert one == rows(search.find_each(v, v.filter("id % 2 = 0"), 3, "id", block=4).select("query_id", "id", "position")) and len(one) == 60


def test_stream_windows_close_at_the_watermark(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    e = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 00:20:00"), ("a", "2024-01-01 05:00:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(src)
    counts = events.windowed_counts(events.read_new_files(spark, src, e.schema), "ts", "k")
    counts.select("k", "n", "window.start").writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    assert rows(spark.read.parquet(out).select("k", "n")) == [("a", 2), ("b", 1)]


def test_types_by_json_values(spark):
    """Numbers by what they are, not by what text looks like."""
    records = spark.createDataFrame([('{"a": 7, "b": 1.5, "c": "007", "d": true, "e": {"x": 1}, "f": [1], "h": 1, "o.k": 2}',), ('{"a": -3, "b": 2, "c": "1d", "d": false, "g": null, "h": "x"}',), ("no json",), (None,)], "record string")
    paths = {n: n for n in "abcdefgh"} | {"x": "e.x", "all": "$"}
    types = ingest.json_types(records, paths)
    assert types == {"a": "long", "b": "double", "c": "string", "d": "long", "e": "string", "f": "string", "g": "string", "h": "string", "x": "long", "all": "string"}
    got = ingest.project_typed(records, paths, types).collect()
    assert (got[0].a, got[0].b, got[0].c, got[0].d, got[0].e, got[0].f, got[0].h, got[0].x) == (7, 1.5, "007", 1, '{"x":1}', "[1]", "1", 1)
    assert got[2].a is None and got[2].c is None
    assert ingest.json_types(records.limit(0), {"a": "a"}) == {"a": "string"}


def test_types_widen_between_batches(spark):
    of = lambda *rows: spark.createDataFrame([(r,) for r in rows], "record string")
    t = ingest.append_typed(None, of('{"k": 1, "v": 7}'), {"k": "k", "v": "v"})
    assert dict(t.dtypes)["v"] == "bigint"
    t = ingest.append_typed(t, of('{"k": 2, "v": 7.5, "w": "x"}'), {"k": "k", "v": "v", "w": "w"})
    assert dict(t.dtypes) == {"k": "bigint", "v": "double", "w": "string"}
    t = ingest.append_typed(t, of('{"k": 3}'), {"k": "k", "v": "v"})
    assert dict(t.dtypes)["v"] == "double"  # no values, no change
    t = ingest.append_typed(t, of('{"k": 4, "v": "late"}'), {"k": "k", "v": "v"})
    assert rows(t) == [(1, "7.0", None), (2, "7.5", "x"), (3, None, None), (4, "late", None)]


def test_codes_in_text_stay_text(spark):
    df = spark.createDataFrame([("007", "1d", "NaN", "+1", "-0", "12", "1.5", None), ("010", "2f", "1", "2", "0", "-7", "-2e3", None)], "a string, b string, c string, d string, e string, f string, g string, h string")
    assert [t for _, t in ingest.infer_types(df).dtypes] == ["string"] * 4 + ["double", "bigint", "double", "string"]


def test_mapper_row_groups_stats_and_prune(spark):
    """Groups merge by key; each target's failures are counted; a load prunes only if nothing failed."""
    t = {"a": spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "k int, v string"), "b": spark.createDataFrame([(2, "late"), (3, "new")], "k int, v string")}
    of = lambda s: mapper.Rows(mapper.Source(s, (s,)), {"k": lambda j: j[f"{s}.k"], "v": lambda j: j[f"{s}.v"]})
    target = mapper.Target("t", {}, required=("k",), rows=(of("a"), of("b")), key=("k",))
    plain = mapper.Target("p", {"k": lambda j: j["a.k"], "v": lambda j: j["a.v"]}, required=("k", "v"), fails={"k": lambda j: j["a.k"] == 7})
    grain = mapper.Source("a", ("a",))
    got = mapper.run_mapper(t, grain, [], [target, plain])
    assert rows(got["t"][0]) == [(1, "x"), (2, "late"), (3, "new")] and got["t"][1].count() == 1
    assert rows(mapper.stats(t, grain, [], [target, plain])) == [("p", 1, 2), ("t", 3, 1)]
    existing = spark.createDataFrame([(1, "old"), (9, "gone")], "k int, v string")
    good, bad = got["t"]
    assert rows(mapper.load_target(existing, good, bad, ["k"], F.lit(0), True)) == [(1, "x"), (2, "late"), (3, "new"), (9, "gone")]
    assert rows(mapper.load_target(existing, good, bad.limit(0), ["k"], F.lit(0), True)) == [(1, "x"), (2, "late"), (3, "new")]
    with pytest.raises(ValueError):
        mapper.run_mapper(t, grain, [], [plain], strict=True)
    with pytest.raises(ValueError):
        mapper.run_mapper(t, grain, [], [mapper.Target("t", {}, rows=(of("a"),))])
    for bad_join in (mapper.Join("b", (("a.k", "k"),), holds="near"), mapper.Join("b", ())):
        with pytest.raises(ValueError):
            mapper.join_sources(t, grain, [(mapper.Source("b", ("b",)), bad_join)])


def test_null_keys_are_equal_in_a_diff(spark):
    old, new = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int"), spark.createDataFrame([(None, 2), (2, 1)], "k int, v int")
    assert sorted(map(tuple, tables.keyed_diff(old, new, ["k"], ["v"]).collect()), key=str) == [(1, "deleted"), (2, "created"), (None, "updated")]
