"""Ingest, entity loads, features and table checks on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import datetime_diff, enum, enum_fails
from ..operators import features, load, mapper, tables
from ..sources import ingest
from ..sources.versioned import VersionedTable
from .base import USER_STATES, registrar, scratch, table, user_states

QUERIES: dict = {}
ORACLE_SQL: dict = {}
register = registrar(QUERIES, ORACLE_SQL)


def nested_conversations(spark, sf):
    """JSON records of up to a hundred turns of a conversation, its turns an array; so no conversation is one row."""
    c = table(spark, sf, "conversations")
    turn = F.struct("turn", "role", F.struct(F.col("text").alias("value")).alias("body"))
    return c.groupBy("conv_id", F.floor(F.col("turn") / 100).alias("part")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(F.to_json(F.struct("conv_id", "turns")).alias("record"))


@register("SELECT conv_id, turn, role, text FROM conversations")
def explode_records(spark, sf):
    """Nested records back to flat rows: explode, inherit, project, coerce."""
    rows = ingest.explode_path(nested_conversations(spark, sf), "turns", {"conv_id": "conv_id"})
    out = ingest.project(rows, {"turn": ("turn", "INTEGER"), "role": ("role", "STRING"), "text": ("body", "STRING")}, keep=["conv_id"])
    return out.withColumn("conv_id", F.col("conv_id").cast("long"))


@register("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing, props AS whole, 'run-1' AS batch FROM events")
def json_paths_and_context(spark, sf):
    e = table(spark, sf, "events").withColumn("record", F.col("props"))
    return ingest.project(e, {"k": ("k", "INTEGER"), "missing": ("a.b", "STRING"), "whole": ("$", "JSON")}, {"batch": "run-1"}, keep=["event_id"])


@register("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS types FROM events GROUP BY 1")
def coerce_lists(spark, sf):
    u = table(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.transform(F.sort_array(F.collect_set("event_type")), lambda x: F.struct(F.lit(1).alias("id"), x.alias("name")))).alias("record"))
    return ingest.project(u, {"types": ("$", "STRING")}, keep=["user_id"])


@register("SELECT p_partkey, split_part(p_brand, '#', 1) || '*' AS pattern, unnest(string_split(p_type, ' ')) AS owner FROM part WHERE p_size > 5")
def ownership_pairs(spark, sf):
    """Part rows as ownership lines: a pattern and its owners; small parts are comments."""
    p = table(spark, sf, "part")
    line = F.concat(F.when(F.col("p_size") > 5, "").otherwise("# "), F.split_part("p_brand", F.lit("#"), F.lit(1)), F.lit("*  "), F.col("p_type"))
    return ingest.ownership_lines(p.select("p_partkey", line.alias("value")), keep=["p_partkey"])


@register("SELECT event_id, CASE WHEN event_type = 'view' THEN ts WHEN event_type = 'click' THEN ts + INTERVAL 1 MINUTE ELSE ts + INTERVAL 1 HOUR END AS created_at, user_id AS id_from_url FROM events")
def normalise_events(spark, sf):
    e = table(spark, sf, "events")
    at = ingest.created_at(F.col("event_type"), {"view": F.col("ts"), "click": F.col("ts") + F.expr("INTERVAL 1 MINUTE")}, F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return e.select("event_id", at.alias("created_at"), ingest.id_from_url(F.concat(F.lit("https://a.example/users/"), F.col("user_id"))).alias("id_from_url"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice END AS new_price FROM orders UNION ALL SELECT -o_orderkey, 'N', CAST(NULL AS DOUBLE) FROM orders WHERE o_orderkey % 100 = 1")
def upsert_rows(spark, sf):
    """A tenth of the rows updated, some inserted, a column added; of two versions in the batch the later wins."""
    o = table(spark, sf, "orders")
    old = o.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    upd = o.filter("o_orderkey % 10 = 0")
    new = upd.select("o_orderkey", F.lit("early").alias("status"), F.lit(0.0).alias("new_price"), F.lit(1).alias("seq")).unionByName(upd.select("o_orderkey", F.lit("X").alias("status"), F.col("o_totalprice").alias("new_price"), F.lit(2).alias("seq")))
    new = new.unionByName(o.filter("o_orderkey % 100 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status"), F.lit(None).cast("double").alias("new_price"), F.lit(1).alias("seq")))
    return load.upsert(old, new, ["o_orderkey"], F.col("seq")).select("o_orderkey", "status", "new_price")


@register("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def union_and_dedupe(spark, sf):
    e = table(spark, sf, "events")
    both = e.filter("event_id % 2 = 0").unionByName(e.filter("event_id % 2 = 1")).unionByName(e.filter("event_id % 3 = 0"))
    once = load.keep_first(both, ["event_id"], [F.col("ts")])
    return once.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'second' END AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 5 <> 0 THEN 'later' END AS segment FROM customer")
def row_groups(spark, sf):
    """Three sources of one entity: the first value that isn't empty wins."""
    c = table(spark, sf, "customer")
    first = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("segment"))
    second = c.select("c_custkey", F.lit("second").alias("name"))
    third = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.lit("third").alias("name"), F.lit("later").alias("segment"))
    return load.merge_groups([first, second, third], ["c_custkey"])


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def prune_rows(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return load.prune(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"])


def _scd2(spark, sf):
    c = table(spark, sf, "customer")
    old = c.filter("c_custkey % 4 <> 0").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.expr("TIMESTAMP '2024-01-01'").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    new = c.filter("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "moved").otherwise(F.col("c_mktsegment")).alias("segment"))
    return old, new


@register(
    "SELECT c_custkey, c_mktsegment AS segment, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN TIMESTAMP '2024-02-01' END AS valid_to FROM customer WHERE c_custkey % 4 <> 0 "
    "UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END, TIMESTAMP '2024-02-01', NULL FROM customer WHERE c_custkey % 7 <> 0 AND (c_custkey % 4 = 0 OR c_custkey % 3 = 0)"
)
def scd2_load(spark, sf):
    """New keys open, changed ones close and open again, missing and unchanged ones stay."""
    old, new = _scd2(spark, sf)
    return load.scd2(old, new, ["c_custkey"], ["segment"], F.expr("TIMESTAMP '2024-02-01'"))


@register("SELECT count(*) FILTER (WHERE c_custkey % 4 = 0) AS new_keys, count(*) FILTER (WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0) AS versioned, count(*) FILTER (WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0) AS unchanged FROM customer WHERE c_custkey % 7 <> 0")
def scd2_dry_run(spark, sf):
    return load.scd2_stats(*_scd2(spark, sf), ["c_custkey"], ["segment"])


@register("SELECT DISTINCT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS inserted_at FROM events")
def event_load(spark, sf):
    """Only events that aren't there yet are added, once each."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    there = e.filter("event_id % 2 = 0").withColumn("inserted_at", F.expr("TIMESTAMP '2024-01-01'"))
    return load.load_events(there, e.unionByName(e), F.expr("TIMESTAMP '2024-02-01'"))


KINDS = {"look": ["view"], "touch": ["click"]}


def _some_types(spark, sf):
    """Events, a tenth of them without a type: these map to null, and only unknown types fail."""
    return table(spark, sf, "events").withColumn("event_type", F.when(F.col("event_id") % 10 != 0, F.col("event_type")))


@register("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_type = 'view' THEN 'look' WHEN event_type = 'click' THEN 'touch' END AS kind, 'web' AS origin FROM events WHERE event_type IN ('view', 'click') OR event_id % 10 = 0")
def mapped_rows(spark, sf):
    e = _some_types(spark, sf)
    good, _ = load.map_rows(e, {"event_id": F.col("event_id"), "kind": enum(F.col("event_type"), KINDS)}, static={"origin": "web"}, fails={"kind": enum_fails(F.col("event_type"), KINDS)})
    return good


@register("SELECT event_id, 'kind' AS failed FROM events WHERE event_type NOT IN ('view', 'click') AND event_id % 10 <> 0")
def failed_rows(spark, sf):
    _, bad = load.map_rows(_some_types(spark, sf), {"kind": enum(F.col("event_type"), KINDS)}, fails={"kind": enum_fails(F.col("event_type"), KINDS)})
    return bad.select("event_id", F.array_join("failed", ",").alias("failed"))


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_grain(spark, sf):
    return load.fan_out_keys(["l_orderkey", "l_linenumber"], table(spark, sf, "lineitem"))


@register("SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)")
def orphan_rows(spark, sf):
    c = table(spark, sf, "customer").filter("c_custkey % 9 <> 0")
    return tables.orphans(table(spark, sf, "orders"), c, "o_custkey", "c_custkey").select("o_orderkey")


@register("SELECT c_custkey, CASE WHEN c_custkey % 6 = 1 THEN 'created' WHEN c_custkey % 5 = 1 THEN 'deleted' ELSE 'updated' END AS change FROM customer WHERE (c_custkey % 6 = 1 AND c_custkey % 5 <> 1) OR (c_custkey % 5 = 1 AND c_custkey % 6 <> 1) OR (c_custkey % 7 = 0 AND c_custkey % 5 <> 1 AND c_custkey % 6 <> 1)")
def snapshot_diff(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    old = c.filter("c_custkey % 6 <> 1")
    new = c.filter("c_custkey % 5 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, "renamed").otherwise(F.col("c_name")))
    return tables.keyed_diff(old, new, ["c_custkey"], ["c_name"])


@register("WITH b AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_custkey FROM customer) SELECT 'c_custkey' AS \"column\", (SELECT count(*) FROM customer) AS left_rows, 0::BIGINT AS left_null, (SELECT count(*) FROM b) AS right_rows, 0::BIGINT AS right_null, true AS same UNION ALL SELECT 'c_acctbal', (SELECT count(*) FROM customer), 0, (SELECT count(*) FROM b), (SELECT count(*) FROM b WHERE c_acctbal IS NULL), (SELECT count(*) FROM b WHERE c_acctbal IS NULL) = 0")
def table_parity(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return tables.parity(c, c.withColumn("c_acctbal", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))))


@register("WITH u AS (SELECT o_orderdate AS moment, 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT l_shipdate, 'shipment', l_orderkey * 100 + l_linenumber FROM lineitem) SELECT moment, kind, id, true AS has_more FROM (SELECT DISTINCT moment, kind, id FROM u) ORDER BY moment DESC, kind, id LIMIT 50 OFFSET 50")
def activity_timeline(spark, sf):
    """A page of orders and shipments, newest first."""
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("moment"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    s = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("moment"), F.lit("shipment").alias("kind"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id")).distinct()
    return tables.timeline([o, s], "moment", ["kind", "id"], 50, 50)


FEATURES = [
    features.Feature("balance", "customer", "c_custkey", "c_acctbal"),
    features.Feature("n_orders", "orders", "o_custkey", "count(1)", aggregate=True, kind="long"),
    features.Feature("spent", "orders", "o_custkey", sql="SELECT o_custkey AS entity_id, CAST(max(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY o_custkey"),
]


def _features(spark, sf):
    t = {n: table(spark, sf, n) for n in ("customer", "orders")}
    store = t["customer"].filter("c_custkey % 2 = 0").select(F.lit("n_orders").alias("feature_id"), F.col("c_custkey").cast("string").alias("entity_id"), F.lit("-1").alias("value"), F.expr("TIMESTAMP '2024-01-01'").alias("computed_at"))
    return t, features.reconcile(spark, FEATURES, t, store, F.expr("TIMESTAMP '2024-02-01'"))


@register("WITH n AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1) SELECT CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS entity_id, CAST(coalesce(v, -1) AS VARCHAR) AS value, v IS NOT NULL AS fresh FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL JOIN n ON c_custkey = o_custkey")
def feature_reconcile(spark, sf):
    """Recomputed values replace stored ones; entities without a new value keep theirs."""
    _, store = _features(spark, sf)
    return store.filter("feature_id = 'n_orders'").select("entity_id", "value", (F.col("computed_at") > F.expr("TIMESTAMP '2024-01-15'")).alias("fresh"))


@register("SELECT c_custkey, m.v AS best, CAST(n.v AS BIGINT) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS v FROM orders GROUP BY 1) m ON m.o_custkey = c_custkey LEFT JOIN (SELECT coalesce(k.o_custkey, c_custkey) AS o_custkey, coalesce(k.v, -1) AS v FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1) k ON c_custkey = k.o_custkey) n ON n.o_custkey = c_custkey")
def feature_columns(spark, sf):
    t, store = _features(spark, sf)
    c = features.feature_column(t["customer"].select("c_custkey"), store, "spent", "c_custkey", "double", "best")
    return features.feature_column(c, store, "n_orders", "c_custkey", "long")


@register("SELECT 'balance' AS feature_id, count(*) AS n, count(*) - count(c_acctbal) AS n_null, CAST(0 AS DOUBLE) AS null_rate FROM customer UNION ALL SELECT 'spent', count(DISTINCT o_custkey), 0, 0 FROM orders UNION ALL SELECT 'n_orders', count(*), 0, 0 FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def feature_null_rates(spark, sf):
    return features.null_rates(_features(spark, sf)[1])


@register("SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(count(*) AS VARCHAR) AS n_orders FROM orders GROUP BY 1")
def feature_maps(spark, sf):
    """Values of each entity as a map."""
    maps = features.value_maps(features.long_values(spark, FEATURES, _features(spark, sf)[0], F.current_timestamp()))
    return maps.select("entity_id", F.col("features")["n_orders"].alias("n_orders")).filter("n_orders is not null")


@register("SELECT event_id, round(value * 2, 6) AS twice, round(value * 2 - lag(value * 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS step FROM events")
def two_phase_features(spark, sf):
    """A window feature over another feature."""
    twice = features.Feature("twice", "events", "event_id", "value * 2")
    step = features.Feature("step", "events", "event_id", "twice - lag(twice) OVER (PARTITION BY user_id ORDER BY ts, event_id)", needs=("twice",))
    return features.with_features(table(spark, sf, "events"), [step, twice]).select("event_id", F.round("twice", 6).alias("twice"), F.round("step", 6).alias("step"))


@register("SELECT task, max(started_at) AS since FROM (SELECT event_type AS task, ts AS started_at FROM events WHERE value > 50) GROUP BY 1")
def high_water_marks(spark, sf):
    """Last successful start per task, from events as a run log."""
    log = table(spark, sf, "events").select(F.col("event_type").alias("task"), F.col("ts").alias("started_at"), F.when(F.col("value") > 50, "success").otherwise("failed").alias("status"))
    return load.since_marks(log)


@register(f"SELECT state, count(*) AS n, count(*) FILTER (WHERE valid_to IS NULL) AS open FROM {USER_STATES} GROUP BY 1")
def state_history(spark, sf):
    return user_states(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("valid_to").isNull()).alias("open"))


@register("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[WIP] ' || event_type WHEN 1 THEN '{draft ' || event_type WHEN 2 THEN event_type || ', ' || event_type END AS title FROM events")
def coerce_plain_text(spark, sf):
    """Text that begins like a list or an object and is none stays as it is."""
    e = table(spark, sf, "events")
    kind = F.col("event_id") % 4
    value = F.when(kind == 0, F.to_json(F.struct(F.concat(F.lit("[WIP] "), "event_type").alias("t")))).when(kind == 1, F.to_json(F.struct(F.concat(F.lit("{draft "), "event_type").alias("t")))).when(kind == 2, F.to_json(F.struct(F.array("event_type", "event_type").alias("t"))))
    return ingest.project(e.withColumn("record", value), {"title": ("t", "STRING")}, keep=["event_id"])


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE c_mktsegment END AS segment, TIMESTAMP '2024-02-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM customer")
def scd2_repeated_candidates(spark, sf):
    """Of repeated candidates the last counts, once."""
    c = table(spark, sf, "customer")
    none = c.filter("false").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.expr("TIMESTAMP '2024-01-01'").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    new = c.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(1).alias("seq"))
    twice = c.filter("c_custkey % 3 = 0")
    new = new.unionByName(twice.select("c_custkey", F.lit("a").alias("segment"), F.lit(2).alias("seq"))).unionByName(twice.select("c_custkey", F.lit("b").alias("segment"), F.lit(3).alias("seq")))
    return load.scd2(none, new, ["c_custkey"], ["segment"], F.expr("TIMESTAMP '2024-02-01'"), order=F.col("seq"))


def _mapper(spark, sf):
    """Orders as the grain, customers (left) and open nations (inner), two targets."""
    t = {n: table(spark, sf, n) for n in ("orders", "customer", "nation", "supplier")}
    orders = mapper.Source("o", ("orders",), where=F.col("o_orderstatus") != "P")
    customers = mapper.Source("c", ("customer",), ("c_custkey", "c_nationkey", "c_name"), where=F.col("c_acctbal") > 0)
    nations = mapper.Source("n", ("nation",), where=F.col("n_regionkey") < 3, dedupe=("n_nationkey",), static={"origin": "map"})
    joins = [(customers, mapper.Join("c", (("o.o_custkey", "c_custkey"),))), (nations, mapper.Join("n", (("c.c_nationkey", "n_nationkey"),), "inner"))]
    targets = [
        mapper.Target("order", {"id": lambda j: j["o.o_orderkey"], "nation": lambda j: j["n_name"], "origin": lambda j: j["n.origin"]}),
        mapper.Target("large", {"id": lambda j: j["o_orderkey"], "price": lambda j: F.when(j["o.o_totalprice"] > 100000, j["o.o_totalprice"])}, required=("price",)),
    ]
    return t, orders, joins, targets


_MAPPED = "orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3 WHERE o_orderstatus <> 'P'"


@register(f"SELECT o_orderkey AS id, n_name AS nation, 'map' AS origin FROM {_MAPPED}")
def mapper_targets(spark, sf):
    return mapper.run_mapper(*_mapper(spark, sf), ["o_orderkey"])["order"][0]


@register(f"SELECT 'order' AS target, count(*) AS written, 0::BIGINT AS failed FROM {_MAPPED} UNION ALL SELECT 'large', count(*) FILTER (WHERE o_totalprice > 100000), count(*) FILTER (WHERE o_totalprice <= 100000) FROM {_MAPPED}")
def mapper_stats(spark, sf):
    """Rows written and failed of each target of a mapper, in one pass."""
    return mapper.stats(*_mapper(spark, sf))


@register("SELECT k, coalesce(a, b) AS name, b AS other FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS a, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS b FROM customer)")
def first_across_sources(spark, sf):
    """A bare column is the first value of all joined sources that isn't null."""
    c = table(spark, sf, "customer")
    t = {"a": c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name")), "b": c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("name"))}
    target = mapper.Target("x", {"k": lambda j: j["a.k"], "name": lambda j: j["name"], "other": lambda j: j["b.name"]})
    return mapper.run_mapper(t, mapper.Source("a", ("a",)), [(mapper.Source("b", ("b",)), mapper.Join("b", (("a.k", "k"),)))], [target])["x"][0]


@register("SELECT e.event_id, g.name FROM events e LEFT JOIN (SELECT 'active' AS name, unnest(['view', 'click']) AS kind UNION ALL SELECT 'buyer', 'purchase') g ON g.kind = e.event_type")
def mapper_array_join(spark, sf):
    """A source joined on a column that holds a value or a JSON array of them."""
    groups = table(spark, sf, "events").agg(F.lit(1).alias("one")).select(F.explode(F.array(F.struct(F.lit("active").alias("name"), F.lit('["view","click"]').alias("kinds")), F.struct(F.lit("buyer").alias("name"), F.lit("purchase").alias("kinds")))).alias("g")).select("g.*")
    target = mapper.Target("x", {"event_id": lambda j: j["e.event_id"], "name": lambda j: j["g.name"]})
    join = mapper.Join("g", (("e.event_type", "kinds"),), holds="scalar_or_array")
    return mapper.run_mapper({"events": table(spark, sf, "events"), "groups": groups}, mapper.Source("e", ("events",)), [(mapper.Source("g", ("groups",)), join)], [target])["x"][0]


@register("SELECT event_type AS task, count(*) AS n FROM events e WHERE ts >= (SELECT max(ts) FROM events WHERE value > 90 AND event_type = e.event_type) GROUP BY 1")
def since_filter(spark, sf):
    """Events since their task's last success."""
    e = table(spark, sf, "events")
    log = e.select(F.col("event_type").alias("task"), F.col("ts").alias("started_at"), F.when(F.col("value") > 90, "success").otherwise("failed").alias("status"))
    rows = e.withColumn("task", F.col("event_type")).join(F.broadcast(load.since_marks(log)), "task").filter("ts >= since")
    return rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT user_id, max_by(value, struct_pack(a := ts, b := value)) AS last_value FROM events WHERE event_id % 7 <> 0 GROUP BY 1 UNION ALL SELECT user_id, NULL FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 7 <> 0) = 0")
def argmax_feature(spark, sf):
    """The value at the latest time; rows without a time don't count."""
    e = table(spark, sf, "events").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return features.argmax(e, ["user_id"], "value", "ts", "last_value")


@register("SELECT event_id, rank() OVER w AS place, round(lead(value, 2) OVER w, 6) AS ahead, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running, epoch_us(ts - lag(ts) OVER w) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def row_window_features(spark, sf):
    """Rank, lead by two, running sum, and a scalar over a window."""
    w = lambda fn, *a, **k: features.row_window(fn, ["ts", "event_id"], ["user_id"], *a, **k)
    gap = datetime_diff(w("lag", "ts"), F.col("ts"), "seconds")
    return table(spark, sf, "events").select("event_id", w("rank").cast("long").alias("place"), F.round(w("lead", "value", 2), 6).alias("ahead"), F.round(w("sum", "value"), 4).alias("running"), gap.alias("gap"))


@register("SELECT 'balance' AS feature_id, 2 AS version, CAST(0 AS INT) AS position, true AS active, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'n_orders', 1, 1, true, (SELECT count(DISTINCT o_custkey) FROM orders) UNION ALL SELECT 'spent', 1, NULL, false, (SELECT count(DISTINCT o_custkey) FROM orders)")
def feature_registry(spark, sf):
    """Versions after two runs, the second with one definition changed and one left out, beside the values stored."""
    t = {n: table(spark, sf, n) for n in ("customer", "orders")}
    none = features.long_values(spark, FEATURES, t, F.current_timestamp()).limit(0)
    first = features.run(spark, FEATURES, t, none, F.expr("TIMESTAMP '2024-01-01'"))
    changed = [features.Feature("balance", "customer", "c_custkey", "c_acctbal * 2"), FEATURES[1]]
    second = features.run(spark, changed, t, first.values, F.expr("TIMESTAMP '2024-01-02'"), first.registry)
    return second.registry.join(features.null_rates(second.values), "feature_id").select("feature_id", "version", "position", "active", "n")


PLAN = [
    features.Feature("score", "customer", "c_custkey", "mean_order * CASE WHEN rich THEN 2 ELSE 1 END", needs=("mean_order", "rich")),
    features.Feature("mean_order", "customer", "c_custkey", "spent / n_orders", needs=("spent", "n_orders")),
    features.Feature("rich", "customer", "c_custkey", "c_acctbal > 5000", kind="boolean", mode="dynamic"),
    features.Feature("spent", "orders", "o_custkey", "sum(CAST(o_totalprice AS DECIMAL(20, 2)))", aggregate=True),
    features.Feature("n_orders", "orders", "o_custkey", "count(1)", aggregate=True, kind="long", ttl_seconds=3600),
    features.Feature("visits", "events", "user_id", "count(1)", aggregate=True, kind="long"),
]


@register(
    """WITH o AS (SELECT o_custkey AS k, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS spent FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, count(*) AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS late FROM events GROUP BY 1),
m AS (SELECT c_custkey AS k, 100.0 / n AS mean, c_acctbal > 5000 AS rich FROM customer LEFT JOIN o ON o.k = c_custkey)
SELECT 'n_orders' AS feature_id, CAST(k AS VARCHAR) AS entity_id, n::DOUBLE AS value FROM o
UNION ALL SELECT 'spent', CAST(k AS VARCHAR), 100 FROM o
UNION ALL SELECT 'visits', CAST(k AS VARCHAR), CASE WHEN late > 0 THEN n ELSE -1 END FROM e
UNION ALL SELECT 'mean_order', CAST(k AS VARCHAR), round(mean, 6) FROM m
UNION ALL SELECT 'score', CAST(k AS VARCHAR), round(mean * CASE WHEN rich THEN 2 ELSE 1 END, 6) FROM m"""
)
def feature_plan(spark, sf):
    """A run with a feature on features, one dynamic, one fresh (its stored 100 stays), one expired, and one whose changed entities alone are computed (the others keep their -1)."""
    t = {n: table(spark, sf, n) for n in ("customer", "orders", "events")}
    stored = lambda name, key, of, value, at: of.select(F.lit(name).alias("feature_id"), F.col(key).cast("string").alias("entity_id"), F.lit(value).alias("value"), F.expr(f"TIMESTAMP '{at}'").alias("computed_at")).distinct()
    before = stored("spent", "o_custkey", t["orders"], "100.0", "2024-01-31 12:00:00").unionByName(stored("n_orders", "o_custkey", t["orders"], "-1", "2024-01-31 12:00:00")).unionByName(stored("visits", "user_id", t["events"], "-1", "2024-01-20 00:00:00"))
    registry = features.register(spark, [f for f in PLAN if f.id in ("spent", "n_orders", "visits")])
    out = features.run(spark, PLAN, t, before, F.expr("TIMESTAMP '2024-02-01'"), registry, since={"events": ("ts", "2024-01-20")})
    return out.values.select("feature_id", "entity_id", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CAST(count(o_orderkey) AS DOUBLE) AS value FROM customer c, orders o WHERE c_custkey = o_custkey AND o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND c_mktsegment <> 'from orders' GROUP BY 1")
def raw_sql_scope(spark, sf):
    """A feature in SQL with a join by comma, a WITH, a subquery and a table's name inside text; a view of the session by that name isn't meant."""
    t = {n: table(spark, sf, n) for n in ("customer", "orders")}
    t["orders"].limit(0).createOrReplaceTempView("orders")
    sql = "WITH dear AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT c_custkey AS entity_id, count(1) AS value FROM customer c, dear o WHERE c_custkey = o_custkey AND c_mktsegment <> 'from orders' GROUP BY c_custkey"
    try:
        return features.evaluate(spark, features.Feature("dear_orders", "customer", "c_custkey", sql=sql), t)
    finally:
        spark.catalog.dropTempView("orders")


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 1000 <> 8 UNION ALL SELECT -o_orderkey, 'N', NULL FROM orders WHERE o_orderkey % 1000 = 9")
def versioned_upsert(spark, sf):
    """A table in key buckets after two upserts and a prune, each of which writes the buckets that it touches."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    t = VersionedTable.create(o.select("o_orderkey", "status"), scratch(spark), ["o_orderkey"], buckets=32)
    some = o.filter("o_orderkey % 1000 = 7")
    batch = some.withColumn("status", F.lit("X")).withColumn("seq", F.lit(2)).unionByName(some.withColumn("status", F.lit("early")).withColumn("seq", F.lit(1)))
    t.upsert(batch, F.col("seq"))
    t.upsert(o.filter("o_orderkey % 1000 = 9").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("status"), F.lit(1).alias("seq")), F.col("seq"))
    t.prune(t.read().filter("o_orderkey % 1000 <> 8"))
    return t.read().select("o_orderkey", "status", "price")


@register(
    "SELECT c_custkey, c_mktsegment AS segment, TIMESTAMP '2024-01-01' AS valid_from, CASE WHEN c_custkey % 50 = 3 THEN TIMESTAMP '2024-02-01' END AS valid_to FROM customer "
    "UNION ALL SELECT c_custkey, 'moved', TIMESTAMP '2024-02-01', CASE WHEN c_custkey % 100 = 3 THEN TIMESTAMP '2024-03-01' END FROM customer WHERE c_custkey % 50 = 3 "
    "UNION ALL SELECT c_custkey, 'back', TIMESTAMP '2024-03-01', NULL FROM customer WHERE c_custkey % 100 = 3"
)
def versioned_history(spark, sf):
    """A history in key buckets after three loads."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    none = c.limit(0).withColumns({"valid_from": F.lit(None).cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
    t = VersionedTable.create(none, scratch(spark), ["c_custkey"], buckets=32)
    for at, batch in (("2024-01-01", c), ("2024-02-01", c.filter("c_custkey % 50 = 3").withColumn("segment", F.lit("moved"))), ("2024-03-01", c.filter("c_custkey % 100 = 3").withColumn("segment", F.lit("back")))):
        t.load_history(batch, ["segment"], F.expr(f"TIMESTAMP '{at}'"))
    return t.read()


@register("SELECT 'orders' AS \"table\", true AS present, (SELECT count(*) FROM orders) AS n_rows UNION ALL SELECT 'part', true, (SELECT count(*) FROM part) UNION ALL SELECT 'gone', false, NULL")
def table_presence(spark, sf):
    return tables.table_stats({"orders": table(spark, sf, "orders"), "part": table(spark, sf, "part"), "gone": None})


@register("SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def active_human_users(spark, sf):
    c = table(spark, sf, "customer")
    return ingest.active_humans(c, F.when(F.col("c_custkey") % 3 == 0, "human").when(F.col("c_custkey") % 3 == 1, "bot"), F.col("c_custkey") % 2 == 0).select("c_custkey")


@register("SELECT event_id, CAST(event_id AS BIGINT) AS whole, value AS number, event_type AS word FROM events")
def inferred_types(spark, sf):
    """Types found in columns of text."""
    e = table(spark, sf, "events")
    text = e.select("event_id", F.col("event_id").cast("string").alias("whole"), F.col("value").cast("string").alias("number"), F.col("event_type").alias("word"))
    return ingest.infer_types(text)


@register("SELECT event_id, event_id AS whole, value AS number, lpad(CAST(event_id AS VARCHAR), 9, '0') AS code, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS flag, CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS mixed, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_value_types(spark, sf):
    """Types by the JSON values: text that looks like a number stays text, mixed kinds are text."""
    e = table(spark, sf, "events")
    inner = F.struct(F.col("event_id").alias("whole"), F.col("value").alias("number"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("code"), (F.col("event_id") % 2 == 0).alias("flag"))
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    records = e.select("event_id", F.concat(F.lit('{"a": '), F.to_json(inner), F.lit(', "mixed": '), mixed, F.lit("}")).alias("record"))
    paths = {"whole": "a.whole", "number": "a.number", "code": "a.code", "flag": "a.flag", "mixed": "mixed", "missing": "a.none"}
    return ingest.project_typed(records, paths, ingest.json_types(records, paths), keep=["event_id"])


@register("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) ELSE value END AS size, CASE WHEN event_id % 2 = 1 THEN event_type END AS kind FROM events")
def widened_batches(spark, sf):
    """Whole numbers that a later batch widens, which brings a new column too."""
    e = table(spark, sf, "events")
    first = e.filter("event_id % 2 = 0").select(F.to_json(F.struct("event_id", F.col("user_id").alias("size"))).alias("record"))
    second = e.filter("event_id % 2 = 1").select(F.to_json(F.struct("event_id", F.col("value").alias("size"), F.col("event_type").alias("kind"))).alias("record"))
    out = ingest.append_typed(None, first, {"event_id": "event_id", "size": "size"})
    return ingest.append_typed(out, second, {"event_id": "event_id", "size": "size", "kind": "kind"})


@register("SELECT e.event_id, g.name FROM events e LEFT JOIN (SELECT 'even lookers' AS name, 0 AS parity, unnest(['view', 'click']) AS kind UNION ALL SELECT 'odd buyers', 1, 'purchase' UNION ALL SELECT 'odd lookers', 1, 'view') g ON g.kind = e.event_type AND g.parity = e.user_id % 2")
def mapper_conditions(spark, sf):
    """A join on two conditions: equality, and a prefixed value in the array at a path of a JSON column."""
    e = table(spark, sf, "events").withColumn("parity", F.col("user_id") % 2)
    rules = [("even lookers", 0, '{"x": {"kinds": ["k:view", "k:click"]}}'), ("odd buyers", 1, '{"x": {"kinds": ["k:purchase"]}}'), ("odd lookers", 1, '{"x": {"kinds": ["k:view", "view"]}}'), ("none", 0, None)]
    some = e.agg(F.lit(1)).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("parity"), F.lit(d).cast("string").alias("rule")) for n, p, d in rules])))
    join = mapper.Join("g", (("e.parity", "parity"), mapper.On("e.event_type", "rule", "json_array", prefix="k:", path="$.x.kinds")))
    target = mapper.Target("x", {"event_id": lambda j: j["e.event_id"], "name": lambda j: j["g.name"]})
    return mapper.run_mapper({"e": e, "g": some}, mapper.Source("e", ("e",)), [(mapper.Source("g", ("g",)), join)], [target])["x"][0]


@register("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN s_suppkey IS NOT NULL AND s_suppkey % 5 <> 0 THEN s_name END) AS name, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey NOT IN (SELECT c_custkey FROM customer)")
def mapper_row_groups(spark, sf):
    """A target of two row groups, each with joins and columns of its own, merged by key."""
    t = {n: table(spark, sf, n) for n in ("customer", "nation", "supplier")}
    nations = (mapper.Source("n", ("nation",)), mapper.Join("n", (("c.c_nationkey", "n_nationkey"),)))
    first = mapper.Rows(mapper.Source("c", ("customer",)), {"id": lambda j: j["c.c_custkey"], "name": lambda j: F.when(j["c.c_custkey"] % 3 == 0, j["c.c_name"]), "nation": lambda j: j["n.n_name"]}, (nations,))
    second = mapper.Rows(mapper.Source("s", ("supplier",)), {"id": lambda j: F.when(j["s.s_suppkey"] % 5 != 0, j["s.s_suppkey"]), "name": lambda j: j["s.s_name"]})
    target = mapper.Target("party", {}, required=("id",), rows=(first, second), key=("id",))
    return mapper.run_mapper(t, mapper.Source("c", ("customer",)), [], [target])["party"][0]


@register("SELECT c_custkey, CASE WHEN c_custkey % 600 = 1 THEN 'created' WHEN c_custkey % 500 = 1 THEN 'deleted' ELSE 'updated' END AS change FROM customer WHERE (c_custkey % 600 = 1 AND c_custkey % 500 <> 1) OR (c_custkey % 500 = 1 AND c_custkey % 600 <> 1) OR (c_custkey % 700 = 0 AND c_custkey % 500 <> 1 AND c_custkey % 600 <> 1)")
def diff_by_digests(spark, sf):
    """Snapshots with few differences: only the buckets whose digests differ are joined."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    new = c.filter("c_custkey % 500 <> 1").withColumn("c_name", F.when(F.col("c_custkey") % 700 == 0, "renamed").otherwise(F.col("c_name")))
    return tables.digest_diff(c.filter("c_custkey % 600 <> 1"), new, ["c_custkey"], ["c_name"])


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'updated' WHEN o_orderkey % 1000 = 8 THEN 'deleted' END AS change FROM orders WHERE o_orderkey % 1000 IN (7, 8) UNION ALL SELECT -o_orderkey, 'created' FROM orders WHERE o_orderkey % 1000 = 9")
def diff_of_versions(spark, sf):
    """What an upsert and a prune have changed in a table in key buckets."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    t = VersionedTable.create(o, scratch(spark), ["o_orderkey"], buckets=64)
    new = o.filter("o_orderkey % 1000 = 9").select((-F.col("o_orderkey")).alias("o_orderkey"), "status")
    t.upsert(o.filter("o_orderkey % 1000 = 7").withColumn("status", F.lit("X")).unionByName(new), F.lit(0))
    last = t.prune(t.read().filter("o_orderkey % 1000 <> 8 or o_orderkey < 0"))
    return t.diff(1, last)
