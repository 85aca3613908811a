"""Questions over the entity graph: details, aggregates, windows, ranks, views."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as fn
from ..operators import feed as feeds
from ..operators import joins, search, tables, views
from ..plans import query as q
from ..plans.model import Entity, Model, Relation
from ..plans.query import child, measure
from ..plans.ranks import Ranked
from .base import USER_STATES, activity, registrar, sales, scratch, table, user_states

QUERIES: dict = {}
ORACLE_SQL: dict = {}
register = registrar(QUERIES, ORACLE_SQL)
GRAPH = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
YM = "strftime(o_orderdate, '%G-%m')"


@register(f"SELECT coalesce(r.r_name, '(unset)') AS region, {YM} AS month, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM {GRAPH} GROUP BY 1, 2")
def monthly_revenue_by_region(spark, sf):
    m = sales(spark, sf)
    out = q.aggregate(m, "Order", {"region": "Customer.Nation.Region.r_name", "month": lambda r: fn.format_time(r["o_orderdate"], "YYYY-MM")}, {"revenue": measure("sum", "o_totalprice"), "orders": measure("count")})
    return out.withColumn("revenue", F.round("revenue", 2))


@register("SELECT o_orderkey, o_totalprice AS price, coalesce(c_name, '(unset)') AS customer, coalesce(n_name, '(unset)') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")
def detail_orders(spark, sf):
    return q.detail(sales(spark, sf), "Order", {"o_orderkey": "o_orderkey", "price": "o_totalprice", "customer": "by_customer.c_name", "nation": "by_customer.of_nation.n_name"}, [lambda r: r["o_totalprice"] > 100000, lambda r: r["o_orderstatus"].isin("F", "O")])


@register("SELECT l_orderkey, l_linenumber, l_quantity, coalesce(r_name, '(unset)') AS region FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_quantity >= 49")
def shortest_path_detail(spark, sf):
    """Line to Region without naming the hops between; the way by the supplier is the shortest."""
    return q.detail(sales(spark, sf), "Line", {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "l_quantity": "l_quantity", "region": "Region.r_name"}, [lambda r: r["l_quantity"] >= 49])


@register("SELECT coalesce(cn.n_name, '(unset)') AS customer_nation, coalesce(sn.n_name, '(unset)') AS supplier_nation, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY 1, 2")
def two_roles_of_nation(spark, sf):
    out = q.aggregate(sales(spark, sf), "Line", {"customer_nation": "of_order.by_customer.of_nation.n_name", "supplier_nation": "by_supplier.of_nation.n_name"}, {"lines": measure("count"), "revenue": measure("sum", lambda r: r["l_extendedprice"] * (1 - r["l_discount"]))})
    return out.withColumn("revenue", F.round("revenue", 4))


@register("SELECT o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def six_measures(spark, sf):
    f = lambda k: measure(k, "o_totalprice")
    out = q.aggregate(sales(spark, sf), "Order", {"priority": "o_orderpriority"}, {"n": measure("count"), "customers": measure("count_distinct", "o_custkey"), "total": f("sum"), "mean": f("avg"), "low": f("min"), "high": f("max")})
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@register("SELECT count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem")
def global_aggregate(spark, sf):
    return q.aggregate(sales(spark, sf), "Line", {}, {"n": measure("count"), "quantity": measure("sum", "l_quantity")}).withColumn("quantity", F.round("quantity", 2))


@register("SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 8) AS discount_rate, CAST(count(l_tax) AS DOUBLE) / nullif(count(*), 0) AS taxed FROM lineitem GROUP BY 1, 2")
def ratio_measures(spark, sf):
    out = q.aggregate(sales(spark, sf), "Line", {"flag": "l_returnflag", "status": "l_linestatus"}, {"discount_rate": measure("sum", lambda r: r["l_extendedprice"] * r["l_discount"]) / measure("sum", "l_extendedprice"), "taxed": measure("count", "l_tax") / measure("count")})
    return out.withColumn("discount_rate", F.round("discount_rate", 8))


@register("SELECT coalesce(n_name, '(unset)') AS nation, count(*) AS customers, CAST(sum(coalesce(k.n, 0)) AS BIGINT) AS orders, round(sum(coalesce(k.total, 0)), 2) AS spent, CAST(sum(coalesce(k.lines, 0)) AS BIGINT) AS lines FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS n, sum(o_totalprice) AS total, sum(coalesce(l.n, 0)) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(l_orderkey) AS n FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey GROUP BY 1) k ON k.o_custkey = c_custkey GROUP BY 1")
def child_measures(spark, sf):
    """Three measures over one-to-many hops, two of them sharing a hop, without fan-out."""
    out = q.aggregate(sales(spark, sf), "Customer", {"nation": "Nation.n_name"}, {"customers": measure("count"), "orders": child("orders.o_orderkey"), "spent": child("orders.o_totalprice", "sum"), "lines": child("orders.lines.l_orderkey")})
    return out.withColumn("spent", F.round("spent", 2))


@register("SELECT o_orderpriority AS priority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS filled, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open FROM orders GROUP BY 1")
def conditional_sums(spark, sf):
    case = lambda s, other: lambda r: F.when(r["o_orderstatus"] == s, r["o_totalprice"]).otherwise(other)
    out = q.aggregate(sales(spark, sf), "Order", {"priority": "o_orderpriority"}, {"filled": measure("sum", case("F", None)), "open": measure("sum", case("O", 0.0))})
    return out.withColumns({"filled": F.round("filled", 2), "open": F.round("open", 2)})


@register("SELECT user_id, max(value) AS last_value FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WHERE ts IS NOT NULL) WHERE k = 1 GROUP BY 1")
def argmax_value(spark, sf):
    return table(spark, sf, "events").filter("ts is not null").groupBy("user_id").agg(F.max(F.struct("ts", "value"))["value"].alias("last_value"))


@register("SELECT coalesce(n_name, '(unset)') AS nation, n_regionkey AS nation_region, c_mktsegment AS segment, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3")
def extra_attributes(spark, sf):
    return q.aggregate(sales(spark, sf), "Customer", {"nation": "Nation.n_name", "segment": "c_mktsegment"}, {"n": measure("count")}, attributes={"nation_region": "Nation.n_regionkey"})


@register("SELECT o_orderpriority AS priority, count(*) AS n, CASE WHEN count(*) >= 3100 THEN 'many' WHEN count(*) >= 2900 THEN 'usual' WHEN count(*) >= 0 THEN 'few' END AS n_status FROM orders GROUP BY 1")
def threshold_labels(spark, sf):
    return q.aggregate(sales(spark, sf), "Order", {"priority": "o_orderpriority"}, {"n": measure("count")}, thresholds={"n": [(">=", 3100, "many"), (">=", 2900, "usual"), (">=", 0, "few")]})


@register("SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN c_name ELSE s_name END, '(unset)') AS subject FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN supplier ON user_id = s_suppkey")
def dynamic_relation(spark, sf):
    """The subject's name, of a customer or a supplier by the event's type."""
    return q.detail(activity(spark, sf), "Event", {"event_id": "event_id", "subject": "subject.name"})


@register(f"SELECT e.event_id, s.state FROM events e LEFT JOIN {USER_STATES} s ON s.user_id = e.user_id AND s.valid_to IS NULL")
def current_state_join(spark, sf):
    e, s = table(spark, sf, "events"), user_states(spark, sf).drop("event_id")
    m = Model.of((Entity("Event", "event_id", (Relation("state", "State", ("user_id",)),)), e), (Entity("State", "user_id", history=("valid_from", "valid_to")), s))
    return q.detail(m, "Event", {"event_id": "event_id", "state": lambda r: r["state.state"]})


@register(f"SELECT p.event_id, s.state FROM (SELECT event_id, user_id, ts + INTERVAL 1 HOUR AS at FROM events WHERE event_type = 'purchase') p LEFT JOIN {USER_STATES} s ON s.user_id = p.user_id AND s.valid_from <= p.at AND (s.valid_to IS NULL OR s.valid_to > p.at)")
def as_of_join(spark, sf):
    """Each buyer's state an hour after the purchase."""
    p = table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("buyer"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return joins.as_of(p, user_states(spark, sf).drop("event_id"), [("buyer", "user_id")], "at").select("event_id", "state")


DAILY = "(SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, sum(value) AS total, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1, 2)"


def daily(spark, sf):
    m = Model.of((Entity("Event", "event_id", timestamps=("ts",)), table(spark, sf, "events")))
    return q.aggregate(m, "Event", {"event_type": "event_type", "day": lambda r: fn.format_date(r["ts"], "yyyy-MM-dd")}, {"total": measure("sum", "value"), "n": measure("count", "value"), "mean": measure("avg", "value")})


@register(f"SELECT event_type, day, round(avg(mean) OVER w, 6) AS simple, round(sum(total) OVER w / nullif(sum(n) OVER w, 0), 6) AS weighted, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS so_far, lag(n, 2) OVER (PARTITION BY event_type ORDER BY day) AS before, lead(n, 1) OVER (PARTITION BY event_type ORDER BY day) AS after FROM {DAILY} WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS 6 PRECEDING)")
def rolling_windows(spark, sf):
    order, partition = q.window_keys(["event_type", "day"], "day", {"day": "day"})
    d = daily(spark, sf)
    d = q.windowed(d, "simple", "mean", "simple", order, partition, "avg", frame=7)
    d = q.windowed(d, "weighted", "total", "weighted", order, partition, "avg", frame=7, weight="n")
    d = q.windowed(d, "so_far", "n", "cumulative", order, partition, "count")
    d = q.windowed(d, "before", "n", "lag", order, partition, offset=2)
    d = q.windowed(d, "after", "n", "lead", order, partition, offset=1)
    return d.select("event_type", "day", F.round("simple", 6).alias("simple"), F.round("weighted", 6).alias("weighted"), "so_far", "before", "after")


@register("SELECT o_orderpriority AS priority, o_orderstatus AS status, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus ROWS 1 PRECEDING) AS BIGINT) AS two, round(sum(o_totalprice) / count(*), 4) AS mean FROM orders GROUP BY 1, 2")
def row_unit_window(spark, sf):
    """A window in rows over the last slice, with a ratio that isn't windowed."""
    a = q.aggregate(sales(spark, sf), "Order", {"priority": "o_orderpriority", "status": "o_orderstatus"}, {"n": measure("count"), "mean": measure("sum", "o_totalprice") / measure("count")})
    order, partition = q.window_keys(["priority", "status"], "rows", {})
    return q.windowed(a, "two", "n", "simple", order, partition, "sum", frame=2).withColumn("mean", F.round("mean", 4))


@register("SELECT event_id, round(epoch_us(ts - lag(ts) OVER w) / 3.6e9, 6) AS hours_since, row_number() OVER w AS nth, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def row_windows(spark, sf):
    """Scalar over lag, rank and a running sum per user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select("event_id", F.round(fn.datetime_diff(F.lag("ts").over(w), F.col("ts"), "hours"), 6).alias("hours_since"), F.row_number().over(w).cast("long").alias("nth"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@register("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_version(spark, sf):
    return tables.latest(table(spark, sf, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@register("SELECT e.user_id, count(*) FILTER (WHERE event_type = 'error' AND (last IS NULL OR ts > last)) AS failures FROM events e JOIN (SELECT user_id, max(ts) FILTER (WHERE event_type = 'purchase') AS last FROM events GROUP BY 1) l ON e.user_id = l.user_id GROUP BY 1")
def failures_since_success(spark, sf):
    return tables.failures_since_success(table(spark, sf, "events"), ["user_id"], F.col("event_type") == "error", F.col("event_type") == "purchase", "ts")


@register("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def noop_versions_dropped(spark, sf):
    return tables.drop_noop_versions(table(spark, sf, "events"), ["user_id"], "event_id", ["event_type"]).select("user_id", "event_id", "event_type")


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 100")
def second_page(spark, sf):
    rows, _ = q.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 2, 100, ["o_totalprice desc", "o_orderkey"])
    return rows


@register("SELECT count(*) AS total, count(*) > 200 AS truncated FROM orders")
def page_total(spark, sf):
    return q.page(table(spark, sf, "orders"), 2, 100, ["o_orderkey"])[1]


@register("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_n(spark, sf):
    """A top-k report."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return c.orderBy(*[q.order_key(o) for o in q.positional_order({"c_custkey": "2", "c_acctbal": "1, desc"})]).limit(10)


ITEMS = "(SELECT event_id AS id, event_type AS dataset_ref, value AS significance_score, ts AS published_at FROM events)"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@register(f"WITH pool AS (SELECT * FROM {ITEMS} ORDER BY published_at DESC, id LIMIT 100), s AS (SELECT *, significance_score / (1 + greatest(epoch_us({NOW} - published_at) / 3.6e9, 0) / 72) AS base FROM pool), e AS (SELECT *, base * pow(0.5, row_number() OVER (PARTITION BY dataset_ref ORDER BY base DESC, id) - 1) AS effective FROM s), p AS (SELECT *, row_number() OVER (ORDER BY effective DESC, id) AS position FROM e) SELECT id, dataset_ref, position FROM p WHERE position <= 20")
def ranked_feed(spark, sf):
    items = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("dataset_ref"), F.col("value").alias("significance_score"), F.col("ts").alias("published_at"))
    return feeds.feed(items, F.expr(NOW)).select("id", "dataset_ref", F.col("position").cast("long").alias("position"))


@register("SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase FROM events GROUP BY 1")
def engagement_counts(spark, sf):
    return feeds.engagement(table(spark, sf, "events"), "user_id", "event_type", "user_id", ["view", "click", "purchase"])


@register("SELECT v.vec_id, round(1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 9) + 0.0 AS distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.label IN (0, 1, 2, 3) ORDER BY 2, 1 LIMIT 20")
def nearest_artifacts(spark, sf):
    """A top-k report: the 20 nearest vectors of four kinds to vector 0."""
    v = table(spark, sf, "embeddings")
    query = v.filter("vec_id = 0").first().embedding
    return search.find(v, query, 20, "vec_id", kinds=("label", [0, 1, 2, 3])).select("vec_id", (F.round("distance", 9) + 0.0).alias("distance"))


@register("SELECT day, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'error' THEN n END) AS error, max(CASE WHEN event_type = 'purchase' THEN n END) AS purchase, max(CASE WHEN event_type = 'signup' THEN n END) AS signup, max(CASE WHEN event_type = 'view' THEN n END) AS view FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def pivot_view(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return views.pivot(n, "day", "event_type", "n", ["click", "error", "purchase", "signup", "view"])


@register("WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT max(day) AS day FROM d) SELECT series, row_number() OVER (ORDER BY v DESC NULLS LAST, series) AS position FROM (SELECT event_type AS series, max(CASE WHEN d.day = l.day THEN n END) AS v FROM d, l GROUP BY 1)")
def series_order_view(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return views.series_order(n, "day", "event_type", "n").withColumn("position", F.col("position").cast("long"))


@register("SELECT day, event_type, round(n / sum(n) OVER (PARTITION BY day), 9) AS share FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def percent_stack_view(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return views.percent_stack(n, "day", "n").select("day", "event_type", F.round("share", 9).alias("share"))


@register("WITH d AS (SELECT user_id % 50 AS team, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'error'), days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d), g AS (SELECT DISTINCT team FROM d) SELECT g.team, strftime(days.day, '%Y-%m-%d') AS day, round(coalesce(sum(value), 0), 4) AS value FROM g CROSS JOIN days LEFT JOIN d ON d.team = g.team AND d.day = days.day GROUP BY 1, 2")
def calendar_view(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'").select((F.col("user_id") % 50).alias("team"), F.col("ts").cast("date").alias("day"), "value")
    return views.calendar(e, "team", "day", "value").withColumns({"value": F.round("value", 4), "day": F.col("day").cast("string")})


@register("WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM d), a AS (SELECT event_type, max(v) FILTER (WHERE r = 1) AS l, max(v) FILTER (WHERE r = 2) AS p, avg(v) FILTER (WHERE r > 1) AS mu, stddev_pop(v) FILTER (WHERE r > 1) AS s FROM k GROUP BY 1) SELECT event_type, round(greatest(least(CASE WHEN s > 0 THEN abs(l - mu) / s ELSE 0 END * 10 / 3, 10), least(abs(l - p) / p * 10, 10)), 4) AS significance FROM a")
def significance_series(spark, sf):
    n = table(spark, sf, "events").groupBy("event_type", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return views.significance(n, ["event_type"], "v", "day")


@register("WITH d AS (SELECT user_id, value FROM events WHERE value IS NOT NULL), z AS (SELECT user_id, value, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS s FROM d WINDOW w AS (PARTITION BY user_id)) SELECT user_id, CASE WHEN count(*) < 2 THEN 0 ELSE round(least(coalesce(max(abs(value - mu) / nullif(s, 0)), 0) * 10 / 3, 10), 4) END AS significance FROM z GROUP BY 1")
def significance_unordered(spark, sf):
    return views.significance(table(spark, sf, "events"), ["user_id"], "value")


@register("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS n_orders FROM customer WHERE c_custkey = 7")
def one_record(spark, sf):
    return tables.record_with_counts(table(spark, sf, "customer"), "c_custkey", 7, {"orders": (table(spark, sf, "orders"), "o_custkey")}).select("c_custkey", "c_name", "n_orders")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def related_rows(spark, sf):
    poor = table(spark, sf, "customer").filter("c_acctbal < 0")
    return joins.related(poor, table(spark, sf, "orders"), "c_custkey", "o_custkey").select("o_orderkey", "o_custkey")


@register("SELECT event_id FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-25 00:00:00'")
def relative_time_and_params(spark, sf):
    """A parameter with a default, an optional one that is absent, and now() - 7d at a fixed now."""
    m = Model.of((Entity("Event", "event_id", timestamps=("ts",)), table(spark, sf, "events")))
    now = F.expr(NOW)
    given = [("kind", lambda v: lambda r: r["event_type"] == v), ("least", lambda v: lambda r: r["value"] >= v), ("back", lambda v: lambda r: r["ts"] >= fn.relative(now, -v, "d"))]
    return q.detail(m, "Event", {"event_id": "event_id"}, q.apply_params(given, {"kind": "view", "back": 7}, {"least": ""}))


@register("SELECT p_partkey FROM part WHERE (p_brand LIKE 'Brand#1%' OR NOT (p_size > 10)) AND p_type IS NOT NULL AND (p_retailprice - 100) / nullif(p_size - p_size, 0) IS NULL AND p_name NOT IN ('x')")
def nested_predicates(spark, sf):
    m = sales(spark, sf)
    return q.detail(m, "Part", {"p_partkey": "p_partkey"}, [lambda r: r["p_brand"].startswith("Brand#1") | ~(r["p_size"] > 10), lambda r: r["p_type"].isNotNull(), lambda r: F.try_divide(r["p_retailprice"] - 100, r["p_size"] - r["p_size"]).isNull(), lambda r: ~r["p_name"].isin("x")])


@register("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE CASE WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END END AS size, round(-o_totalprice / 7 + 1, 6) AS figure FROM orders")
def case_and_arithmetic(spark, sf):
    size = lambda r: F.when(r["o_totalprice"] > 200000, "large").otherwise(F.when(r["o_totalprice"] > 50000, "medium").otherwise("small"))
    return q.detail(sales(spark, sf), "Order", {"o_orderkey": "o_orderkey", "size": size, "figure": lambda r: F.round(-r["o_totalprice"] / 7 + 1, 6)})


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE '%1' AND s_acctbal > 0 AND s_nationkey IN (1, 2, 3, 4, 5)")
def text_predicates(spark, sf):
    return q.detail(sales(spark, sf), "Supplier", {"s_suppkey": "s_suppkey", "s_name": "s_name"}, [lambda r: r["s_name"].endswith("1"), "s_acctbal > 0", lambda r: r["s_nationkey"].isin(1, 2, 3, 4, 5)])


@register("SELECT coalesce(r_name, '(unset)') AS region, date_trunc('quarter', o_orderdate) AS quarter, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def quarter_slices(spark, sf):
    return q.aggregate(sales(spark, sf), "Order", {"region": "Region.r_name", "quarter": lambda r: fn.bucket(r["o_orderdate"], "quarter")}, {"n": measure("count")})


COSINE = "1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@register(f"WITH d AS (SELECT q.vec_id AS query_id, v.vec_id, {COSINE} AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS position FROM d) SELECT query_id, vec_id, round(distance, 9) + 0.0 AS distance FROM r WHERE position <= 5")
def nearest_of_each(spark, sf):
    """The five nearest other vectors of each vector whose id is divisible by 100, against all rows."""
    v = table(spark, sf, "embeddings")
    return search.find_each(v, v.filter("vec_id % 100 = 0"), 5, "vec_id").select("query_id", "vec_id", (F.round("distance", 9) + 0.0).alias("distance"))


def _few_nations(spark, sf):
    """Orders whose customers' nations are partly unknown."""
    m = sales(spark, sf)
    return Model(m.entities, {**m.tables, "Nation": m.tables["Nation"].filter("n_nationkey % 2 = 0")})


@register("SELECT o_orderkey, '(unset)' AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 WHERE n_name IS NULL")
def unset_filter(spark, sf):
    """A filter finds the rows whose traversed value is '(unset)'."""
    return q.detail(_few_nations(spark, sf), "Order", {"o_orderkey": "o_orderkey", "nation": "Customer.Nation.n_name"}, [lambda r: r.label("Customer.Nation.n_name") == q.UNSET])


@register(f"SELECT strftime(e.ts, '%G-%m-%d') AS day, coalesce(s.state, '(unset)') AS state, count(*) AS n FROM events e LEFT JOIN {USER_STATES} s ON e.user_id = s.user_id AND s.valid_from <= e.ts AND (s.valid_to IS NULL OR s.valid_to > e.ts) GROUP BY 1, 2")
def as_of_first_time_slice(spark, sf):
    """A related history is read as of the first time slice."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts")
    states = user_states(spark, sf).select("user_id", "state", "valid_from", "valid_to")
    m = Model.of((Entity("Event", "event_id", (Relation("of_user", "User", ("user_id",)),), timestamps=("ts",)), events), (Entity("User", "user_id", history=("valid_from", "valid_to")), states))
    return q.aggregate(m, "Event", {"day": q.TimeSlice("ts", "YYYY-MM-DD"), "state": "of_user.state"}, {"n": measure("count")})


@register("SELECT c_mktsegment AS segment, CAST(sum(coalesce(n, 0)) AS BIGINT) AS visits, CAST(sum(coalesce(k, 0)) AS BIGINT) AS orders FROM customer LEFT JOIN (SELECT user_id, count(event_id) AS n FROM events GROUP BY 1) ON user_id = c_custkey LEFT JOIN (SELECT o_custkey, count(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def event_subtable(spark, sf):
    """Measures over an event table of an entity, and of a bare field that one child has."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    m = sales(spark, sf).with_event("Customer", "visit", "user_id", e, ("ts",))
    return q.aggregate(m, "Customer", {"segment": "c_mktsegment"}, {"visits": child("visit.event_id"), "orders": measure("count", "o_orderkey")})


@register("SELECT c_custkey, n_name FROM (SELECT c_custkey, coalesce(n_name, '(unset)') AS n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey) ORDER BY c_custkey LIMIT 50 OFFSET 50")
def enveloped_page(spark, sf):
    """A page whose columns have lost their prefixes."""
    df = q.detail(sales(spark, sf), "Customer", {"Customer.c_custkey": "c_custkey", "Nation.n_name": "Nation.n_name"})
    return q.envelope(df, 2, 50, ["Customer.c_custkey"]).rows


@register("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN printf('%.1f%%', round(value) * 100.0) END AS share_display, CASE WHEN event_id % 5 <> 0 THEN printf('%.0f', round(value)) END AS plain_display, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN abs(round(value)) * 1000 >= 1000000 THEN printf('%.0fM', round(value) / 1000) WHEN abs(round(value)) >= 1 THEN printf('%.0fk', round(value)) ELSE '0' END END AS short_display FROM events")
def view_with_formats(spark, sf):
    """A view's declared columns and formats; null shows as null."""
    x = F.when(F.col("event_id") % 5 != 0, F.round("value"))
    df = table(spark, sf, "events").select("event_id", x.alias("share"), x.alias("plain"), (x * 1000).alias("short"), F.lit(1).alias("other"))
    out = views.execute_view(df, ["event_id", "share", "plain", "short"], {"share": "percent", "short": "0a"}, {"plain": "0"})
    return out.select("event_id", "share_display", "plain_display", "short_display")


@register("WITH d AS (SELECT user_id, value, CAST(event_id % 97 AS DOUBLE) AS other FROM events), z AS (SELECT user_id, abs(value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS a, abs(other - avg(other) OVER w) / nullif(stddev_pop(other) OVER w, 0) AS b FROM d WINDOW w AS (PARTITION BY user_id)) SELECT user_id, CASE WHEN count(*) < 2 THEN 0 ELSE round(least(greatest(coalesce(max(a), 0), coalesce(max(b), 0)) * 10 / 3, 10), 4) END AS significance FROM z GROUP BY 1")
def significance_of_columns(spark, sf):
    """The most telling of several numeric columns."""
    e = table(spark, sf, "events").withColumn("other", (F.col("event_id") % 97).cast("double"))
    return views.significance_of(e, ["user_id"], ["value", "other"])


@register("WITH b AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2), k AS (SELECT event_type, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM b GROUP BY 1) SELECT k.event_type, CAST(k.day AS VARCHAR) AS day, CAST(sum(n) OVER (PARTITION BY k.event_type ORDER BY k.day ROWS 2 PRECEDING) AS BIGINT) AS three_days FROM k LEFT JOIN b ON b.event_type = k.event_type AND b.day = k.day")
def window_over_gaps(spark, sf):
    """A rolling count over all days of a type, those without events too."""
    d = table(spark, sf, "events").filter("event_id % 3 = 0").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    full = q.fill_gaps(d, "day", ["event_type"], "day")
    out = q.windowed(full, "three_days", "n", "simple", "day", ["event_type"], "count", 3)
    return out.select("event_type", F.col("day").cast("string").alias("day"), "three_days")


@register("SELECT format AS month, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y/%m') AS format FROM orders WHERE strftime(o_orderdate, '%m') <> '02') GROUP BY 1")
def functions_in_filters(spark, sf):
    """A registered function in a filter and in a slice."""
    call = fn.REGISTRY.call
    return q.aggregate(sales(spark, sf), "Order", {"month": lambda r: call("format_date", r["o_orderdate"], "yyyy/MM")}, {"n": measure("count")}, [lambda r: call("format_date", r["o_orderdate"], "MM") != "02"])


@register("SELECT c_mktsegment AS segment, count(DISTINCT l_partkey) AS parts, count(DISTINCT o_orderpriority) AS priorities, count(DISTINCT c_custkey) AS customers FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 0 GROUP BY 1")
def distinct_over_children(spark, sf):
    """Distinct parts and priorities of a segment's customers, two and one relations away, merged from bitmaps and from values."""
    measures = {"parts": child("orders.lines.l_partkey", "count_distinct"), "priorities": child("orders.o_orderpriority", "count_distinct"), "customers": measure("count")}
    return q.aggregate(sales(spark, sf), "Customer", {"segment": "c_mktsegment"}, measures, [lambda r: r["c_acctbal"] > 0])


@register("WITH d AS (SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id FROM events), g AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM (SELECT DISTINCT event_type, day FROM d)) SELECT g.event_type, g.day, count(DISTINCT d.user_id) AS users FROM g JOIN g h ON g.event_type = h.event_type AND h.n BETWEEN g.n - 6 AND g.n JOIN d ON d.event_type = h.event_type AND d.day = h.day GROUP BY 1, 2")
def rolling_distinct_users(spark, sf):
    """Distinct users of the last seven days that have events of a kind."""
    m = Model.of((Entity("Event", "event_id", timestamps=("ts",)), table(spark, sf, "events")))
    return q.rolling_distinct(m, "Event", {"event_type": "event_type", "day": lambda r: fn.format_date(r["ts"], "yyyy-MM-dd")}, "user_id", "users", "day", 7)


@register("SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, CAST(row_number() OVER w AS BIGINT) AS place FROM lineitem WINDOW w AS (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) QUALIFY row_number() OVER w BETWEEN 49996 AND 50000")
def deep_page(spark, sf):
    """Page 10,000 of the lines by price, five a page: only the range that it lies in is read."""
    order = [F.col("l_extendedprice").desc(), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]]
    ranked = Ranked.of(table(spark, sf, "lineitem"), order, scratch(spark), 32)
    return ranked.page(10_000, 5, "place").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "place")


@register("WITH n AS (SELECT event_id, event_type, value * power(0.5, least(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1, 900)) AS score FROM events) SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY score DESC, event_id) AS BIGINT) AS position FROM n")
def full_diversity_rank(spark, sf):
    """The place of every event where each further one of its kind counts half."""
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "event_id")
    e = table(spark, sf, "events")
    scored = e.withColumn("score", F.col("value") * F.pow(F.lit(0.5), F.least(F.row_number().over(w) - 1, F.lit(900))))
    return Ranked.of(scored, [F.col("score").desc(), F.col("event_id").asc()], scratch(spark), 16).rows().select("event_id", "event_type", "position")
