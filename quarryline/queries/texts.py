"""Scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators import joins
from .base import registrar, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
register = registrar(QUERIES, ORACLE_SQL)


@register("SELECT l_orderkey, l_linenumber, l_shipdate, round(epoch_us(l_shipdate - o_orderdate) / 3.6e9, 6) AS hours, CAST(trunc(epoch_us(l_shipdate - o_orderdate) / 8.64e10) AS BIGINT) AS days, round(epoch_us(l_shipdate - o_orderdate) / (8.64e10 * 365.25), 9) AS years, date_diff('month', o_orderdate, l_shipdate) AS months_crossed, date_diff('year', o_orderdate, l_shipdate) AS years_crossed FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def time_differences(spark, sf):
    x = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    return x.select("l_orderkey", "l_linenumber", "l_shipdate", F.round(fn.datetime_diff(a, b, "hours"), 6).alias("hours"), fn.datetime_diff(a, b, "days").alias("days"), F.round(fn.datetime_diff(a, b, "years"), 9).alias("years"), fn.datetime_diff(a, b, "months", "boundary").alias("months_crossed"), fn.datetime_diff(a, b, "years", "boundary").alias("years_crossed"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS full_date, strftime(o_orderdate, '%b %d, %y') AS short_date, strftime(o_orderdate, '%A/%j') AS named, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y-%m') AS calendar_month FROM orders")
def date_formats(spark, sf):
    t = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", fn.format_date(t, "yyyy-MM-dd HH:mm:ss").alias("full_date"), fn.format_date(t, "MMM dd, yy").alias("short_date"), fn.format_date(t, "EEEE/DDD").alias("named"), F.concat(fn.format_time(t, "YYYY"), F.lit("-W"), fn.format_time(t, "WW")).alias("week"), fn.format_time(t, "YYYY-MM", calendar=True).alias("calendar_month"))


@register("SELECT event_id, CAST(substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), 1, 19) AS TIMESTAMP) AS parsed FROM events")
def iso_text_times(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf, "events").select("event_id", fn.parse_ts(iso).alias("parsed"))


@register("SELECT p_partkey, concat(p_brand, '/', p_type) AS label, upper(trim(regexp_replace(regexp_replace(trim(p_name), '[^a-zA-Z0-9]+', '_', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g'), '_')) AS snake, regexp_extract(p_brand, '[0-9]+') AS brand_number, round(p_retailprice / 3, 2) AS third, split_part(p_type, ' ', 1) AS first_word, coalesce(nullif(p_size, 1), 0) AS size_or_zero FROM part")
def text_functions(spark, sf):
    r = fn.REGISTRY
    c = F.col
    return table(spark, sf, "part").select("p_partkey", r.call("concat", c("p_brand"), F.lit("/"), c("p_type")).alias("label"), r.call("upper_snake", c("p_name")).alias("snake"), fn.regex_extract(c("p_brand"), "[0-9]+").alias("brand_number"), F.round(c("p_retailprice") / 3, 2).alias("third"), r.call("split_part", c("p_type"), F.lit(" "), F.lit(1)).alias("first_word"), fn.default(F.nullif(c("p_size"), F.lit(1)), 0).alias("size_or_zero"))


@register("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_type, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') AS titled, lower(p_type) AS low FROM part")
def title_case(spark, sf):
    return table(spark, sf, "part").select("p_partkey", fn.title(F.col("p_type")).alias("titled"), F.lower("p_type").alias("low"))


ULID = "WITH h AS (SELECT c_custkey, sha256(c_name) AS h FROM customer), b AS (SELECT c_custkey, '00' || array_to_string(list_transform(range(1, 33), lambda i: lpad(bin(instr('0123456789abcdef', h[i:i]) - 1), 4, '0')), '') AS b FROM h) SELECT c_custkey, array_to_string(list_transform(range(0, 26), lambda k: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(list_reduce(list_transform(range(1, 6), lambda j: CAST(b[k * 5 + j:k * 5 + j] AS INT)), lambda x, y: x * 2 + y) AS INT) + 1, 1)), '') AS id FROM b"


@register(ULID)
def stable_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fn.ulid(F.col("c_name")).alias("id"))


@register("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number, props LIKE '%\"k\"%' AS has_k, false AS has_z, CASE WHEN event_type = 'view' OR event_type = 'click' THEN 'passive' WHEN event_type = 'purchase' THEN 'active' END AS canonical, sha256(props) AS hash FROM events")
def json_and_enum(spark, sf):
    p = F.col("props")
    return table(spark, sf, "events").select("event_id", fn.json_extract(p, "k").alias("k"), fn.cast_to(fn.json_extract(p, "k"), "integer").alias("k_number"), fn.json_has_key(p, "k").alias("has_k"), fn.json_has_key(p, "z").alias("has_z"), fn.enum(F.col("event_type"), {"passive": ["view", "click"], "active": ["purchase"]}).alias("canonical"), fn.content_hash(p).alias("hash"))


TYPES = "(SELECT user_id, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY 1)"


def user_types(spark, sf):
    """JSON arrays and arrays of objects per user."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("t")).select("user_id", F.to_json("t").alias("types"), F.to_json(F.transform("t", lambda x: F.struct(x.alias("name"), F.length(x).alias("size")))).alias("objects"))


@register(f"SELECT user_id, list_contains(types, 'error') AS has_error, list_has_any(types, ['signup', 'purchase']) AS has_any, list_contains(types, 'click') AS any_click, CASE WHEN list_contains(types, 'view') THEN '4' END AS view_size FROM {TYPES}")
def json_containment(spark, sf):
    u = user_types(spark, sf)
    return u.select("user_id", fn.json_contains(F.col("types"), "error").alias("has_error"), fn.json_contains_any(F.col("types"), ["signup", "purchase"]).alias("has_any"), fn.json_any(F.col("objects"), "name", "click").alias("any_click"), fn.json_find(F.col("objects"), "name", "view", "size").alias("view_size"))


@register(f"SELECT k.kind, u.user_id FROM (SELECT DISTINCT event_type AS kind FROM events) k LEFT JOIN {TYPES} u ON list_contains(u.types, k.kind)")
def json_array_join(spark, sf):
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct()
    return joins.json_array_contains(kinds, user_types(spark, sf), "kind", F.col("types")).select("kind", "user_id")


@register(f"SELECT k.kind, u.user_id FROM (SELECT DISTINCT event_type AS kind FROM events) k LEFT JOIN (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN types ELSE [types[1]] END AS types FROM {TYPES}) u ON list_contains(u.types, k.kind)")
def scalar_or_array_join(spark, sf):
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("kind")).distinct()
    mixed = user_types(spark, sf).withColumn("types", F.when(F.col("user_id") % 2 == 0, F.col("types")).otherwise(F.get(fn.json_list(F.col("types")), F.lit(0))))
    return joins.scalar_or_array_contains(kinds, mixed, "kind", "types").select("kind", "user_id")


@register("SELECT o_orderkey, printf('%.1f%%', round(CAST(o_custkey % 8 AS DOUBLE) * 12.5, 1)) AS percent, CASE WHEN o_orderkey % 50 >= 24 THEN printf('%.1fd', round(CAST(o_orderkey % 50 AS DOUBLE) / 24, 1)) WHEN o_orderkey % 50 >= 1 THEN printf('%.1fh', CAST(o_orderkey % 50 AS DOUBLE)) ELSE '0s' END AS duration FROM orders")
def display_formats(spark, sf):
    h = (F.col("o_orderkey") % 50).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", fn.display_percent((F.col("o_custkey") % 8).cast("double") * 0.125).alias("percent"), fn.display_hours(h).alias("duration"))


@register("SELECT o_orderkey, format('{:,}', o_orderkey * 1000) AS thousands FROM orders")
def number_pattern(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fn.display_number(F.col("o_orderkey") * 1000, "#,##0").alias("thousands"))


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS price_if, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END, 'none') AS first_of, o_orderstatus IN ('F', 'O') AS known, trim(o_orderpriority) AS trimmed FROM orders")
def null_functions(spark, sf):
    filled = F.when(F.col("o_orderstatus") == "F", F.lit("yes"))
    return table(spark, sf, "orders").select("o_orderkey", fn.if_not_null(filled, F.col("o_totalprice")).alias("price_if"), F.coalesce(fn.if_not_null(filled, F.col("o_orderpriority")), F.lit("none")).alias("first_of"), fn.cast_to(F.when(F.col("o_orderstatus").isin("F", "O"), F.lit("Yes")).otherwise("no"), "boolean").alias("known"), fn.trim_all(F.col("o_orderpriority")).alias("trimmed"))
