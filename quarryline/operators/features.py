"""Features: computed columns per entity, in a long table of text values."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .load import upsert


@dataclass(frozen=True)
class Feature:
    """id, entity table and key, and one of: an expression over the row, an aggregate over it, or raw SQL giving entity_id and value."""

    id: str
    table: str
    key: str
    expr: str = ""
    aggregate: bool = False
    sql: str = ""
    kind: str = "double"
    needs: tuple[str, ...] = field(default=())
    mode: str = "materialized"  # or dynamic: worked out in queries, not stored
    ttl_seconds: int | None = None  # stored values older than this are recomputed

    def checksum(self) -> str:
        return hashlib.sha256(repr((self.table, self.key, self.expr, self.aggregate, self.sql, self.kind)).encode()).hexdigest()


def _sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A query in whose scope the given tables have their names, before any view of the session.

    They are common table expressions around the query, so that joins by comma, subqueries, the query's own
    WITH and names inside text mean what they say.
    """
    used = {name: df for name, df in tables.items() if re.search(rf"\b{re.escape(name)}\b", sql, re.I)}
    if not used:
        return spark.sql(sql)
    scope = ", ".join(f"`{name}` AS (SELECT * FROM {{t{k}}})" for k, name in enumerate(used))
    text = sql.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH {scope} SELECT * FROM ({text})", **{f"t{k}": df for k, df in enumerate(used.values())})


def evaluate(spark: SparkSession, f: Feature, tables: dict[str, DataFrame]) -> DataFrame:
    """(entity_id, value) with value of the feature's type."""
    if f.sql:
        if not (re.search(r"\bentity_id\b", f.sql) and re.search(r"\bvalue\b", f.sql)):
            raise ValueError(f"{f.id}: its SQL must give entity_id and value")
        if re.search(r"\b(order\s+by|limit)\b", f.sql, re.I):
            raise ValueError(f"{f.id}: no ORDER BY or LIMIT")
        return _sql(spark, f.sql, tables).select(F.col("entity_id").cast("string").alias("entity_id"), F.col("value").cast(f.kind).alias("value"))
    df = tables[f.table]
    if f.aggregate:
        return df.groupBy(F.col(f.key).cast("string").alias("entity_id")).agg(F.expr(f.expr).cast(f.kind).alias("value"))
    return df.select(F.col(f.key).cast("string").alias("entity_id"), F.expr(f.expr).cast(f.kind).alias("value"))


def with_features(df: DataFrame, features: list[Feature]) -> DataFrame:
    """df with one column per expression feature, those that others need first; windows may build on them."""
    left, done = list(features), set()
    while left:
        ready = [f for f in left if set(f.needs) <= done]
        if not ready:
            raise ValueError(f"features need each other: {[f.id for f in left]}")
        for f in ready:
            df = df.withColumn(f.id, F.expr(f.expr).cast(f.kind))
            done.add(f.id)
        left = [f for f in left if f not in ready]
    return df


def long_values(spark: SparkSession, features: list[Feature], tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """(feature_id, entity_id, value text, computed_at) of all features."""
    if not features:
        raise ValueError("no features")
    shared: dict[tuple, list[Feature]] = {}
    parts = []
    for f in features:
        if f.sql:
            parts.append(evaluate(spark, f, tables).select(F.lit(f.id).alias("feature_id"), "entity_id", F.col("value").cast("string").alias("value")))
        else:
            shared.setdefault((f.table, f.key, f.aggregate), []).append(f)
    # Features of one table and kind come from one pass over it.
    for (table, key, aggregate), own in shared.items():
        entity = F.col(key).cast("string").alias("entity_id")
        values = [F.expr(f.expr).cast(f.kind).cast("string").alias(f"v{k}") for k, f in enumerate(own)]
        wide = tables[table].groupBy(entity).agg(*values) if aggregate else tables[table].select(entity, *values)
        rows = F.array(*[F.struct(F.lit(f.id).alias("feature_id"), F.col(f"v{k}").alias("value")) for k, f in enumerate(own)])
        parts.append(wide.select("entity_id", F.explode(rows).alias("s")).select("s.feature_id", "entity_id", "s.value"))
    return reduce(DataFrame.unionByName, parts).withColumn("computed_at", now)


def diff(spark: SparkSession, features: list[Feature], registered: DataFrame) -> DataFrame:
    """(feature_id, state) NEW, CHANGED, WOULD RECOMPUTE or DELETED against registered (feature_id, checksum)."""
    now = spark.createDataFrame([(f.id, f.checksum()) for f in features], "feature_id string, now string")
    before = registered.filter("active") if "active" in registered.columns else registered
    state = F.when(F.col("now").isNull(), "DELETED").when(F.col("checksum").isNull(), "NEW").when(F.col("checksum") != F.col("now"), "CHANGED").otherwise("WOULD RECOMPUTE")
    return now.join(before.select("feature_id", "checksum"), "feature_id", "full_outer").select("feature_id", state.alias("state"))


REGISTRY_SCHEMA = "feature_id string, version int, checksum string, mode string, ttl_seconds int, position int, active boolean"


def in_order(features: list[Feature]) -> list[Feature]:
    """The features with those that others need first, in the given order among equals."""
    left, out, known = list(features), [], {f.id for f in features}
    while left:
        done = {f.id for f in out}
        ready = [f for f in left if set(f.needs) & known <= done]
        if not ready:
            raise ValueError(f"features need each other: {[f.id for f in left]}")
        out.append(ready[0])
        left.remove(ready[0])
    return out


def register(spark: SparkSession, features: list[Feature], registry: DataFrame | None = None) -> DataFrame:
    """The registry after a run: new features at version 1, changed ones a version up, others as they were; position is the order to compute in.

    A feature that is left out stays, inactive and without a position, so that it goes on with its versions if it returns.
    """
    rows = [(f.id, f.checksum(), f.mode, f.ttl_seconds, k) for k, f in enumerate(in_order(features))]
    now = spark.createDataFrame(rows, "feature_id string, checksum string, mode string, ttl_seconds int, position int").withColumn("active", F.lit(True))
    registry = spark.createDataFrame([], REGISTRY_SCHEMA) if registry is None else registry
    old = registry.select("feature_id", *[F.col(c).alias(f"__{c}") for c in ("version", "checksum", "mode", "ttl_seconds")])
    version = F.when(F.col("__version").isNull(), 1).when(F.col("active").isNull(), F.col("__version")).otherwise(F.col("__version") + (F.col("__checksum") != F.col("checksum")).cast("int"))
    kept = [F.when(F.col("active"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in ("checksum", "mode", "ttl_seconds")]
    return now.join(old, "feature_id", "full_outer").select("feature_id", version.alias("version"), *kept, "position", F.coalesce("active", F.lit(False)).alias("active"))


#: Why a feature is computed: all of it, or its changed entities; dynamic ones only where another needs them.
ALL, ROWS = ("new", "changed", "expired", "needs"), "rows"


def steps(features: list[Feature], store: DataFrame, registry: DataFrame | None, now: Column, since: dict | None = None, only: set[str] | None = None) -> dict[str, str]:
    """What a run does with each feature, in computing order.

    new: no values are stored; changed: its definition is another; expired: its values are older than its ttl;
    needs: one that it needs is computed anew; rows: fresh, but of a table with a mark in `since`, so its changed
    entities are computed; fresh; dynamic: never stored; left out: not in `only`.
    """
    ages = {r.feature_id: r.age for r in store.groupBy("feature_id").agg(F.max(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("computed_at").cast("timestamp"))).alias("age")).collect()}
    sums = {} if registry is None else {r.feature_id: r.checksum for r in registry.select("feature_id", "checksum").collect()}
    out, anew, moved = {}, set(), set()
    for f in in_order(features):
        changed = sums.get(f.id, f.checksum()) != f.checksum()
        if f.mode != "materialized":
            out[f.id] = "dynamic"
        elif only is not None and f.id not in only:
            out[f.id] = "left out"
        elif f.id not in ages:
            out[f.id] = "new"
        elif changed:
            out[f.id] = "changed"
        elif f.ttl_seconds is not None and ages[f.id] > f.ttl_seconds * 1e6:
            out[f.id] = "expired"
        elif anew & set(f.needs):
            out[f.id] = "needs"
        elif f.table in (since or {}) or moved & set(f.needs):
            out[f.id] = ROWS
        else:
            out[f.id] = "fresh"
        if out[f.id] == ROWS or (out[f.id] == "dynamic" and (f.table in (since or {}) or moved & set(f.needs))):
            moved.add(f.id)
        if out[f.id] in ALL or (out[f.id] == "dynamic" and (changed or anew & set(f.needs))):
            anew.add(f.id)
    return out


def stale(features: list[Feature], store: DataFrame, registry: DataFrame | None, now: Column) -> list[Feature]:
    """Materialised features that are stale themselves: without values, changed since registered, or with values older than their ttl; a run computes those that need them too."""
    what = steps(features, store, registry, now)
    return [f for f in in_order(features) if what[f.id] in ("new", "changed", "expired")]


def stages(features: list[Feature]) -> list[list[Feature]]:
    """The features in stages: one that needs a feature of its own table's rows shares that one's stage, another comes a stage later."""
    known, stage = {f.id: f for f in features}, {}
    for f in in_order(features):
        stage[f.id] = max((stage[g] + (not _inline(f, known[g])) for g in f.needs if g in known), default=0)
    return [[f for f in in_order(features) if stage[f.id] == k] for k in range(max(stage.values(), default=-1) + 1)]


def _inline(f: Feature, g: Feature) -> bool:
    """Whether g is a column of the rows that f is computed from."""
    return f.table == g.table and not (g.aggregate or g.sql or f.sql)


def compute(spark: SparkSession, features: list[Feature], tables: dict[str, DataFrame], store: DataFrame, now: Column, what: dict[str, str], since: dict[str, tuple[str, object]] | None = None) -> DataFrame | None:
    """Long values of what `steps` says is to be computed, stage by stage; None if there is nothing.

    A stage's features of one table, key and kind are one pass over a wide table: the rows, the values from earlier stages
    (joined once for each table that they are in), then the features themselves, those that others need first. Fresh
    features come from the store. With `since` (table -> (time column, mark)) features that are fresh otherwise are
    computed for the entities of rows at or after the mark, and of changed values that they need; SQL and
    windows, whose rows depend on others, for all.
    """
    known = {f.id: f for f in features}
    wanted = {i for i, why in what.items() if why in ALL or why == ROWS}
    todo = list(wanted)
    while todo:  # dynamic features that these need
        more = [g for g in known[todo.pop()].needs if what.get(g) == "dynamic" and g not in wanted]
        wanted.update(more)
        todo.extend(more)
    done: dict[str, tuple[int, DataFrame]] = {}  # feature -> (number of its wide table, that table)
    touched: dict[str, DataFrame] = {}  # feature -> the entities that are computed, where not all are
    parts = []
    for level in stages(features):
        groups: dict[tuple, list[Feature]] = {}
        for f in level:
            if f.id in wanted:
                whole = what[f.id] != ROWS or bool(f.sql) or re.search(r"\bover\s*\(", f.expr, re.I) is not None
                groups.setdefault((f.id,) if f.sql else (f.table, f.key, f.aggregate, whole), []).append(f)
        for own in groups.values():
            f = own[0]
            if f.sql:
                long = [store.select("feature_id", "entity_id", "value")] + [_long(done[g][1], [known[g]]) for g in f.needs if g in done]
                wide = evaluate(spark, f, {**tables, "__feature_value": reduce(DataFrame.unionByName, long)}).withColumnRenamed("value", f.id)
            else:
                df, entity = tables[f.table], F.col(f.key).cast("string")
                columns: dict[str, Feature] = {}
                sources: dict[object, tuple[DataFrame, list[Feature], str]] = {}
                todo = [*own]
                while todo:
                    g = todo.pop()
                    for h in (known[i] for i in g.needs if i in known):
                        if _inline(g, h) and (h.id in wanted or h.mode != "materialized"):
                            if h.id not in columns:
                                columns[h.id] = h
                                todo.append(h)
                            continue
                        number, source = done.get(h.id, ("store", store))
                        on = h.key if h.key in df.columns else g.key
                        rows = sources.setdefault((number, on), (source, [], on))[1]
                        if h not in rows:
                            rows.append(h)
                ids = _entities(f, own, known, tables, touched, since or {})
                if ids is not None:
                    touched.update({g.id: ids for g in own if what[g.id] in (ROWS, "dynamic")})
                    if not _is_whole(own, what):
                        df = df.join(ids.withColumnRenamed("entity_id", "__id"), entity == F.col("__id"), "left_semi")
                for k, ((number, on), (source, needed, _)) in enumerate(sources.items()):
                    side = _stored(source, needed) if number == "store" else source.select("entity_id", *[g.id for g in needed])
                    df = df.join(side.withColumnRenamed("entity_id", f"__e{k}"), F.col(on).cast("string") == F.col(f"__e{k}"), "left").drop(f"__e{k}")
                for g in in_order([*{**columns, **({} if f.aggregate else {g.id: g for g in own})}.values()]):
                    df = df.withColumn(g.id, F.expr(g.expr).cast(g.kind))
                entity = F.col(f.key).cast("string").alias("entity_id")
                wide = df.groupBy(entity).agg(*[F.expr(g.expr).cast(g.kind).alias(g.id) for g in own]) if f.aggregate else df.select(entity, *[g.id for g in own])
            for g in own:
                done[g.id] = (len(parts), wide)
            stored = [g for g in own if g.mode == "materialized"]
            parts.append(_long(wide, stored) if stored else None)
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts).withColumn("computed_at", now) if parts else None


def _is_whole(own: list[Feature], what: dict[str, str]) -> bool:
    return any(what[f.id] != ROWS or re.search(r"\bover\s*\(", f.expr, re.I) for f in own)


def _entities(f: Feature, own: list[Feature], known: dict[str, Feature], tables: dict[str, DataFrame], touched: dict[str, DataFrame], since: dict) -> DataFrame | None:
    """(entity_id) to compute of features of one table and key: of changed rows, and of rows whose needed values were computed; None without either."""
    rows, entity, parts = tables[f.table], F.col(f.key).cast("string").alias("entity_id"), []
    if f.table in since:
        column, mark = since[f.table]
        parts.append(rows.filter(F.col(column).cast("timestamp") >= F.lit(mark).cast("timestamp")).select(entity))
    for h in {i: known[i] for g in own for i in g.needs if i in touched}.values():
        on = h.key if h.key in rows.columns else f.key
        parts.append(rows.join(touched[h.id].withColumnRenamed("entity_id", "__id"), F.col(on).cast("string") == F.col("__id"), "left_semi").select(entity))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else None


def _stored(store: DataFrame, needed: list[Feature]) -> DataFrame:
    """(entity_id, a typed column per feature) of stored values, in one pass."""
    own = store.filter(F.col("feature_id").isin([f.id for f in needed]))
    return own.groupBy("entity_id").agg(*[F.max(F.when(F.col("feature_id") == f.id, F.col("value"))).try_cast(f.kind).alias(f.id) for f in needed])


def _long(wide: DataFrame, own: list[Feature]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f.id).alias("feature_id"), F.col(f.id).cast("string").alias("value")) for f in own])
    return wide.select("entity_id", F.explode(rows).alias("s")).select("s.feature_id", "entity_id", "s.value")


@dataclass(frozen=True)
class Reconciled:
    """What a run leaves: the values, the registry, and what it did with each feature."""

    values: DataFrame
    registry: DataFrame
    steps: dict[str, str]


def run(spark: SparkSession, features: list[Feature], tables: dict[str, DataFrame], store: DataFrame, now: Column, registry: DataFrame | None = None, since: dict[str, tuple[str, object]] | None = None, only: set[str] | None = None) -> Reconciled:
    """A reconcile by the registry: stale materialised features computed in order and upserted by feature and entity; others keep their values."""
    what = steps(features, store, registry, now, since, only)
    new = compute(spark, features, tables, store, now, what, since)
    values = store if new is None else upsert(store, new, ["feature_id", "entity_id"], F.col("computed_at"))
    return Reconciled(values, register(spark, features, registry), what)


def reconcile(spark: SparkSession, features: list[Feature], tables: dict[str, DataFrame], store: DataFrame, now: Column) -> DataFrame:
    """The store after computing all materialised features anew: upserted by feature and entity."""
    new = compute(spark, features, tables, store, now, {f.id: "new" if f.mode == "materialized" else "dynamic" for f in features})
    return store if new is None else upsert(store, new, ["feature_id", "entity_id"], F.col("computed_at"))


def argmax(df: DataFrame, by: list[str], value: str, key: str, name: str = "value") -> DataFrame:
    """(by.., name): `value` at the row with the largest `key`, of ties the largest value; rows without a key don't count."""
    return df.groupBy(*by).agg(F.max(F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))["v"].alias(name))


#: Functions over rows of a window, by name.
_ROW_FUNCTIONS = {"lag": F.lag, "lead": F.lead, "rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "first": F.first, "last": F.last}


def row_window(fn: str, order: list[str | Column], partition: list[str] = (), of: str | Column | None = None, offset: int = 1, frame: int | None = None) -> Column:
    """fn over a row's partition, as a Column that other functions can take; aggregates run up to this row, or over the last `frame` rows."""
    if fn not in _ROW_FUNCTIONS:
        raise ValueError(f"unknown window function {fn!r}")
    w = Window.partitionBy(*partition).orderBy(*order)
    if fn in ("rank", "dense_rank", "row_number"):
        return _ROW_FUNCTIONS[fn]().over(w)
    if of is None:
        raise ValueError(f"{fn} needs a column")
    if fn in ("lag", "lead"):
        return _ROW_FUNCTIONS[fn](of, offset).over(w)
    return _ROW_FUNCTIONS[fn](of).over(w.rowsBetween(Window.unboundedPreceding if frame is None else 1 - frame, 0))


def feature_column(df: DataFrame, store: DataFrame, feature_id: str, key: str, kind: str = "double", name: str | None = None) -> DataFrame:
    """df with a stored feature as a typed column."""
    own = store.filter(F.col("feature_id") == feature_id).select(F.col("entity_id").alias("__e"), F.col("value").try_cast(kind).alias(name or feature_id))
    return df.join(own, df[key].cast("string") == F.col("__e"), "left").drop("__e")


def value_maps(store: DataFrame) -> DataFrame:
    """(entity_id, features map)."""
    return store.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature_id", "value")))).alias("features"))


def null_rates(store: DataFrame) -> DataFrame:
    return store.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), F.avg(F.col("value").isNull().cast("double")).alias("null_rate"))


def preview(spark: SparkSession, f: Feature, tables: dict[str, DataFrame], keys: list) -> DataFrame:
    """The feature for at most ten given keys."""
    if len(keys) > 10:
        raise ValueError("a preview takes at most ten keys")
    return evaluate(spark, f, tables | {f.table: tables[f.table].filter(F.col(f.key).isin(keys))})
