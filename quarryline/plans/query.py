"""Detail and aggregate queries over a model: one lazy DataFrame each.

A path is 'field', 'hop.field' or 'hop.hop.field', a hop being a relation's or an entity's
name. Wherever a path can stand, a callable of the resolver can: lambda r: r['Nation.n_name'].
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import format_time
from ..operators.joins import as_of
from . import distinct
from .model import Entity, Model, Relation, is_open

UNSET = "(unset)"
Ref = "str | Callable[[Resolver], Column]"


class Resolver:
    """Turns paths into columns and remembers the joins that they need; equal hops share a join."""

    def __init__(self, model: Model, root: str, as_of: Column | None = None):
        self.model, self.root, self.as_of = model, root, as_of
        self.hops: dict[tuple[str, ...], tuple[str, Relation]] = {}

    def __getitem__(self, path: str) -> Column:
        *hops, name = path.split(".")
        if hops and hops[0] == self.root:
            hops = hops[1:]
        return self._walk(hops, name)

    def label(self, path: str) -> Column:
        """A traversed value as text, '(unset)' for null; filters use it to find, or to count in, rows without one."""
        return F.coalesce(self[path].cast("string"), F.lit(UNSET)) if "." in path else self[path]

    def _walk(self, hops: list[str], name: str) -> Column:
        at, done = self.root, ()
        for hop in hops:
            try:
                r = self.model.relation(at, hop)
            except ValueError:
                if hop not in self.model.entities:
                    raise
                names = self.model.path(at, hop)
                for n in names[:-1]:
                    at, done = self._hop(at, done, self.model.relation(at, n))
                r = self.model.relation(at, names[-1])
            if r.kind == "dynamic":
                return self._dynamic(done, r, name)
            if r.kind != "m2o":
                raise ValueError(f"{at}.{hop} isn't many-to-one; use a child measure")
            at, done = self._hop(at, done, r)
        if name not in self.model.fields(at):
            raise ValueError(f"{at} has no field {name!r}")
        return F.col(f"{self._alias(done)}.{name}")

    def _hop(self, at: str, done: tuple[str, ...], r: Relation) -> tuple[str, tuple[str, ...]]:
        key = (*done, r.name)
        self.hops.setdefault(key, (at, r))
        return r.target, key

    def _dynamic(self, done: tuple[str, ...], r: Relation, name: str) -> Column:
        if not any(name in self.model.fields(e) for e in self.model.entities):
            raise ValueError(f"no entity has the field {name!r}")
        self.hops.setdefault((*done, r.name, name), ("", r))
        return F.col(f"{self._alias((*done, r.name, name))}.value")

    @staticmethod
    def _alias(hops: tuple[str, ...]) -> str:
        return "root" + "".join(f"__{h}" for h in hops)

    def joined(self) -> DataFrame:
        """The root's table with every remembered hop left-joined."""
        df = self.model.table(self.root).alias("root")
        for hops, (_, r) in self.hops.items():
            left, alias = self._alias(hops[:-1] if r.kind == "m2o" else hops[:-2]), self._alias(hops)
            if r.kind == "dynamic":
                name = hops[-1]
                parts = [self.model.current(e.name).select(F.lit(e.name).alias("type"), F.col(e.key).cast("string").alias("key"), F.col(name).cast("string").alias("value")) for e in self.model.entities.values() if name in self.model.fields(e.name)]
                side = reduce(DataFrame.unionByName, parts).alias(alias)
                on = (F.col(f"{left}.{r.via[0]}").cast("string") == F.col(f"{alias}.key")) & (F.col(f"{left}.{r.type_col}") == F.col(f"{alias}.type"))
                df = df.join(side, on, "left")
                continue
            e = self.model.entity(r.target)
            target = r.via_target or (e.key,)
            on = reduce(Column.__and__, [F.col(f"{left}.{a}") == F.col(f"{alias}.{b}") for a, b in zip(r.via, target, strict=True)])
            if e.history and self.as_of is not None:
                df = self._join_as_of(df, left, alias, r, e)
            else:
                df = df.join(self.model.current(r.target).alias(alias), on, "left")
        return df

    def _join_as_of(self, df: DataFrame, left: str, alias: str, r: Relation, e: Entity) -> DataFrame:
        """df with the versions that hold at its time: found by a merge for each distinct key and time, joined by both."""
        key = [f"__v{i}" for i in range(len(r.via))]
        asked = df.select(*[F.col(f"{left}.{a}").alias(k) for a, k in zip(r.via, key, strict=True)], self.as_of.alias("__at")).distinct()
        side = as_of(asked, self.model.table(r.target), list(zip(key, r.via_target or (e.key,), strict=True)), "__at", *e.history).alias(alias)
        on = [F.col(f"{left}.{a}") == F.col(f"{alias}.{k}") for a, k in zip(r.via, key, strict=True)]
        return df.join(side, reduce(Column.__and__, [*on, self.as_of == F.col(f"{alias}.__at")]), "left")

    def value(self, ref) -> Column:
        return ref(self) if callable(ref) else self[ref]


@dataclass(frozen=True)
class TimeSlice:
    """A timestamp field cut by a format_time pattern."""

    path: str
    pattern: str
    calendar: bool = False

    def __call__(self, r: Resolver) -> Column:
        check_time_slice(r.model, r.root, self.path, self.pattern)
        return format_time(r[self.path], self.pattern, self.calendar)


def time_of(model: Model, root: str, slices: dict) -> Column | None:
    """The root's own field of the first time slice: the time that histories are read as of."""
    for s in slices.values():
        if isinstance(s, TimeSlice) and "." not in s.path.removeprefix(f"{root}."):
            return F.col(f"root.{s.path.rpartition('.')[2]}")
    return None


def _filtered(r: Resolver, filters) -> list[Column]:
    out = [f(r) if callable(f) else F.expr(f) for f in filters if f is not None]
    e = r.model.entity(r.root)
    if e.history and r.as_of is None:
        out.append(is_open(F.col(f"root.{e.history[1]}")))
    return out


def _finish(df: DataFrame, order: list[str] | None) -> DataFrame:
    return df.orderBy(*[order_key(o) for o in order]) if order else df


def order_key(item: str) -> Column:
    """'name', 'name asc' or 'name desc'; nulls last ascending, first descending."""
    name, _, way = item.partition(" ")
    return F.col(f"`{name}`").desc_nulls_first() if way.strip().lower() == "desc" else F.col(f"`{name}`").asc_nulls_last()


def positional_order(attributes: dict[str, str]) -> list[str]:
    """Order items from per-attribute '1, desc' notes, by their number."""
    noted = [(int(n), name, (way or "asc").strip()) for name, note in attributes.items() for n, _, way in [note.partition(",")]]
    return [f"{name} {way}" for _, name, way in sorted(noted)]


def detail(model: Model, root: str, attributes: dict, filters=(), order: list[str] | None = None, as_of: Column | None = None) -> DataFrame:
    """Rows of root: output name -> path or callable. A traversed path's null is '(unset)'."""
    if not attributes:
        raise ValueError("a detail query needs an attribute")
    r = Resolver(model, root, as_of)
    columns = [(r.label(a) if isinstance(a, str) else a(r)).alias(name) for name, a in attributes.items()]
    where = _filtered(r, filters)
    df = r.joined()
    for w in where:
        df = df.filter(w)
    return _finish(df.select(*columns), order)


@dataclass(frozen=True)
class Measure:
    """fn over a path or callable; ratio: numerator / denominator; child: fn over a one-to-many path, pre-aggregated per parent."""

    fn: str
    of: object = None
    over: Measure | None = None
    child: tuple[str, ...] = ()

    def __truediv__(self, other: Measure) -> Measure:
        return replace(self, over=other)

    def column(self, r: Resolver) -> Column:
        if self.of is None:
            if self.fn != "count":
                raise ValueError(f"{self.fn} needs a field")
            return F.count(F.lit(1))
        c = r.value(self.of)
        fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.countDistinct}
        if self.fn not in fns:
            raise ValueError(f"unknown aggregate {self.fn!r}")
        return fns[self.fn](c)


def measure(fn: str, of=None) -> Measure:
    return Measure(fn, of)


def child(path: str, fn: str = "count") -> Measure:
    """fn over 'relation.field' or 'relation.relation.field' of one-to-many hops; count of a key counts rows."""
    *hops, name = path.split(".")
    return Measure(fn, name, child=tuple(hops))


def child_totals(model: Model, root: str, hops: tuple[str, ...], name: str, fn: str) -> DataFrame:
    """(root key columns k0.., value): each hop grouped by its foreign key before it is joined, so nothing fans out."""
    r = model.relation(root, hops[0])
    if r.kind != "o2m":
        raise ValueError(f"{root}.{hops[0]} isn't one-to-many")
    rows = model.current(r.target)
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(r.via_target)]
    if len(hops) > 1:
        deeper = child_totals(model, r.target, hops[1:], name, fn)
        inner = model.relation(r.target, hops[1])
        on = reduce(Column.__and__, [F.col(f"c.{a}") == F.col(f"d.k{i}") for i, a in enumerate(inner.via)])
        rows = rows.alias("c").join(deeper.alias("d"), on, "left").select("c.*", F.col("d.value").alias("__value"))
        total = {"count": F.sum(F.coalesce("__value", F.lit(0))), "sum": F.sum("__value"), "min": F.min("__value"), "max": F.max("__value")}
    else:
        total = {"count": F.count(F.col(name)), "sum": F.sum(name), "min": F.min(name), "max": F.max(name)}
    if fn not in total:
        raise ValueError(f"{fn} of a child can't be summed up per parent")
    return rows.groupBy(*keys).agg(total[fn].alias("value"))


def aggregate(model: Model, root: str, slices: dict, measures: dict[str, Measure], filters=(), attributes: dict | None = None, order: list[str] | None = None, as_of: Column | None = None, thresholds: dict | None = None) -> DataFrame:
    """Measures by slices. Slices' traversed nulls are '(unset)'; extra attributes group too and keep nulls; a clash gets _raw.

    Related histories are read as of `as_of`, else as of the first time slice of the root's own, else
    their open rows. A measure of a bare field that only one one-to-many child has is that child's.
    """
    if as_of is None and model.entity(root).history is None:
        as_of = time_of(model, root, slices)
    for s in slices.values():
        if isinstance(s, str):
            check_time_slice(model, root, s, None, quiet=True)
    r = Resolver(model, root, as_of)
    keys = {n: (r.label(s) if isinstance(s, str) else s(r)) for n, s in slices.items()}
    for n, a in (attributes or {}).items():
        keys[f"{n}_raw" if n in keys or n in measures else n] = r.value(a)
    plain, parts, distinct_parts = {}, {}, {}
    for name, m in measures.items():
        for tag, one in (("", replace(m, over=None)), ("__over", m.over)):
            if one is not None:
                one = _of_child(model, root, one)
                (plain if not one.child else distinct_parts if one.fn == "count_distinct" else parts)[f"{name}{tag}"] = one
    columns = {n: m.column(r) for n, m in plain.items()}
    where = _filtered(r, filters)
    df = r.joined()
    for w in where:
        df = df.filter(w)
    if as_of is not None and model.entity(root).history:
        since, until = (F.col(f"root.{c}") for c in model.entity(root).history)
        df = df.filter((since <= as_of) & (is_open(until) | (until > as_of)))
    base = df
    for k, (name, m) in enumerate(parts.items()):
        rel = model.relation(root, m.child[0])
        totals = child_totals(model, root, m.child, m.of, m.fn).alias(f"child{k}")
        on = reduce(Column.__and__, [F.col(f"root.{a}") == F.col(f"child{k}.k{i}") for i, a in enumerate(rel.via)])
        df = df.join(totals, on, "left")
        value = F.col(f"child{k}.value")
        columns[name] = {"min": F.min, "max": F.max}[m.fn](value) if m.fn in ("min", "max") else F.sum(F.coalesce(value, F.lit(0)))
    grouped = df.groupBy(*[c.alias(n) for n, c in keys.items()]) if keys else df.groupBy()
    out = grouped.agg(*[c.alias(n) for n, c in columns.items()] or [F.count(F.lit(1)).alias("__rows")])
    for name, m in distinct_parts.items():
        counts = distinct.count(_child_values(model, root, base, keys, m), list(keys), f"{name}__n").alias("d")
        same = reduce(Column.__and__, [F.col(f"o.`{n}`").eqNullSafe(F.col(f"d.`{n}`")) for n in keys], F.lit(True))
        out = out.alias("o").join(counts, same, "left").select("o.*", F.coalesce(F.col(f"d.`{name}__n`"), F.lit(0)).alias(name))
    final = [F.try_divide(F.col(n).cast("double"), F.col(f"{n}__over").cast("double")).alias(n) if m.over is not None else F.col(n) for n, m in measures.items()]
    out = out.select(*[F.col(f"`{n}`") for n in keys], *final)
    for n, rules in (thresholds or {}).items():
        out = out.withColumn(f"{n}_status", status_label(F.col(n), rules))
    return _finish(out, order)


def _child_values(model: Model, root: str, base: DataFrame, keys: dict[str, Column], m: Measure) -> DataFrame:
    """State of the distinct values of a child's field for each group of the root's rows: pairs of key and value, once each, joined from the last child up."""
    at, rels = root, []
    for hop in m.child:
        rel = model.relation(at, hop)
        if rel.kind != "o2m":
            raise ValueError(f"{at}.{hop} isn't one-to-many")
        rels.append(rel)
        at = rel.target
    values = model.current(at).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(rels[-1].via_target)], F.col(m.of).alias("__of")).distinct()
    for above, rel in zip(reversed(rels[:-1]), reversed(rels[1:]), strict=True):
        parent = model.current(above.target).select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(above.via_target)], *[F.col(c).alias(f"__v{i}") for i, c in enumerate(rel.via)])
        on = reduce(Column.__and__, [F.col(f"__v{i}") == F.col(f"__k{i}") for i in range(len(rel.via))])
        values = parent.join(values, on).select(*[F.col(f"__p{i}").alias(f"__k{i}") for i in range(len(above.via_target))], "__of").distinct()
    rows = base.select(*[c.alias(n) for n, c in keys.items()], *[F.col(f"root.{c}").alias(f"__v{i}") for i, c in enumerate(rels[0].via)])
    on = reduce(Column.__and__, [F.col(f"__v{i}") == F.col(f"__k{i}") for i in range(len(rels[0].via))])
    return distinct.state(rows.join(values, on), list(keys), "__of")


def rolling_distinct(model: Model, root: str, slices: dict, of, name: str, order: str, frame: int, filters=()) -> DataFrame:
    """Groups by slices, each with the distinct values of `of` in its last `frame` groups, by the slice `order` within the others."""
    r = Resolver(model, root, time_of(model, root, slices) if model.entity(root).history is None else None)
    keys = {n: (r.label(s) if isinstance(s, str) else s(r)) for n, s in slices.items()}
    if order not in keys:
        raise ValueError(f"no slice {order!r}")
    value, where = r.value(of), _filtered(r, filters)
    df = r.joined()
    for w in where:
        df = df.filter(w)
    rows = df.select(*[c.alias(n) for n, c in keys.items()], value.alias("__of"))
    return distinct.rolling(rows.select(*keys).distinct(), distinct.state(rows, list(keys), "__of"), name, order, [n for n in keys if n != order], frame)


def _of_child(model: Model, root: str, m: Measure) -> Measure:
    if m.child or not isinstance(m.of, str) or "." in m.of or m.of in model.fields(root):
        return m
    rel, name = model.child_field(root, m.of)
    return replace(m, of=name, child=(rel.name,))


def status_label(value: Column, rules: list[tuple[str, float, str]]) -> Column:
    """The first rule (operator, limit, label) that holds; null for null and for none."""
    ops = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__, "!=": Column.__ne__}
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for op, limit, label in rules:
        chain = chain.when(ops[op](value, F.lit(limit)), F.lit(label))
    return chain


def fill_gaps(df: DataFrame, order: str, partition: list[str], grain: str) -> DataFrame:
    """df with a row for each missing bucket (a timestamp or date, cut to grain) from a partition's first to its last; its measures are null."""
    step = F.expr({"quarter": "INTERVAL 3 MONTHS"}.get(grain, f"INTERVAL 1 {grain.upper()}"))
    ends = df.groupBy(*partition).agg(F.min(order).alias("__a"), F.max(order).alias("__b")) if partition else df.agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    every = ends.filter("__a is not null").select(*partition, F.explode(F.sequence("__a", "__b", step)).alias(order))
    on = reduce(Column.__and__, [F.col(f"e.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*partition, order]])
    rest = [c for c in df.columns if c not in partition and c != order]
    return every.alias("e").join(df.alias("d"), on, "left").select(*[F.col(f"e.{c}") for c in [*partition, order]], *[F.col(f"d.{c}") for c in rest]).select(*df.columns)


def windowed(df: DataFrame, name: str, of: str, method: str, order: str, partition: list[str], fn: str = "avg", frame: int | None = None, offset: int | None = None, weight: str | None = None, buckets: bool = False) -> DataFrame:
    """Adds a window over aggregated rows.

    simple: fn of the last `frame` rows; weighted: sum of `of` over sum of `weight`; cumulative:
    fn of all rows up to this one; lag, lead: the value `offset` rows away. A count rolls as a sum;
    of distinct counts, with `buckets`, the buckets that have one are counted (rolling_distinct counts values).
    """
    if method in ("simple", "weighted") and not frame:
        raise ValueError(f"{method} needs a frame")
    if method in ("lag", "lead") and not offset:
        raise ValueError(f"{method} needs an offset")
    if method == "weighted" and (weight is None or fn != "avg"):
        raise ValueError("weighted needs avg and a weight")
    if fn == "count_distinct" and not buckets:
        raise ValueError("distinct counts of buckets can't be rolled up; buckets=True counts buckets")
    w = Window.partitionBy(*partition).orderBy(order)
    fns = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.sum, "count_distinct": F.count}
    if method == "lag":
        c = F.lag(of, offset).over(w)
    elif method == "lead":
        c = F.lead(of, offset).over(w)
    else:
        rows = w.rowsBetween(Window.unboundedPreceding if method == "cumulative" else 1 - frame, 0)
        if method == "weighted":
            c = F.try_divide(F.sum(of).over(rows).cast("double"), F.sum(weight).over(rows).cast("double"))
        elif method in ("simple", "cumulative"):
            c = fns[fn](of).over(rows)
        else:
            raise ValueError(f"unknown window method {method!r}")
    return df.withColumn(name, c)


def window_keys(slices: list[str], unit: str, grain: dict[str, str]) -> tuple[str, list[str]]:
    """(order, partition): a time unit orders by the slice of that grain; 'rows' by the last of at least two slices."""
    if unit == "rows":
        if len(slices) < 2:
            raise ValueError("unit rows needs two slices")
        return slices[-1], slices[:-1]
    found = [s for s in slices if grain.get(s) == unit]
    if not found:
        raise ValueError(f"no slice of grain {unit!r}")
    return found[0], [s for s in slices if s != found[0]]


def page(df: DataFrame, number: int = 1, size: int = 100, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of a page, one row with the total and whether rows were cut off); `key` makes the order total."""
    rows = (df.orderBy(*[order_key(k) for k in key]) if key else df).offset((number - 1) * size).limit(size)
    total = df.agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > number * size)
    return rows, total


@dataclass(frozen=True)
class Envelope:
    """A page of a query's rows: their columns without prefixes, the rows, and one row with total and truncated."""

    columns: list[str]
    rows: DataFrame
    total: DataFrame


def envelope(df: DataFrame, number: int = 1, size: int = 100, key: list[str] | None = None) -> Envelope:
    """A page with columns named by what follows their last dot; where two would share a name, both keep their prefix."""
    short = [c.rpartition(".")[2] for c in df.columns]
    names = [s if short.count(s) == 1 else c for s, c in zip(short, df.columns, strict=True)]
    rows, total = page(df, number, size, key)
    return Envelope(names, rows.toDF(*names), total)


def apply_params(filters: list[tuple[str, Callable[[object], Callable]]], defaults: dict[str, object], values: dict[str, object]) -> list:
    """Filters (parameter, value -> filter): a given value, else its default, else the filter goes; '' is no value."""
    out = []
    for name, make in filters:
        value = values.get(name)
        value = defaults.get(name) if value in (None, "") else value
        if value not in (None, ""):
            out.append(make(value))
    return out


def check_time_slice(model: Model, root: str, path: str, pattern: str | None, quiet: bool = False) -> None:
    """A timestamp slice needs a time pattern, another mustn't have one. quiet: leave paths that aren't plain relations alone."""
    *hops, name = path.split(".")
    at = root
    for hop in hops[1:] if hops and hops[0] == root else hops:
        try:
            at = model.relation(at, hop).target
        except ValueError:
            if quiet:
                return
            raise
        if at not in model.entities:
            return
    is_time = name in model.entity(at).timestamps
    if is_time and not pattern:
        raise ValueError(f"{path} is a timestamp and needs a time pattern")
    if pattern and not is_time:
        raise ValueError(f"{path} isn't a timestamp")
