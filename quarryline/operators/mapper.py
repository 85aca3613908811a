"""Mapping raw tables to entities: sources, joins, first values across sources, several targets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import at_path
from .joins import array_items
from .load import check_fan_out, keep_first, load_stats, map_rows, merge_groups, prune, upsert


@dataclass(frozen=True)
class Source:
    """A table, or the union of several on `columns`, under an alias.

    where filters before the dedupe; dedupe keeps one row per key, the first by all columns; static adds constants.
    """

    alias: str
    tables: tuple[str, ...]
    columns: tuple[str, ...] = ()
    where: Column | None = None
    dedupe: tuple[str, ...] = ()
    static: dict[str, object] = field(default_factory=dict)

    def read(self, tables: dict[str, DataFrame]) -> DataFrame:
        missing = [t for t in self.tables if t not in tables]
        if missing or not self.tables:
            raise ValueError(f"{self.alias}: no such tables: {missing}")
        parts = [tables[t].select(*self.columns) if self.columns else tables[t] for t in self.tables]
        df = reduce(DataFrame.unionByName, parts)
        df = df.filter(self.where) if self.where is not None else df
        if self.dedupe:
            df = keep_first(df, list(self.dedupe), [F.col(c).asc_nulls_last() for c in df.columns])
        return df.withColumns({c: F.lit(v) for c, v in self.static.items()})


@dataclass(frozen=True)
class On:
    """One condition of a join: the left 'alias.column', after `prefix`, against the own column, or the JSON at its `path`.

    holds: equal; json_array: an array with the left value in it; scalar_or_array: either.
    """

    left: str
    own: str
    holds: str = "equal"
    prefix: str = ""
    path: str = ""


@dataclass(frozen=True)
class Join:
    """A source joined left or inner on conditions that all hold; a pair (left, own) is a condition of the kind `holds`."""

    alias: str
    on: tuple[On | tuple[str, str], ...]
    how: str = "left"
    holds: str = "equal"

    def conditions(self) -> list[On]:
        out = [c if isinstance(c, On) else On(*c, self.holds) for c in self.on]
        unknown = {c.holds for c in out} - {"equal", "json_array", "scalar_or_array"}
        if unknown or not out:
            raise ValueError(f"{self.alias}: unknown conditions {sorted(unknown)}" if unknown else f"{self.alias}: a join needs a condition")
        return out


@dataclass(frozen=True)
class Rows:
    """A group of a target's rows with a grain, joins and columns of its own."""

    grain: Source
    columns: dict[str, Callable[[Joined], Column]]
    joins: tuple[tuple[Source, Join], ...] = ()


@dataclass(frozen=True)
class Target:
    """Columns of one target by callables of Joined; `required` columns and `fails` conditions set rows aside.

    With `rows`, the target's rows come from these groups instead of the mapper's joins; where groups have the same
    `key`, each column has the first group's value that isn't empty.
    """

    name: str
    columns: dict[str, Callable[[Joined], Column]]
    required: tuple[str, ...] = ()
    fails: dict[str, Callable[[Joined], Column]] = field(default_factory=dict)
    static: dict[str, object] = field(default_factory=dict)
    rows: tuple[Rows, ...] = ()
    key: tuple[str, ...] = ()

    def failed(self, resolve: Joined) -> Column:
        """Whether a joined row fails in any column."""
        bad = [self.columns[c](resolve).isNull() for c in self.required] + [F.coalesce(when(resolve), F.lit(False)) for when in self.fails.values()]
        return reduce(Column.__or__, bad, F.lit(False))


class Joined:
    """Columns of the joined sources: j['alias.column'], or j['column'], the first that isn't null in the sources' order."""

    def __init__(self, columns: dict[str, list[str]]):
        self.columns = columns

    def __getitem__(self, name: str) -> Column:
        alias, dot, column = name.partition(".")
        if dot and alias in self.columns:
            if column not in self.columns[alias]:
                raise ValueError(f"{alias} has no column {column!r}")
            return F.col(f"{alias}__{column}")
        found = [F.col(f"{a}__{name}") for a, have in self.columns.items() if name in have]
        if not found:
            raise ValueError(f"no source has a column {name!r}")
        return F.coalesce(*found)


def join_sources(tables: dict[str, DataFrame], grain: Source, joins: list[tuple[Source, Join]] = ()) -> tuple[DataFrame, Joined]:
    """The grain source with the others joined, columns named alias__column, and the resolver of its columns."""
    read = lambda s: (lambda df: (df.select(*[F.col(c).alias(f"{s.alias}__{c}") for c in df.columns]), df.columns))(s.read(tables))
    out, columns = read(grain)
    have = {grain.alias: columns}
    for source, join in joins:
        if source.alias in have:
            raise ValueError(f"two sources are called {source.alias!r}")
        if join.how not in ("left", "inner"):
            raise ValueError(f"unknown join {join.how!r}")
        right, columns = read(source)
        resolve = Joined(have)
        conditions, items = [], []
        for k, c in enumerate(join.conditions()):
            mine, left = F.col(f"{source.alias}__{c.own}"), resolve[c.left]
            mine = at_path(mine, c.path.removeprefix("$.")) if c.path else mine
            left = F.concat(F.lit(c.prefix), left.cast("string")) if c.prefix else left
            if c.holds == "equal":
                conditions.append(left == mine)
            else:
                items.append(f"__item{k}")
                right = right.withColumn(items[-1], F.explode(array_items(mine, scalars=c.holds == "scalar_or_array")))
                conditions.append(left.cast("string") == F.col(items[-1]))
        out = out.join(right, conditions, join.how).drop(*items)
        have[source.alias] = columns
    return out, Joined(have)


def run_mapper(tables: dict[str, DataFrame], grain: Source, joins: list[tuple[Source, Join]], targets: list[Target], grain_key: list[str] = (), strict: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Per target (good, bad) rows. With grain_key, a join that repeats rows of the grain is an error; with strict, a row that fails."""
    rows, resolve = join_sources(tables, grain, joins)
    if grain_key:
        check_fan_out([f"{grain.alias}__{c}" for c in grain_key], rows)
    if strict:
        failed = [r.target for r in stats(tables, grain, joins, targets).filter("failed > 0").collect()]
        if failed:
            raise ValueError(f"rows failed in {sorted(failed)}")
    out = {}
    for t in targets:
        if t.rows:
            out[t.name] = _grouped(tables, t)
        else:
            out[t.name] = map_rows(rows, *_mapping(t, t.columns, resolve))
    return out


def _mapping(t: Target, columns: dict, resolve: Joined) -> tuple:
    return {c: make(resolve) for c, make in columns.items()}, [c for c in t.required if c in columns], dict(t.static), {c: when(resolve) for c, when in t.fails.items()}


def _grouped(tables: dict[str, DataFrame], t: Target) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a target made of row groups: good rows merged by key, bad ones with the columns of their group's sources."""
    if not t.key:
        raise ValueError(f"{t.name}: row groups need a key")
    good, bad = [], []
    for k, g in enumerate(t.rows):
        rows, resolve = join_sources(tables, g.grain, list(g.joins))
        fine, wrong = map_rows(rows, *_mapping(t, g.columns, resolve))
        good.append(fine)
        bad.append(wrong.withColumn("group", F.lit(k)))
    return merge_groups(good, list(t.key)), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bad)


def stats(tables: dict[str, DataFrame], grain: Source, joins: list[tuple[Source, Join]], targets: list[Target]) -> DataFrame:
    """(target, written, failed) of each target, counted in one pass over the joined rows; targets of row groups in one over theirs."""
    own = [t for t in targets if not t.rows]
    parts = [load_stats({t.name: _grouped(tables, t)}) for t in targets if t.rows]
    if own:
        rows, resolve = join_sources(tables, grain, joins)
        row = rows.agg(*[F.count_if(t.failed(resolve)).alias(f"f{k}") for k, t in enumerate(own)], F.count(F.lit(1)).alias("n"))
        each = F.array(*[F.struct(F.lit(t.name).alias("target"), (F.col("n") - F.col(f"f{k}")).alias("written"), F.col(f"f{k}").alias("failed")) for k, t in enumerate(own)])
        parts.insert(0, row.select(F.inline(each)))
    return reduce(DataFrame.unionByName, parts)


def load_target(existing: DataFrame, good: DataFrame, bad: DataFrame, key: list[str], order: Column, prune_missing: bool = False) -> DataFrame:
    """existing after an upsert of a target's good rows; with prune_missing, without the keys that it no longer gives, unless any row failed."""
    loaded = upsert(existing, good, key, order)
    return prune(loaded, good, key, bad) if prune_missing else loaded
