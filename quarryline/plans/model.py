"""Entities, their relations, and a model that binds them to DataFrames."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """An edge to another entity.

    kind: m2o (via is this side's foreign key), o2m (via is this side's key and via_target the
    child's foreign key), or dynamic (type_col names the entity that via points into).
    """

    name: str
    target: str = ""
    via: tuple[str, ...] = ()
    via_target: tuple[str, ...] = ()
    kind: str = "m2o"
    type_col: str = ""


@dataclass(frozen=True)
class Entity:
    """A named table with a key; history names its (valid_from, valid_to) columns."""

    name: str
    key: str
    relations: tuple[Relation, ...] = ()
    history: tuple[str, str] | None = None
    timestamps: tuple[str, ...] = ()


@dataclass
class Model:
    entities: dict[str, Entity]
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, *pairs: tuple[Entity, DataFrame]) -> Model:
        return cls({e.name: e for e, _ in pairs}, {e.name: df for e, df in pairs})

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise ValueError(f"unknown entity {name!r}")
        return self.entities[name]

    def table(self, name: str) -> DataFrame:
        self.entity(name)
        return self.tables[name]

    def current(self, name: str) -> DataFrame:
        """The entity's table, its open rows only if it has history."""
        e = self.entity(name)
        return self.table(name).filter(is_open(F.col(e.history[1]))) if e.history else self.table(name)

    def fields(self, name: str) -> list[str]:
        return self.table(name).columns

    def relation(self, source: str, hop: str) -> Relation:
        """The relation of `source` called `hop`, or leading to the entity `hop`, or the inverse of the child's m2o."""
        e = self.entity(source)
        for r in e.relations:
            if r.name == hop:
                return r
        to = [r for r in e.relations if r.target == hop]
        if len(to) > 1:
            raise ValueError(f"{source} has several relations to {hop}: {[r.name for r in to]}")
        if to:
            return to[0]
        if hop in self.entities:
            back = [r for r in self.entities[hop].relations if r.target == source and r.kind == "m2o"]
            if len(back) == 1:
                return Relation(hop, hop, (e.key,) * len(back[0].via), back[0].via, "o2m")
        raise ValueError(f"{source} has no relation {hop!r}")

    def path(self, source: str, target: str) -> list[str]:
        """Names of the fewest m2o hops from source to target, in declaration order among equals."""
        todo, seen = deque([(source, [])]), {source}
        while todo:
            at, hops = todo.popleft()
            if at == target:
                return hops
            for r in self.entity(at).relations:
                if r.kind == "m2o" and r.target not in seen:
                    seen.add(r.target)
                    todo.append((r.target, [*hops, r.name]))
        raise ValueError(f"no many-to-one path from {source} to {target}")

    def child_field(self, source: str, name: str) -> tuple[Relation, str]:
        """The one-to-many relation, and its field, that a bare name means; of a relation's own name, the child's key."""
        many = [r for r in self.entity(source).relations if r.kind == "o2m"]
        for r in many:
            if r.name == name:
                return r, self.entity(r.target).key
        found = [r for r in many if name in self.fields(r.target)]
        if len(found) != 1:
            raise ValueError(f"{name!r} is in {len(found)} children of {source}")
        return found[0], name

    def with_event(self, parent: str, name: str, key: str, rows: DataFrame, timestamps: tuple[str, ...] = ()) -> Model:
        """The model with an event table of `parent`: `key` in rows is the parent's key. It is the entity <Parent><Name>Event and the relation <parent>.<name>."""
        e = self.entity(parent)
        child = f"{parent}{name[:1].upper()}{name[1:]}Event"
        if child in self.entities or any(r.name == name for r in e.relations):
            raise ValueError(f"{parent} has {name!r} already")
        grown = replace(e, relations=(*e.relations, Relation(name, child, (e.key,), (key,), "o2m")))
        own = Entity(child, key, (Relation(f"of_{parent}", parent, (key,)),), timestamps=timestamps)
        return Model({**self.entities, parent: grown, child: own}, {**self.tables, child: rows})

    def check(self) -> None:
        """Each key and foreign key exists; history has both columns; targets exist."""
        for e in self.entities.values():
            have = set(self.fields(e.name))
            if e.key not in have:
                raise ValueError(f"{e.name}: no key column {e.key!r}")
            if e.history and not set(e.history) <= have:
                raise ValueError(f"{e.name}: history needs columns {e.history}")
            for r in e.relations:
                if not set(r.via) <= have or (r.kind == "dynamic" and r.type_col not in have):
                    raise ValueError(f"{e.name}.{r.name}: missing column")
                if r.kind != "dynamic" and r.target not in self.entities:
                    raise ValueError(f"{e.name}.{r.name}: unknown entity {r.target!r}")


def is_open(valid_to: Column) -> Column:
    """An open row of history: no end, as null or empty text."""
    return valid_to.isNull() | (valid_to.cast("string") == "")
