"""Nested records to flat raw tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import coerce_text


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One record per document (or per line), as a column `record` of JSON text."""
    text = spark.read.text(path, wholetext=not lines)
    return text.select(F.col("value").alias("record")).filter(F.trim("record") != "")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns are text, named by the header."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_ownership(spark: SparkSession, path: str) -> DataFrame:
    """(pattern, owner) pairs of ownership files; comments, blank and ownerless lines give none."""
    return ownership_lines(spark.read.text(path).select("value"))


def ownership_lines(lines: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Of a column `value` of lines: (keep.., pattern, owner), one row per owner."""
    parts = F.split(F.trim("value"), r"\s+")
    return lines.filter(~F.trim("value").startswith("#")).select(*keep, parts.alias("p")).filter(F.size("p") >= 2).select(*keep, F.get("p", F.lit(0)).alias("pattern"), F.explode(F.slice("p", 2, 2147483647)).alias("owner"))


def at_path(record: Column, path: str) -> Column:
    """Value at a dotted path of JSON text; '$' is the whole record; objects and lists stay JSON text; missing is null."""
    return record if path == "$" else F.get_json_object(record, f"$.{path}")


def project(records: DataFrame, columns: dict[str, tuple[str, str]], context: dict[str, object] | None = None, record: str = "record", keep: Iterable[str] = ()) -> DataFrame:
    """Output column -> (path, type); types STRING, INTEGER, FLOAT, JSON. context adds constants."""
    kinds = {"STRING": coerce_text, "INTEGER": lambda c: c.try_cast("long"), "FLOAT": lambda c: c.try_cast("double"), "JSON": lambda c: c}
    for _, kind in columns.values():
        if kind not in kinds:
            raise ValueError(f"unknown column type {kind!r}")
    out = [kinds[kind](at_path(F.col(record), path)).alias(name) for name, (path, kind) in columns.items()]
    return records.select(*keep, *out, *[F.lit(v).alias(k) for k, v in (context or {}).items()])


def explode_path(records: DataFrame, path: str, inherit: dict[str, str] | None = None, record: str = "record") -> DataFrame:
    """One row per element of the array at path, as `record`, with inherited fields of the parent; anything but an array gives no rows."""
    items = F.from_json(at_path(F.col(record), path), "array<string>")
    return records.select(*[at_path(F.col(record), p).alias(n) for n, p in (inherit or {}).items()], F.explode(items).alias("record"))


def fan_out(records: DataFrame, outputs: dict[str, dict[str, tuple[str, str]]]) -> dict[str, DataFrame]:
    """Several projections of the same records; persist `records` first if they are costly to make."""
    return {name: project(records, columns) for name, columns in outputs.items()}


def created_at(kind: Column, by_kind: dict[str, Column], other: Column) -> Column:
    """The time column that goes with an event's kind."""
    chain = None
    for name, c in by_kind.items():
        chain = F.when(kind == name, c) if chain is None else chain.when(kind == name, c)
    return F.coalesce(chain, other) if chain is not None else other


def id_from_url(url: Column) -> Column:
    """The integer at a url's end."""
    return F.regexp_extract(url, r"([^/]+)$", 1).try_cast("long")


def align(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the union of their columns; what one lacks is null there."""
    lacks = lambda a, b: a.withColumns({f.name: F.lit(None).cast(f.dataType) for f in b.schema if f.name not in a.columns})
    a = lacks(existing, new)
    return a, lacks(new, existing).select(*a.columns)


def export_tables(tables: dict[str, DataFrame], uri: str, kind: str = "parquet") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        writer.csv(f"{uri}/{name}", header=True) if kind == "csv" else writer.parquet(f"{uri}/{name}")


def import_table(spark: SparkSession, uri: str, name: str, kind: str = "parquet") -> DataFrame:
    return read_csv(spark, f"{uri}/{name}") if kind == "csv" else spark.read.parquet(f"{uri}/{name}")


def attach(spark: SparkSession, uri: str, alias: str, tables: Iterable[str]) -> None:
    """Temporary views alias_table on another dataset's tables."""
    for name in tables:
        spark.read.parquet(f"{uri}/{name}").createOrReplaceTempView(f"{alias}_{name}")


def replace_table(df: DataFrame, path: str) -> bool:
    """Replace the table at path, unless df is empty. Returns whether it was written.

    The new table is written beside the old one, which goes only when that has succeeded; so df may read it.
    """
    if df.isEmpty():
        return False
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(staged), hadoop(path)):
        raise OSError(f"the new table is at {staged}; it can't be moved to {path}")
    return True


def json_types(records: DataFrame, paths: dict[str, str], record: str = "record") -> dict[str, str]:
    """Column types by what the JSON values at the paths are, over all records in one pass.

    Whole numbers and booleans are long, numbers double, anything else, and paths without values, string; a mixture of
    kinds is string. Text stays text, whatever it looks like. A record that isn't JSON counts as null.
    """
    parsed = records.select(F.try_parse_json(record).alias("v"))
    kinds = parsed.agg(*[F.schema_of_variant_agg(F.try_variant_get("v", _variant_path(p), "variant")).alias(f"k{k}") for k, p in enumerate(paths.values())]).first()
    return {name: _column_type(kinds[k]) for k, name in enumerate(paths)}


def _variant_path(path: str) -> str:
    return "$" if path == "$" else "$" + "".join(f"['{key}']" for key in path.split("."))


def _column_type(kind: str | None) -> str:
    if kind in ("BIGINT", "BOOLEAN"):
        return "long"
    return "double" if kind is not None and kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")) else "string"


def project_typed(records: DataFrame, paths: dict[str, str], types: dict[str, str], record: str = "record", keep: Iterable[str] = ()) -> DataFrame:
    """The values at the paths as columns of the given types (see json_types); objects and lists are JSON text."""
    v = F.try_parse_json(record)
    of = lambda path, kind: at_path(F.col(record), path) if kind == "string" else F.try_variant_get(v, _variant_path(path), {"long": "bigint"}.get(kind, kind))
    return records.select(*keep, *[of(path, types[name]).alias(name) for name, path in paths.items()])


def widen(old: str, new: str) -> str:
    """The type that holds both: long within double, and text otherwise."""
    return old if old == new else "double" if {old, new} == {"long", "double"} else "string"


def append_typed(existing: DataFrame | None, records: DataFrame, paths: dict[str, str], record: str = "record") -> DataFrame:
    """existing with the records' rows: new paths are new columns, null in the rows before; a column that meets a wider type is widened, which the rows before follow.

    A column that has no values yet is text, and stays it; a path without values in this batch keeps the column's type.
    """
    found = json_types(records, paths, record)
    if existing is None:
        return project_typed(records, paths, found, record)
    have = {f.name: {"bigint": "long"}.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in existing.schema}
    empty = json_nulls(records, {n: p for n, p in paths.items() if n in have and found[n] == "string" and have[n] != "string"}, record)
    types = {n: have[n] if n in empty else widen(have[n], t) if n in have else t for n, t in found.items()}
    old = existing.withColumns({n: F.col(n).cast(types[n]) for n in types if n in have and types[n] != have[n]})
    old, new = align(old, project_typed(records, paths, types, record))
    return old.unionByName(new)


def json_nulls(records: DataFrame, paths: dict[str, str], record: str = "record") -> set[str]:
    """Names of the paths that have no value in any record."""
    if not paths:
        return set()
    row = records.agg(*[F.count(at_path(F.col(record), p)).alias(f"n{k}") for k, p in enumerate(paths.values())]).first()
    return {name for k, name in enumerate(paths) if row[k] == 0}


#: Text that is a number and is written like one: no leading zeros, plus sign, type suffix, or name of a number.
_WHOLE, _NUMBER = r"^(0|-?[1-9][0-9]{0,18})$", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def infer_types(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text columns (as of CSV) all of whose values are written as whole numbers become long, as numbers double; one pass. A column without values stays text.

    Codes stay text: leading zeros, signs, suffixes as in 1d, NaN and Infinity aren't numbers here. JSON has types of its own: json_types.
    """
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string" and (columns is None or f.name in columns)]
    if not text:
        return df
    fits = lambda c, kind: F.bool_and(F.col(c).rlike(_WHOLE if kind == "long" else _NUMBER) & F.col(c).try_cast(kind).isNotNull())
    row = df.agg(*[F.coalesce(fits(c, k), F.lit(False)).alias(f"{k}_{c}") for c in text for k in ("long", "double")]).first()
    return df.withColumns({c: F.col(c).cast("long" if row[f"long_{c}"] else "double") for c in text if row[f"double_{c}"]})


#: Column types of declared entity and raw tables.
DECLARED = {"STRING": "string", "INTEGER": "long", "FLOAT": "double", "JSON": "string"}


def declared_table(spark: SparkSession, columns: dict[str, str], event: bool = False, history: tuple[str, str] | None = None) -> DataFrame:
    """An empty table of declared columns; an event table has inserted_at too, one with history its two times."""
    unknown = {k for k in columns.values() if k not in DECLARED}
    if unknown:
        raise ValueError(f"unknown column types {sorted(unknown)}")
    fields = [f"`{c}` {DECLARED[k]}" for c, k in columns.items()]
    fields += [f"`{c}` string" for c in history or () if c not in columns] + ["inserted_at timestamp"] * event
    return spark.createDataFrame([], ", ".join(fields))


def active_humans(users: DataFrame, kind: Column, active: Column, human: str = "human") -> DataFrame:
    """Users of the human kind that are active; a null in either leaves a user out."""
    return users.filter(F.coalesce((kind == human) & active.cast("boolean"), F.lit(False)))
