"""Scalar functions: times, texts, JSON, formats and hashes. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
#: Times in ISO text are cut to these many characters: no fraction, no zone.
ISO_CHARS = 19


def parse_ts(c: Column) -> Column:
    """Timestamp of ISO text, null if it is none (Spark's own words for days, such as 'today', aren't)."""
    text = F.substring(c.cast("string"), 1, ISO_CHARS)
    return F.when(text.rlike(r"^\s*\d"), F.try_to_timestamp(text))


def datetime_diff(start: Column, end: Column, unit: str = "hours", mode: str = "elapsed") -> Column:
    """end - start. elapsed: fractional, whole days; boundary: unit borders crossed. years elapsed are of 365.25 days."""
    if mode == "boundary":
        name = unit.rstrip("s").upper()
        cut = lambda c: F.date_trunc(name, c)
        return F.timestamp_diff(name, cut(start), cut(end))
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    if unit == "years":
        return micros / (1e6 * 86400 * 365.25)
    if unit not in SECONDS:
        raise ValueError(f"unknown unit {unit!r}")
    out = micros / (1e6 * SECONDS[unit])
    return F.when(out >= 0, F.floor(out)).otherwise(F.ceil(out)).cast("long") if unit == "days" else out


def _tokens(pattern: str, known: tuple[str, ...]) -> list[str]:
    out, at = [], 0
    while at < len(pattern):
        hit = next((t for t in known if pattern.startswith(t, at)), pattern[at])
        out.append(hit)
        at += len(hit)
    return out


_DATE = ("yyyy", "yy", "MMMM", "MMM", "MM", "DDD", "dd", "EEEE", "E", "HH", "mm", "ss")


def format_date(ts: Column, pattern: str) -> Column:
    """yyyy yy MMMM MMM MM DDD dd EEEE E HH mm ss; other characters stand for themselves."""
    return F.concat(*[F.date_format(ts, t) if t in _DATE else F.lit(t) for t in _tokens(pattern, _DATE)])


def format_time(ts: Column, pattern: str, calendar: bool = False) -> Column:
    """YYYY WW MM DD HH. YYYY is the ISO year, or the calendar's."""
    iso = F.date_part(F.lit("YEAROFWEEK"), ts).cast("int")
    parts = {"YYYY": F.format_string("%04d", F.year(ts) if calendar else iso), "WW": F.format_string("%02d", F.weekofyear(ts)), "MM": F.date_format(ts, "MM"), "DD": F.date_format(ts, "dd"), "HH": F.date_format(ts, "HH")}
    return F.when(ts.isNotNull(), F.concat(*[parts.get(t, F.lit(t)) for t in _tokens(pattern, tuple(parts))]))


def grain_of(pattern: str) -> str | None:
    """Window grain of a format_time pattern."""
    return next((g for t, g in (("WW", "week"), ("DD", "day"), ("MM", "month"), ("YYYY", "year")) if t in pattern), None)


def bucket(ts: Column, grain: str) -> Column:
    """Start of the timestamp's day, week, month, quarter or year."""
    return F.date_trunc(grain, ts)


def now(as_of: Column | None = None) -> Column:
    """The current time, or the one that the caller fixes so that results can be repeated."""
    return F.current_timestamp() if as_of is None else as_of


def relative(as_of: Column, amount: int, unit: str) -> Column:
    """as_of moved by days (d) or weeks (w)."""
    return as_of + F.make_interval(days=F.lit(amount * {"d": 1, "w": 7}[unit]))


def trim_all(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def title(c: Column) -> Column:
    """A letter after anything but a letter is upper case, others lower."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def upper_snake(c: Column) -> Column:
    plain = F.regexp_replace(trim_all(c), r"[^a-zA-Z0-9]+", "_")
    return F.regexp_replace(F.upper(F.regexp_replace(plain, r"([a-z])([A-Z])", "$1_$2")), r"^_+|_+$", "")


def regex_extract(c: Column, pattern: str) -> Column:
    """First whole match, or null."""
    return F.regexp_substr(c, F.lit(pattern))


def cast_to(c: Column, kind: str) -> Column:
    """string, integer, float, boolean (text: true, 1, yes), date, datetime (both stay text); null where it can't be read."""
    if kind == "integer":
        return c.try_cast("long")
    if kind == "float":
        return c.try_cast("double")
    if kind == "boolean":
        return F.lower(c.cast("string")).isin("true", "1", "yes")
    if kind in ("string", "date", "datetime"):
        return c.cast("string")
    raise ValueError(f"unknown type {kind!r}")


def default(c: Column, value) -> Column:
    return F.coalesce(c, value if isinstance(value, Column) else F.lit(value))


def if_not_null(check: Column, value: Column) -> Column:
    return F.when(check.isNotNull(), value)


def enum_fails(c: Column, mapping: dict[str, list[str]]) -> Column:
    """c isn't null and no name's raw values hold it."""
    return c.isNotNull() & enum(c, mapping).isNull()


def enum(c: Column, mapping: dict[str, list[str]]) -> Column:
    """The canonical name whose raw values hold c; null for null, and for an unknown value, of which enum_fails tells."""
    pairs = [x for name, raws in mapping.items() for raw in raws for x in (F.lit(raw), F.lit(name))]
    return F.element_at(F.create_map(*pairs), c)


# The 32 digits of Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(seed: Column) -> Column:
    """A stable 26-digit id: the first 128 bits of the seed's SHA-256 in base 32, two zero bits in front."""
    hexa = F.sha2(seed.cast("string"), 256)
    bits = F.concat(F.lit("00"), *[F.lpad(F.conv(F.substring(hexa, 1 + 8 * k, 8), 16, 2), 32, "0") for k in range(4)])
    digits = lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(25)), lambda k: F.substr(F.lit(CROCKFORD), F.conv(F.substr(b, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")
    # The bits stand in an array of one, so that the digits share one evaluation of them.
    return F.when(seed.isNotNull(), F.element_at(F.transform(F.array(bits), digits), 1))


def json_extract(c: Column, key: str) -> Column:
    """One top-level key, dots taken literally."""
    return F.get_json_object(c, f"$['{key}']")


def json_has_key(c: Column, key: str) -> Column:
    return F.coalesce(json_extract(c, key).isNotNull(), F.lit(False))


def json_list(c: Column) -> Column:
    return F.from_json(c, "array<string>")


def json_find(c: Column, match_key: str, match_value: str, want: str) -> Column:
    """`want` of the first object of a JSON array whose match_key is match_value."""
    return F.get(F.filter(F.from_json(c, "array<map<string,string>>"), lambda m: F.get(F.array(m[match_key]), F.lit(0)) == match_value), F.lit(0))[want]


def json_contains(c: Column, value) -> Column:
    """A JSON array column holds the value; null column: false."""
    return F.coalesce(F.array_contains(json_list(c), F.lit(str(value))), F.lit(False))


def json_contains_any(c: Column, values: list) -> Column:
    return F.coalesce(F.arrays_overlap(json_list(c), F.array(*[F.lit(str(v)) for v in values])), F.lit(False))


def json_any(c: Column, field: str, value) -> Column:
    """Some object of a JSON array has field = value, compared as text."""
    return F.coalesce(F.exists(F.from_json(c, "array<map<string,string>>"), lambda m: F.coalesce(m[field] == str(value), F.lit(False))), F.lit(False))


def coerce_text(c: Column) -> Column:
    """Text of a JSON value: of an object its value, else its name; of a list its items, joined by a comma and a blank; other text as it is, also such as begins like a list."""
    one = lambda x: F.coalesce(F.get_json_object(x, "$.value"), F.get_json_object(x, "$.name"), x)
    many = F.array_join(F.transform(json_list(c), one), ", ")
    return F.coalesce(F.when(c.startswith("["), many), one(c))


def display_number(c: Column, pattern: str) -> Column:
    """'#,##0.0' and the like; a final 'a' abbreviates to k and M, by the number as shown. Null stays null."""
    base = pattern.removesuffix("a")
    decimals = len(base.rpartition(".")[2]) if "." in base else 0
    fmt = f"%{',' if ',' in base else ''}.{decimals}f"
    x = c.cast("double")
    if not pattern.endswith("a"):
        return F.when(c.isNotNull(), F.format_string(fmt, x))
    shown = lambda unit: F.abs(F.round(x / unit, decimals))
    return F.when(shown(1e3) >= 1e3, F.format_string(fmt + "M", x / 1e6)).when(shown(1.0) >= 1e3, F.format_string(fmt + "k", x / 1e3)).when(c.isNotNull(), F.format_string(fmt, x))


def display_percent(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c * 100.0))


def display_hours(c: Column) -> Column:
    """A duration in hours as days, hours, minutes or seconds."""
    return (
        F.when(c >= 24, F.format_string("%.1fd", c / 24.0))
        .when(c >= 1, F.format_string("%.1fh", c.cast("double")))
        .when(c >= 1 / 60, F.concat(F.round(c * 60).cast("long").cast("string"), F.lit("m")))
        .when(c.isNotNull(), F.concat(F.round(c * 3600).cast("long").cast("string"), F.lit("s")))
    )


def content_hash(*columns: Column) -> Column:
    """SHA-256 of one column's text, or of a row as JSON."""
    return F.sha2(columns[0].cast("string"), 256) if len(columns) == 1 else F.sha2(F.to_json(F.struct(*columns)), 256)


@dataclass(frozen=True)
class _Entry:
    build: Callable[..., Column]
    least: int
    most: int | None


class Registry:
    """Functions by name, their number of arguments checked; an unknown name falls to Spark's own functions."""

    def __init__(self):
        self.entries: dict[str, _Entry] = {}

    def register(self, name: str, build: Callable[..., Column], least: int = 0, most: int | None = None) -> None:
        self.entries[name.lower()] = _Entry(build, least, most)

    def call(self, name: str, *args: Column) -> Column:
        entry = self.entries.get(name.lower())
        if entry is None:
            return F.call_function(name, *args)
        if len(args) < entry.least or (entry.most is not None and len(args) > entry.most):
            raise ValueError(f"{name} takes {entry.least} to {entry.most} arguments, not {len(args)}")
        return entry.build(*args)


REGISTRY = Registry()
for _name, _build, _n in (("trim", trim_all, 1), ("title", title, 1), ("lower", F.lower, 1), ("upper_snake", upper_snake, 1), ("ulid", ulid, 1), ("content_hash", content_hash, 1), ("default", default, 2), ("if_not_null", if_not_null, 2)):
    REGISTRY.register(_name, _build, _n, _n)
REGISTRY.register("concat", lambda *c: F.concat(*c), 1)
REGISTRY.register("coalesce", lambda *c: F.coalesce(*c), 1)
REGISTRY.register("now", lambda *c: now(*c), 0, 1)
# Of these the arguments after the first are plain values, not columns.
for _name, _build, _least, _most in (("datetime_diff", datetime_diff, 2, 4), ("format_date", format_date, 2, 2), ("format_time", format_time, 2, 3), ("bucket", bucket, 2, 2), ("relative", relative, 3, 3), ("regex_extract", regex_extract, 2, 2), ("cast", cast_to, 2, 2), ("enum", enum, 2, 2), ("json_extract", json_extract, 2, 2), ("json_has_key", json_has_key, 2, 2), ("json_find", json_find, 4, 4), ("json_contains", json_contains, 2, 2), ("json_contains_any", json_contains_any, 2, 2), ("json_any", json_any, 3, 3), ("round", F.round, 1, 2), ("parse_ts", parse_ts, 1, 1), ("display_number", display_number, 2, 2), ("display_percent", display_percent, 1, 1), ("display_hours", display_hours, 1, 1)):
    REGISTRY.register(_name, _build, _least, _most)


def register_sql(spark: SparkSession, name: str, body: str, arguments: str, returns: str) -> None:
    """A SQL function for raw-SQL features: stays in the JVM."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
