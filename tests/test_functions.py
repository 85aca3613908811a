import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scalars as fn


def one(spark, c, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(c.alias("x")).first().x


def ulid(seed):
    n, out = int.from_bytes(hashlib.sha256(seed.encode()).digest()[:16], "big"), ""
    for _ in range(26):
        out, n = fn.CROCKFORD[n % 32] + out, n // 32
    return out


def test_iso_year_boundary(spark):
    t = F.to_timestamp(F.lit("2021-01-01 10:59:00"))
    assert one(spark, fn.format_time(t, "YYYY-WW")) == "2020-53"
    assert one(spark, fn.format_time(t, "YYYY-MM")) == "2020-01"
    assert one(spark, fn.format_time(t, "YYYY-MM", calendar=True)) == "2021-01"
    assert fn.grain_of("YYYY-MM-DD") == "day" and fn.grain_of("YYYY-MM") == "month"


def test_datetime_diff(spark):
    a, b = F.to_timestamp(F.lit("2024-01-01 10:59:00")), F.to_timestamp(F.lit("2024-01-01 11:01:00"))
    assert one(spark, fn.datetime_diff(a, b, "hours", "boundary")) == 1
    assert abs(one(spark, fn.datetime_diff(a, b, "hours")) - 2 / 60) < 1e-12
    assert one(spark, fn.datetime_diff(b, a, "days")) == 0
    with pytest.raises(ValueError):
        fn.datetime_diff(a, b, "moons")


def test_iso_text(spark):
    assert str(one(spark, fn.parse_ts(F.lit("2024-01-10T10:00:00.123+05:00")))) == "2024-01-10 10:00:00"
    assert one(spark, fn.parse_ts(F.lit("yesterday"))) is None


@pytest.mark.parametrize("seed", ["", "a", "Jira:42", "héé"])
def test_ulid(spark, seed):
    assert one(spark, fn.ulid(F.lit(seed))) == ulid(seed) and re.fullmatch("[0-9A-Z]{26}", ulid(seed))


@pytest.mark.parametrize("raw, snake, title", [("they're here", "THEY_RE_HERE", "They'Re Here"), (" fooBar-baz ", "FOO_BAR_BAZ", " Foobar-Baz "), ("a1b", "A1B", "A1B"), ("__x__", "X", "__X__")])
def test_text_cases(spark, raw, snake, title):
    assert one(spark, fn.upper_snake(F.lit(raw))) == snake and one(spark, fn.title(F.lit(raw))) == title


def test_json(spark):
    objects = F.lit('[{"field":"status","to":"Done"},{"field":"x"}]')
    assert one(spark, fn.json_find(objects, "field", "status", "to")) == "Done"
    assert one(spark, fn.json_find(objects, "field", "none", "to")) is None
    assert one(spark, fn.json_any(objects, "field", "x")) and not one(spark, fn.json_any(F.lit(None).cast("string"), "field", "x"))
    assert one(spark, fn.json_contains(F.lit('["a","b"]'), "b")) and one(spark, fn.json_contains(F.lit(None).cast("string"), "b")) is False
    assert one(spark, fn.json_contains(F.lit("[]"), "b")) is False
    assert one(spark, fn.json_extract(F.lit('{"a.b": 1}'), "a.b")) == "1"
    assert one(spark, fn.json_has_key(F.lit('{"a": null}'), "a")) is False


def test_coerce_text(spark):
    for raw, text in (('{"value":"v","id":1}', "v"), ('{"name":"n"}', "n"), ('[{"name":"a"},{"value":"b"},"c"]', "a, b, c"), ("plain", "plain"), ("[]", "")):
        assert one(spark, fn.coerce_text(F.lit(raw))) == text


def test_enum_cast_default(spark):
    m = {"DONE": ["done", "closed"], "OPEN": ["new"]}
    assert [one(spark, fn.enum(F.lit(v).cast("string"), m)) for v in ("closed", "new", "odd", None)] == ["DONE", "OPEN", None, None]
    assert one(spark, fn.cast_to(F.lit("x1"), "integer")) is None and one(spark, fn.cast_to(F.lit("YES"), "boolean")) is True
    assert one(spark, fn.default(F.lit(None).cast("int"), 3)) == 3
    assert one(spark, fn.regex_extract(F.lit("abc"), "[0-9]+")) is None


@pytest.mark.parametrize("value, pattern, text", [(1234567.0, "#,##0.0", "1,234,567.0"), (1234567.0, "0.0a", "1.2M"), (1500.0, "0.0a", "1.5k"), (12.0, "0.0a", "12.0"), (999.5, "#,##0", "1,000")])
def test_numbers(spark, value, pattern, text):
    assert one(spark, fn.display_number(F.lit(value), pattern)) == text


def test_durations(spark):
    assert [one(spark, fn.display_hours(F.lit(h))) for h in (36.0, 2.5, 0.5, 0.01)] == ["1.5d", "2.5h", "30m", "36s"]


def test_registry(spark):
    assert one(spark, fn.REGISTRY.call("TRIM", F.lit(" a "))) == "a"
    assert one(spark, fn.REGISTRY.call("substr", F.lit("abc"), F.lit(2))) == "bc"
    with pytest.raises(ValueError):
        fn.REGISTRY.call("trim")


def test_nulls_and_roundings_of_displays(spark):
    df = spark.createDataFrame([(None,), (999_999.0,), (999.6,), (1234.0,), (-2_500_000.0,)], "x double")
    got = [tuple(r) for r in df.select(fn.display_number(F.col("x"), "#,##0.0a"), fn.display_number(F.col("x"), "0"), fn.display_percent(F.col("x"))).collect()]
    assert got[0] == (None, None, None) and [g[0] for g in got[1:]] == ["1.0M", "999.6", "1.2k", "-2.5M"]


def test_plain_text_like_json_and_enum_failures(spark):
    df = spark.createDataFrame([("[WIP] fix",), ("{draft",), ('["a","b"]',), ('{"name":"n"}',), (None,), ("[1, 2",)], "x string")
    assert [r[0] for r in df.select(fn.coerce_text(F.col("x"))).collect()] == ["[WIP] fix", "{draft", "a, b", "n", None, "[1, 2"]
    kinds = spark.createDataFrame([("v",), ("?",), (None,)], "x string").select(fn.enum(F.col("x"), {"view": ["v"]}).alias("e"), fn.enum_fails(F.col("x"), {"view": ["v"]}).alias("f"))
    assert [tuple(r) for r in kinds.collect()] == [("view", False), (None, True), (None, False)]


def test_registry_knows_the_library(spark):
    call = fn.REGISTRY.call
    df = spark.createDataFrame([("2021-01-01T10:00:00Z", '{"a": 1}')], "t string, j string")
    ts = call("parse_ts", F.col("t"))
    got = df.select(call("format_time", ts, "YYYY-WW"), call("json_extract", F.col("j"), "a"), call("datetime_diff", ts, call("now", F.lit("2021-01-02").cast("timestamp")), "hours"), call("cast", F.lit("yes"), "boolean")).first()
    assert tuple(got) == ("2020-53", "1", 14.0, True)
    with pytest.raises(ValueError):
        call("format_time", ts)
