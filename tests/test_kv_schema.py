import random
from decimal import Decimal

import pytest

from docquarry.functions import schema as js
from docquarry.operators import kv
from docquarry.plans.errors import EngineError


def table(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in rows], "key binary, value binary")


def got(df):
    return [(bytes(r.key), bytes(r.value)) for r in df.collect()]


def test_ranges(spark):
    rng = random.Random(1)
    rows = sorted({bytes(rng.choices([0, 1, 127, 255], k=rng.randrange(1, 5))): bytes([i % 256]) for i in range(150)}.items())
    t = table(spark, rng.sample(rows, len(rows)))
    for lower, upper in [(None, None), (b"\x01", b"\xff"), (b"\x7f\x00", None), (b"\xff", b"\x01"), (b"\x01", b"\x01")]:
        want = [r for r in rows if (lower is None or r[0] >= lower) and (upper is None or r[0] < upper)]
        assert got(kv.forward(t, lower, upper, 20)) == want[:20]
        assert got(kv.reverse(t, lower, upper, 20)) == want[::-1][:20]
    assert kv.exists(t, rows[3][0]) and not kv.exists(t, b"zzzzzz")
    assert got(kv.next_after(t, rows[3][0], 2)) == rows[4:6] and got(kv.seek(t, rows[3][0], 2)) == rows[3:5]
    assert kv.prefix_exists(t, b"\xff\xff") == any(k.startswith(b"\xff\xff") for k, _ in rows)
    assert sorted(got(kv.with_prefix(t, b"\x01"))) == [r for r in rows if r[0].startswith(b"\x01")]


def test_levels_logs_and_runs(spark, tmp_path):
    new, old = table(spark, [(b"a", b"2"), (b"b", None)]), table(spark, [(b"a", b"1"), (b"b", b"1"), (b"c", b"1")])
    assert sorted(got(kv.merged([new, old]))) == [(b"a", b"2"), (b"c", b"1")]
    log = kv.group_commit([[(b"x", b"1"), (b"x", b"2")], [(b"y", b"1"), (b"x", None)], [(b"y", b"3")]], 7)
    df = spark.createDataFrame([(s, o, bytearray(k), None if v is None else bytearray(v)) for s, o, k, v in log], "sequence long, ordinal int, key binary, value binary")
    assert got(kv.commits(df)) == [(b"y", b"3")]
    path = str(tmp_path / "run")
    root = kv.seal(old, path, "zstd", 2, bloom=True)
    assert got(kv.forward(kv.opened(spark, path, root), None, None, 9)) == [(b"a", b"1"), (b"b", b"1"), (b"c", b"1")]
    with pytest.raises(EngineError, match="CORRUPTION"):
        kv.opened(spark, path, "0" * 64)
    with pytest.raises(Exception, match="twice"):
        kv.seal(table(spark, [(b"k", b"1"), (b"k", b"2")]), str(tmp_path / "bad"))


def test_schema_subset():
    s = {
        "type": "object", "required": ["email"], "additionalProperties": False, "properties": {"email": {"type": "string", "format": "email", "maxLength": 30}, "age": {"type": "integer", "minimum": 0, "exclusiveMaximum": 150},
        "tags": {"type": "array", "items": {"enum": ["a", "b"]}, "uniqueItems": True}, "n": {"multipleOf": Decimal("0.01")}, "x": {"oneOf": [{"const": 1}, {"type": "string"}]}},
    }
    js.check_schema(s)
    for good in ({"email": "a@b"}, {"email": "a@b", "age": Decimal("3.0"), "tags": ["a", "b"], "n": Decimal("1.25"), "x": 1}):
        js.check_body(good, s)
    for bad in ({}, {"email": "nope"}, {"email": "a@b", "age": 150}, {"email": "a@b", "tags": ["a", "a"]}, {"email": "a@b", "n": Decimal("0.001")}, {"email": "a@b", "x": 2}, {"email": "a@b", "y": 1}, []):
        with pytest.raises(EngineError, match="SCHEMA_VIOLATION"):
            js.check_body(bad, s)
    with pytest.raises(EngineError, match="not supported"):
        js.check_schema({"$ref": "#/x"})
