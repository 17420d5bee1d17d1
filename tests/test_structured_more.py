"""Coercion of typed columns, the Python forms of coercions, nested rules, JSON numbers and errors, compiled policies."""

import json

import pytest
from pyspark.sql import functions as F

from limpid.functions import normalize as N
from limpid.operators import policy as P
from limpid.operators import structured as S
from limpid.operators.compiled import CompiledPolicy
from limpid.operators.validate import Field, compile_validator

TEXTS = [
    "1,000.50", "1.000,50", "+007.500", "1E3", "-0.0", "abc", "1.2.3", "", "1e", "1,000", "1,000,000", ".5", "-.50", "1E+05", " 12 ", "0x10", "1_000", "+5",
    "99999999999999999999", "1e400", "{550E8400-E29B-41D4-A716-446655440000}", "(00) 41 44 668 18 00", "550e8400e29b41d4a71644665544000", "yes", "Off", "maybe", "2024-03-05", "13/45/2024", "1700000000", "+1 (415) 555-0132", "0041 44 668 18 00", "12", None, " 7 ",
]


@pytest.mark.parametrize("kind", sorted(S.COERCE_TEXT))
def test_python_coercions_equal_native_ones(spark, kind):
    df = spark.createDataFrame([(t,) for t in TEXTS], "s string")
    got = df.select("s", P.COERCIONS[kind](F.col("s")).alias("v")).collect()
    assert [(r["s"], r["v"]) for r in got] == [(t, None if t is None else S.COERCE_TEXT[kind](t)) for t in TEXTS]


def test_typed_coercions(spark):
    df = spark.createDataFrame(
        [(3.0, 2, True, 1_700_000_000), (3.5, 0, False, 1_700_000_000_123), (float("nan"), 1, None, -1), (float("inf"), None, True, 1 << 60)],
        "d double, i int, b boolean, t bigint",
    )
    rows = df.select(
        N.to_integer(F.col("d")).alias("a"), N.to_integer(F.col("b")).alias("b"), N.to_float(F.col("b")).alias("c"), N.to_float(F.col("d"), allow_infinity=True).alias("d"),
        N.to_boolean(F.col("i")).alias("e"), N.to_boolean(F.col("i"), policy="strict").alias("f"), N.normalize_date(F.col("t")).alias("g"), N.normalize_date(F.col("t"), "epoch-s").alias("h"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (3, 1, 1.0, 3.0, True, None, "2023-11-14T22:13:20.000Z", "1700000000"),
        (None, 0, 0.0, 3.5, False, False, "2023-11-14T22:13:20.123Z", "1700000000"),
        (None, None, None, None, True, True, "1969-12-31T23:59:59.000Z", "-1"),
        (None, 1, 1.0, float("inf"), None, None, None, None),
    ]
    hexed = spark.createDataFrame([("-0x1F",), ("1F",), ("0x1f",)], "s string").select(N.to_integer(F.col("s"), base=16).alias("v")).collect()
    assert [r["v"] for r in hexed] == [-31, None, 31]


def test_json_numbers_and_errors(spark):
    policy = S.Structured({"a": S.Rule(coerce="float"), "when": S.Rule(coerce="date"), "tel": S.Rule(coerce="phone")})
    assert S.process_json_text('{"a":"1,000.50","when":"03/05/2024","tel":"415-555-0132","n":[1.0,1e3,0.5,-0.0]}', policy) == (
        '{"a":"1000.5","when":"2024-03-05","tel":"4155550132","n":[1,1000,0.5,0]}'
    )
    deep = "[" * 12 + "]" * 12
    df = spark.createDataFrame([('{"a":1}',), ("{bad",), ("NaN",), (deep,), ("",), (None,)], "s string")
    got = df.select(S.process_json_detailed(F.col("s"), S.Structured()).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [('{"a":1}', None), (None, "invalid-json"), (None, "invalid-json"), (None, "too-deep"), (None, "invalid-json"), (None, None)]


def test_nested_rules_json_and_frame(spark):
    inner = S.Structured({"name": S.Rule(case="upper"), "pin": S.Rule(drop=True)})
    policy = S.Structured({"user": S.Rule(nested=inner), "name": S.Rule(case="lower")})
    record = {"name": "ABC", "user": {"name": "bob", "pin": "1"}}
    assert json.loads(S.process_json_text(json.dumps(record), policy)) == {"name": "abc", "user": {"name": "BOB"}}
    df = spark.createDataFrame([("ABC", ("bob", "1")), (None, None)], "name string, user struct<name:string,pin:string>")
    got = [r.asDict(recursive=True) for r in S.process_frame(df, policy).collect()]
    assert got == [{"name": "abc", "user": {"name": "BOB"}}, {"name": None, "user": None}]


def test_validate_record(spark):
    policy = S.Structured({"age": S.Rule(validate=Field("integer", required=True, min=0)), "n*": S.Rule()})
    df = spark.createDataFrame([(5, "x"), (-1, "y"), (None, None)], "age int, name string")
    got = df.select(S.validate_record(df, policy).alias("v")).select("v.ok", F.col("v.issues.code").alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, []), (False, ["range"]), (True, [])]
    check = compile_validator({"age": Field("integer", required=True)}, no_unknown=True)
    assert [r["n"] for r in df.select(F.size(check(df)["issues"]).alias("n")).collect()] == [1, 1, 1]


def test_compiled_policy(spark):
    df = spark.createDataFrame([(1, "  A@b.co ", ("A@b.co", "x"))], "id int, s string, r struct<mail:string,key:string>")
    p = CompiledPolicy(P.Policy(case="lower", validate=Field(format="email")), S.Structured({"mail": S.Rule(case="lower"), "key": S.Rule(drop=True)}))
    assert p.process_value(df).first().asDict(recursive=True) == {"id": 1, "s": "[REDACTED]", "r": {"mail": "a@b.co"}}
    row = df.select(p.validate(F.col("r.mail")).alias("a"), p.validate(F.col("s")).alias("b"), p.detect(F.col("s")).alias("c"), p.process_json(F.lit('{"mail":"X@Y.CO","key":1}')).alias("d")).first()
    assert (row["a"]["ok"], row["b"]["ok"], [f["type"] for f in row["c"]], row["d"]) == (True, False, ["email"], '{"mail":"x@y.co"}')
    bare = CompiledPolicy(P.Policy(scrub=None))
    row = df.select(bare.validate(F.col("s")).alias("a"), bare.detect(F.col("s")).alias("b"), bare.process_json(F.lit('{"m": "a@b.co"}')).alias("c")).first()
    assert (row["a"]["ok"], row["b"], row["c"]) == (True, [], '{"m":"a@b.co"}')
