from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from tracelake.functions.conversion import ConversionError, compile_conversion
from tracelake.functions.formula import FormulaError, compile_formula
from tracelake.sources.blocks import Conversion

NAN, INF = float("nan"), float("inf")
XS = [-INF, -5.0, -0.0, 0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 7.0, 1e9, INF, NAN, None]


@pytest.fixture(scope="module")
def xs(spark):
    return spark.createDataFrame([(x,) for x in XS], "x double")


def run(xs, rule, **how):
    t = compile_conversion(rule, F.col("x"), **how)
    return [None if r.v is None else tuple(r.v) if t.kind == "mixed" else r.v for r in xs.select(t.column.alias("v")).collect()]


def same(got, want):
    assert len(got) == len(want)
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, tuple) else "NaN" if isinstance(v, float) and math.isnan(v) else v
    for g, w in zip(got, want, strict=True):
        assert plain(g) == plain(w), (g, w)


def divide(a, b):
    if b == 0:
        return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1, b)
    return a / b


def apply(f):
    return [None if x is None else f(x) for x in XS]


def test_linear_and_rational(xs):
    same(run(xs, Conversion(1, [3, 2])), apply(lambda x: x * 2 + 3))
    same(run(xs, Conversion(2, [0, 1, 0, 0, 1, -1])), apply(lambda x: divide(0 * x * x + x, 0 * x * x + x - 1)))
    same(run(xs, Conversion(2, [1, 0, -4, 0, 0, 2])), apply(lambda x: divide(x * x + 0 * x - 4, 0 * x * x + 0 * x + 2)))


@pytest.mark.parametrize("wide", [False, True])
def test_tables(xs, wide, monkeypatch):
    if wide:
        monkeypatch.setattr("tracelake.functions.conversion.CHAIN", 1)
    keys, vals = [0.0, 1.0, 2.0, 3.0], [10.0, 20.0, 0.0, 5.0]
    pairs = [y for p in zip(keys, vals, strict=True) for y in p]

    def between(x):
        if math.isnan(x):
            return x
        if x <= keys[0]:
            return vals[0]
        if x >= keys[-1]:
            return vals[-1]
        i = max(k for k in range(3) if keys[k] <= x)
        return vals[i] + ((x - keys[i]) * (vals[i + 1] - vals[i])) / (keys[i + 1] - keys[i])

    def nearest(x):
        i = next((k for k in range(4) if keys[k] >= x), 4)
        if i == 0:
            return vals[0]
        if i == 4:
            return vals[-1]
        return vals[i] if x - keys[i - 1] > keys[i] - x else vals[i - 1]

    same(run(xs, Conversion(4, pairs)), apply(between))
    same(run(xs, Conversion(5, pairs)), apply(nearest))
    ranges = [(0.0, 1.0, 1.0), (1.0, 2.0, 2.0), (2.5, 7.0, 3.0)]

    def ranged(x, closed):
        for lo, hi, v in ranges:
            if hi >= x if closed else hi > x:
                return v if x >= lo else -1.0
        return -1.0

    flat = [y for r in ranges for y in r] + [-1.0]
    for closed in (False, True):
        same(run(xs, Conversion(6, flat), integer=closed), apply(lambda x, c=closed: ranged(x, c)))
        names = {1.0: "a", 2.0: None, 3.0: "c", -1.0: "else"}
        bounds = [y for lo, hi, _ in ranges for y in (lo, hi)]
        same(run(xs, Conversion(8, bounds, ["a", None, "c", "else"]), integer=closed), apply(lambda x, c=closed: names[ranged(x, c)]))
    same(run(xs, Conversion(7, [1.0, 7.0, 1.0], ["one", "last", "again", "miss"])), apply(lambda x: {1.0: "one", 7.0: "last"}.get(x, "miss")))
    nested = Conversion(8, [0.0, 1.0, 1.0, 3.0], [Conversion(1, [0.0, 10.0]), "mid", Conversion(0)])
    same(run(xs, nested, integer=True), apply(lambda x: (x * 10, None) if 0 <= x <= 1 else (None, "mid") if 1 < x <= 3 else (x, None)))


def test_texts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("",), (None,), ("z",)], "x string")
    got = [r.v for r in df.select(compile_conversion(Conversion(9, [1.0, 2.0, 3.0, 0.0], ["a", "b", "a"]), F.col("x"), textual=True).column.alias("v")).collect()]
    assert got == [3.0, 2.0, 0.0, None, 0.0]
    got = [r.v for r in df.select(compile_conversion(Conversion(10, [], ["a", "A", "b", None, None]), F.col("x"), textual=True).column.alias("v")).collect()]
    assert got == ["A", None, None, None, None]


def test_bitfield(spark):
    df = spark.createDataFrame([(k,) for k in range(8)], "x int")
    rule = Conversion(11, [], [Conversion(7, [1.0], ["on", "off"], name="low"), Conversion(7, [4.0, 6.0], ["four", "six", None])], masks=[1, 6])
    assert [r.v for r in df.select(compile_conversion(rule, F.col("x"), bits="text").column.alias("v")).collect()] == [f"low = {'on' if k & 1 else 'off'}" + {4: "|four", 6: "|six"}.get(k & 6, "") for k in range(8)]
    assert compile_conversion(rule, F.col("x")).kind == "raw"


@pytest.mark.parametrize(("text", "f"), [("X*X+2*X", lambda x: x * x + 2 * x), ("-(X-1)/4", lambda x: -(x - 1) / 4), ("2^3^2 - X", lambda x: 512 - x), ("1.5e1*x", lambda x: 15 * x), ("1/X", lambda x: divide(1.0, x)), ("sqrt(abs(X)) + 1", lambda x: math.sqrt(abs(x)) + 1)])
def test_formulas(spark, text, f):
    values = [-2.0, -0.0, 0.0, 1.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    same([r.v for r in df.select(compile_formula(text, F.col("x")).alias("v")).collect()], [f(v) for v in values])


@pytest.mark.parametrize("text", ["X +", "import os", "Y*2", "(X", "X)", "X $ 2", "__class__", "X X"])
def test_bad_formulas(spark, text):
    with pytest.raises(FormulaError):
        compile_formula(text, F.col("x"))


@pytest.mark.parametrize("rule", [Conversion(1, [1.0]), Conversion(99), Conversion(4, [1.0, 2.0, 3.0]), Conversion(9, [1.0], ["a"]), Conversion(3)])
def test_bad_rules(spark, rule):
    with pytest.raises(ConversionError):
        compile_conversion(rule, F.col("x"))


def test_conversion_stays_in_the_jvm(spark):
    df = spark.range(10).select(compile_conversion(Conversion(4, [0, 0, 1, 5, 2, 6]), F.col("id")).column.alias("v")).where("v > 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
