import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelwright.functions import lang


@pytest.mark.parametrize(
    "text,x,want",
    [
        ("-2^2", 0, 4.0), ("2^3^2", 0, 64.0), ("log(100)", 0, 2.0), ("ln(e)", 0, 1.0), ("-7 % 3", 0, -1.0), ("1, 2", 0, 2.0),
        ("x < 0.5 ? 1 : 2", 0.5, 2.0), ("x <= 0.5 ? 1 : 2", 0.5, 2.0), ("x > 0.5 ? 1 : 2", 0.5, 1.0), ("x >= 0.5 ? 1 : 2", 0.4, 2.0),
        ("(x < 0.0031308) ? 1 : 2", 0.00313085, 1.0), ("sqrt 16", 0, 4.0), ("pi", 0, math.pi), ("fac(4) + ncr(5, 2) + npr(4, 2)", 0, 46.0),
    ],
)
def test_values(text, x, want):
    assert lang.evaluate(lang.parse(text), x) == pytest.approx(want)


@pytest.mark.parametrize("text", ["", "1 +", "foo(1)", "x ? 1 : 2", "X", "(1", "pow(1)", "y < 1 ? 1 : 2", "1 < 2"])
def test_errors(text):
    with pytest.raises(lang.ExpressionError):
        lang.parse(text)


def test_folding():
    assert lang.parse("1/2.4 + sin(0)").kind == "number"


@given(st.recursive(st.sampled_from(["x", "1.5", "2", "pi"]), lambda c: st.builds(lambda a, o, b: f"({a} {o} {b})", c, st.sampled_from("+-*"), c) | st.builds(lambda f, a: f"{f}({a})", st.sampled_from(["sin", "cos", "abs", "atan"]), c), max_leaves=8), st.floats(-3, 3))
def test_random_trees(text, x):
    plain = eval(text, {"sin": math.sin, "cos": math.cos, "abs": abs, "atan": math.atan, "pi": math.pi, "x": x})
    assert lang.evaluate(lang.parse(text), x) == pytest.approx(plain)


def test_column_agrees_with_python(spark):
    texts = list(lang.TONE_CURVES.values()) + [p[4] for p in lang.PROFILES.values()]
    points = [0.0, 0.002, 0.0031308, 0.01, 0.3, 0.9]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    got = df.select(*[lang.compile_column(t, F.col("x")).alias(f"c{k}") for k, t in enumerate(texts)]).collect()
    for p, row in zip(points, got):
        for t, v in zip(texts, row):
            assert v == pytest.approx(lang.evaluate(lang.parse(t), p), abs=1e-9)


def test_user_function(spark):
    lang.register("smooth", 3, lambda a, b, v: (v - a) / (b - a), "(({2} - {0}) / ({1} - {0}))", lambda a, b, v: (v - a) / (b - a))
    try:
        assert lang.evaluate(lang.parse("smooth(1, 3, x)"), 2.0) == 0.5
        assert spark.range(1).select(lang.compile_column("smooth(1, 3, x)", F.lit(2.5))).first()[0] == 0.75
        with pytest.raises(ValueError):
            lang.register("X", 1, None, "", None)
    finally:
        del lang.FUNCTIONS["smooth"]
