import math

import pytest
from pyspark.sql import functions as F

from axisfold.functions import semantics as s
from axisfold.functions.expressions import ExpressionError, to_column

INF, NAN = math.inf, math.nan


def same(a, b):
    return a is None and b is None or a is not None and b is not None and (a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b))


@pytest.mark.parametrize("n,d,want", [(1.0, 2.0, 0.5), (1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (NAN, 1.0, NAN), (1.0, NAN, NAN), (None, 1.0, None), (1.0, None, None)])
def test_guarded_div(spark, n, d, want):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    assert same(df.select(s.guarded_div(F.col("n"), F.col("d"))).first()[0], want)


@pytest.mark.parametrize("v,want", [(100.0, 2.0), (0.0, -INF), (-1.0, NAN), (NAN, NAN), (None, None)])
def test_log10(spark, v, want):
    assert same(spark.createDataFrame([(v,)], "v double").select(s.log10_ieee(F.col("v"))).first()[0], want)


@pytest.mark.parametrize("v,want", [(-math.e, 1.0), (0.0, math.log(1e-6)), (NAN, NAN), (None, None)])
def test_floored_ln(spark, v, want):
    assert same(spark.createDataFrame([(v,)], "v double").select(s.floored_ln(F.col("v"), 1e-6)).first()[0], want)


def test_min_and_max_with_nan(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (3.0,)], "v double")
    low, high = df.agg(s.nan_min(F.col("v")), F.max("v")).first()
    assert math.isnan(low) and math.isnan(high)


@pytest.mark.parametrize(
    "text,want",
    [
        ("log(100)", 2.0), ("ln(1)", 0.0), ("2 ** 3 + 7 % 4", 11.0), ("-7 % 3", 2.0), ("7 // 2", 3.0), ("min(a, b)", 1.0), ("max(a, b, 5)", 5.0), ("mean(a, b)", 1.5), ("a / 0", INF),
        ("1 if a < b <= 2 else 0", 1.0), ("sum([a, b, 3])", 6.0), ("sqrt(-1)", NAN), ("abs(-a)", 1.0), ("log2(8)", 3.0), ("exp(0)", 1.0), ("min([b, a])", 1.0), ("a > 0 and not b > 5", 1.0),
    ],
)
def test_expressions(spark, text, want):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert same(df.select(to_column(text, {"a": F.col("a"), "b": F.col("b")})).first()[0], want)


@pytest.mark.parametrize("text", ["a +", "unknown + 1", "__import__('os')", "a.real", "[x for x in a]", "open('f')", "[1, 2]", "'text'"])
def test_only_expressions(text):
    with pytest.raises(ExpressionError):
        to_column(text, {"a": F.lit(1.0)})


def test_null_in_min_max_is_null(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    names = {"a": F.col("a"), "b": F.col("b")}
    assert df.select(to_column("min(a, b)", names), to_column("max(a, b)", names)).first()[:] == (None, None)
