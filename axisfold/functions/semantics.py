"""Null, NaN and infinity rules, which differ from Spark's ANSI defaults.

A value without partner is NaN, not null, and stays NaN to the end, so no average
skips it; division and logarithms give IEEE results instead of errors or nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def or_nan(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(NAN))


def guarded_div(n: Column, d: Column) -> Column:
    """IEEE division; null where either side is null."""
    n, d = n.cast("double"), d.cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(d != 0, n / d)
        .when((n == 0) | F.isnan(n), F.lit(NAN))
        .when(n > 0, F.lit(INF))
        .otherwise(F.lit(-INF))
    )


def ieee_log(v: Column, log) -> Column:
    """``log`` with -inf at 0 and NaN below."""
    v = v.cast("double")
    return F.when(v > 0, log(v)).when(v == 0, F.lit(-INF)).when(v.isNull(), F.lit(None).cast("double")).otherwise(F.lit(NAN))


def log10_ieee(v: Column) -> Column:
    return ieee_log(v, F.log10)


def floored_ln(v: Column, floor: float) -> Column:
    """ln(max(|v|, floor)); null and NaN stay."""
    return F.when(v.isNotNull(), F.ln(F.greatest(F.abs(v), F.lit(float(floor)))))


def nan_min(v: Column) -> Column:
    """Aggregate minimum that any NaN makes NaN."""
    return F.when(F.max(F.isnan(v)), F.lit(NAN)).otherwise(F.min(v))


def nan_least(*xs: Column) -> Column:
    """Smallest of the values; null if one is null, NaN if one is NaN."""
    return _guarded(F.least, xs, nan=True)


def null_greatest(*xs: Column) -> Column:
    """Largest of the values; null if one is null; NaN counts as largest."""
    return _guarded(F.greatest, xs, nan=False)


def _guarded(pick, xs, nan: bool) -> Column:
    xs = [x.cast("double") for x in xs]
    null, bad = xs[0].isNull(), F.isnan(xs[0])
    for x in xs[1:]:
        null, bad = null | x.isNull(), bad | F.isnan(x)
    picked = pick(*xs) if len(xs) > 1 else xs[0]
    return F.when(null, F.lit(None).cast("double")).when(bad, F.lit(NAN)).otherwise(picked) if nan else F.when(~null, picked)


def is_bad(v: Column) -> Column:
    return v.isNull() | F.isnan(v)
