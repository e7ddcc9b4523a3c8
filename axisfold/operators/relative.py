"""Pairing numerator rows with denominator rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import INF, NAN, guarded_div, or_nan
from ..plans.spec import AGGREGATES, Relative, SpecError, Step
from .fold import VALUE, apply_step, matches, paired, rest, weight_of


def _sides(df: DataFrame, cfg: Relative, value: str) -> tuple[DataFrame, DataFrame, list[str], bool]:
    """Numerator, denominator folded as far as it is, the keys, and whether each key has one denominator."""
    if cfg.split_axis not in df.columns:
        raise SpecError(f"axis {cfg.split_axis} is not there, or already gone")
    if cfg.mode not in ("ratio", "diff"):
        raise SpecError(f"unknown mode {cfg.mode!r}")
    num = df.where(matches(df, cfg.split_axis, cfg.numerator_when)).drop(cfg.split_axis)
    den = df.where(matches(df, cfg.split_axis, cfg.denominator_when)).drop(cfg.split_axis)
    for axis, step in cfg.denominator_pre_aggregation:
        den = apply_step(den, axis, step, value)
    keys = [c for c in den.columns if c != value]
    missing = [k for k in keys if k not in num.columns]
    if missing:
        raise SpecError(f"the denominator has axes that the numerator lacks: {missing}")
    last = cfg.denominator_pre_aggregation[-1:]
    return num, den, keys, bool(last) and last[0][1].op in AGGREGATES


def apply_relative(df: DataFrame, cfg: Relative, value: str = VALUE) -> DataFrame:
    """Ratio (num + o) / (den + o), or difference, on all keys that the denominator keeps.

    The denominator may be folded first; folded axes pair no longer, so one
    denominator serves many numerators.  Rows without a partner are NaN, rows with
    several repeat.
    """
    num, den, keys, single = _sides(df, cfg, value)
    pairs = paired(num, den.withColumnRenamed(value, "_den"), keys, one=single)
    n, d = F.col(value).cast("double"), F.col("_den").cast("double")
    o = F.lit(float(cfg.denominator_offset))
    out = guarded_div(n + o, d + o) if cfg.mode == "ratio" else n - d
    return pairs.select(*num.drop(value).columns, or_nan(out).alias(value))


def relative_folded(df: DataFrame, cfg: Relative, filters: Sequence[tuple[str, Step]], axis: str, step: Step, value: str = VALUE) -> DataFrame:
    """Pairing, then filters, then a sum or mean over ``axis``, without ever making the pairs.

    The denominators of a key are summed up as their number and the sum of their
    reciprocals (or of themselves, for differences): a numerator over all of its
    partners adds up to itself times that sum.  So the join has one row for each
    numerator, however many partners it has.  A denominator of 0 counts by the sign of
    the numerator, as its quotients would; an infinite numerator takes the sign of the
    sum of reciprocals.
    """
    num, den, keys, single = _sides(df, cfg, value)
    o = F.lit(float(cfg.denominator_offset))
    for a, f in filters:
        num = num.where(matches(num, a, f.value))
    d = or_nan(F.col(value)) + (o if cfg.mode == "ratio" else F.lit(0.0))
    parts = {"_n": F.count("*"), "_zeros": F.count_if(d == 0), "_sum": F.sum(F.when(d != 0, 1 / d).otherwise(0.0)) if cfg.mode == "ratio" else F.sum(d)}
    if single and keys:
        one = F.when(d != 0, 1 / d).otherwise(0.0) if cfg.mode == "ratio" else d
        met = den.select(*keys, F.lit(1).cast("long").alias("_n"), F.when(d == 0, 1).otherwise(0).alias("_zeros"), one.alias("_sum"))
    else:
        met = den.groupBy(*keys).agg(*[c.alias(n) for n, c in parts.items()]) if keys else den.agg(*[c.alias(n) for n, c in parts.items()])
    rows = paired(num, met, keys, one=True)
    x, n, total = or_nan(F.col(value)), F.coalesce("_n", F.lit(0)), F.coalesce("_sum", F.lit(NAN))
    if cfg.mode == "ratio":
        x = x + o
        by_zero = F.when(F.isnan(x) | F.isnan(total) | (x == 0), F.lit(NAN)).when(x > 0, F.lit(INF)).otherwise(F.lit(-INF))
        out = F.when(n == 0, F.lit(NAN)).when(F.col("_zeros") > 0, by_zero).otherwise(x * total)
    else:
        out = F.when(n == 0, F.lit(NAN)).otherwise(x * n - total)
    gone = [a for a, _ in filters]
    left = [c for c in num.columns if c not in (value, *gone)]
    rows = rows.select(*left, out.alias(value), F.greatest(n, F.lit(1)).alias("_pairs"))
    stay = rest(rows.drop("_pairs"), axis, value)
    if step.value is not None:
        rows = rows.where(matches(rows, axis, list(step.value)))
    if step.weight is not None:
        rows = rows.withColumn(value, F.col(value) * weight_of(rows, axis, step.weight))
    made = F.sum(value) if step.op == "sum" else F.sum(value) / F.sum("_pairs")
    return rows.groupBy(*stay).agg(made.alias(value)) if stay else rows.agg(made.alias(value))


def fan_out(df: DataFrame, cfg: Relative, identity: tuple[str, ...] = ("Epoch",), value: str = VALUE) -> DataFrame:
    """How many numerator rows pair with none, one and several denominator rows."""
    num, den, keys, _ = _sides(df, cfg, value)
    counted = (den.groupBy(*keys) if keys else den.groupBy()).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return paired(num.drop(value), counted, keys, one=True).groupBy(*identity).agg(F.count_if(n == 0).alias("without"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("several"))
