"""Row-wise steps on the value, and derived axes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import floored_ln, guarded_div
from ..plans.spec import GroupDef, SpecError, Step
from .fold import VALUE, weight_of

_CONSTANT = {"add": lambda v, c: v + c, "sub": lambda v, c: v - c, "mul": lambda v, c: v * c, "div": guarded_div}


def transformed(df: DataFrame, v: Column, step: Step) -> Column:
    """The value ``v`` of a row of ``df`` after a row-wise step."""
    v = v.cast("double")
    if step.op == "abs":
        return F.abs(v)
    if step.op == "log":
        return floored_ln(v, step.floor)
    if isinstance(step.value, Mapping):
        if step.by not in df.columns:
            raise SpecError(f"axis {step.by} is not there, or already gone")
        return _CONSTANT[step.op](v, weight_of(df, step.by, step.value))
    return _CONSTANT[step.op](v, F.lit(float(step.value)))


def transform(df: DataFrame, step: Step, value: str = VALUE) -> DataFrame:
    """Add, subtract, multiply or divide by a constant (one for all, or one for each
    value of ``by``; rows of other values become NaN), abs, or floored logarithm."""
    return df.withColumn(value, transformed(df, F.col(value), step))


def uncovered(df: DataFrame, axis: str, keys, identity: list[str] | None = None) -> DataFrame:
    """The axis values that a weight set or selection doesn't name, by identity."""
    identity = ["Epoch"] if identity is None else identity
    names = [str(k).lower() if isinstance(k, bool) else str(k) for k in keys]
    shown = F.col(axis).cast("string")
    return df.where(shown.isNull() | ~shown.isin(*names)).select(*identity, F.col(axis)).distinct()


def group_label(axis: Column, groups: Mapping[str, tuple[int, int]]) -> Column:
    """The name of the range that holds the value, the last defined of several; null outside."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in groups.items():
        out = F.when(axis.between(lo, hi), F.lit(name)).otherwise(out)
    return out


def logical_groups(g: GroupDef, n: int | None) -> GroupDef:
    """Physical ranges counted from the other end of an axis of ``n`` values."""
    if g.logical:
        return g
    if n is None:
        raise SpecError(f"the number of values of {g.axis} is not known")
    return GroupDef(g.axis, {k: (n - 1 - hi, n - 1 - lo) for k, (lo, hi) in g.groups.items()})


def with_groups(df: DataFrame, groups: Mapping[str, GroupDef], keep: set[str]) -> DataFrame:
    """Derived axes added; their source axes go unless in ``keep``."""
    for name, g in groups.items():
        if name == g.axis:
            raise SpecError(f"group {name} has the name of its own axis")
        if g.axis not in df.columns:
            raise SpecError(f"axis {g.axis} of group {name} is not there")
        df = df.withColumn(name, group_label(F.col(g.axis), g.groups))
    return df.drop(*[g.axis for g in groups.values() if g.axis not in keep])


def outside_groups(df: DataFrame, g: GroupDef, identity: list[str] | None = None) -> DataFrame:
    """Axis values in no range of the group, by identity; taken before any filter."""
    identity = ["Epoch"] if identity is None else identity
    return df.where(group_label(F.col(g.axis), g.groups).isNull()).select(*identity, F.col(g.axis)).distinct()


def coverage_failures(df: DataFrame, name: str, g: GroupDef, identity: str = "Epoch") -> DataFrame:
    """(identity, reason) of those with axis values in no range of the group; a few of the values are named."""
    lost = outside_groups(df, g, [identity]).groupBy(identity).agg(F.slice(F.sort_array(F.collect_set(g.axis)), 1, 8).alias("v"), F.count("*").alias("n"))
    shown = F.concat(F.array_join(F.transform("v", lambda x: x.cast("string")), ", "), F.when(F.col("n") > 8, ", ...").otherwise(""))
    return lost.select(identity, F.concat(F.lit(f"values of {g.axis} in no range of {name}: "), shown).alias("reason"))


def axis_counts(tables: list[DataFrame], axis: str) -> int | None:
    """Largest value + 1 of an axis over all tables that have it."""
    parts = [t.select(F.max(axis).cast("long").alias("m")) for t in tables if axis in t.columns]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    top = out.agg(F.max("m")).first()[0]
    return None if top is None else int(top) + 1


def resolve_groups(groups: Mapping[str, GroupDef], tables: list[DataFrame], declared: Mapping[str, int] | None = None) -> dict[str, GroupDef]:
    """All groups in logical numbers; counts are declared or found in the data."""
    declared = declared or {}
    return {n: g if g.logical else logical_groups(g, declared.get(g.axis, axis_counts(tables, g.axis))) for n, g in groups.items()}
