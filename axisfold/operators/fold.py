"""Folding axes away, one at a time.

The frame contract: one value column, every other column is a key.  A fold groups
by all columns but the value and the folded axis.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import to_column
from ..functions.semantics import NAN, is_bad, nan_min, or_nan
from ..plans.spec import AGGREGATES, SpecError, Step, axes_of

VALUE = "value"
#: So many parts of a left side that has no key to meet the right side by.
SPREAD = 64
AGGREGATE = {"mean": F.avg, "sum": F.sum, "min": nan_min, "max": F.max}


def rest(df: DataFrame, axis: str, value: str = VALUE) -> list[str]:
    """The keys that stay when an axis goes."""
    if axis not in df.columns:
        raise SpecError(f"axis {axis} is not there, or already gone")
    return [c for c in df.columns if c not in (axis, value)]


def _grouped(df: DataFrame, keys: Sequence[str], out: Column) -> DataFrame:
    return df.groupBy(*keys).agg(out) if keys else df.agg(out)


def _as_kind(x, kind: str):
    """The value in the terms of an axis type; None where the axis can't have it."""
    if kind == "string":
        return str(x).lower() if isinstance(x, bool) else str(x)
    if kind == "boolean":
        return x if isinstance(x, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(x).lower())
    if isinstance(x, bool):
        return None
    try:
        return x if isinstance(x, int | float) else int(x)
    except (TypeError, ValueError):
        pass
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def matches(df: DataFrame, axis: str, wanted) -> Column:
    """The axis equals a value or one of a list; booleans and numbers may be given as text.

    A value that the axis can't have, such as a word on an axis of numbers, matches nothing.
    """
    kind, values = dict(df.dtypes)[axis], wanted if isinstance(wanted, list | tuple) else [wanted]
    if kind not in ("string", "boolean", "double", "float") and not kind.endswith("int") and not kind.startswith("decimal"):
        return F.col(f"`{axis}`").isin(*values)
    own = [v for x in values if (v := _as_kind(x, kind)) is not None]
    if not own:
        return F.lit(False)
    return F.col(f"`{axis}`") == F.lit(own[0]) if len(own) == 1 else F.col(f"`{axis}`").isin(*own)


def filter_axis(df: DataFrame, axis: str, wanted) -> DataFrame:
    """Rows of one or several axis values; the axis goes, what stays may repeat."""
    if axis not in df.columns:
        raise SpecError(f"axis {axis} is not there, or already gone")
    return df.where(matches(df, axis, wanted)).drop(axis)


def weight_of(df: DataFrame, axis: str, weights) -> Column:
    """A number, or the number of the row's axis value; NaN where none is given."""
    if not isinstance(weights, Mapping):
        return F.lit(float(weights))
    kind = dict(df.dtypes)[axis]
    pairs = [F.lit(x) for k, w in weights.items() for x in (str(k).lower() if kind == "boolean" else str(k), float(w))]
    return or_nan(F.try_element_at(F.create_map(*pairs), F.col(axis).cast("string")))


def aggregate_axis(df: DataFrame, axis: str, op: str, select=None, weight=None, value: str = VALUE) -> DataFrame:
    """Mean, sum, min or max over an axis; selected and weighted just before."""
    keys = rest(df, axis, value)
    if select is not None:
        df = df.where(matches(df, axis, list(select)))
    if weight is not None:
        df = df.withColumn(value, F.col(value) * weight_of(df, axis, weight))
    return _grouped(df, keys, AGGREGATE[op](F.col(value)).alias(value))


def diff_axis(df: DataFrame, axis: str, minuend, subtrahend, value: str = VALUE, unique: bool = False) -> DataFrame:
    """Value at one axis value minus the value at another, matched on the other keys.

    A missing subtrahend gives NaN, a missing minuend no row; rows that repeat
    pair with each other.  ``unique`` (no repeats, as after a fold) needs one scan
    and no join.
    """
    keys = rest(df, axis, value)
    first, second = matches(df, axis, minuend), matches(df, axis, subtrahend)
    if unique:
        found = df.where(first | second).groupBy(*keys) if keys else df.where(first | second).groupBy()
        null_key = F.lit(False)
        for k in keys:
            null_key = null_key | F.col(k).isNull()
        got = found.agg(F.max(F.when(first, F.col(value))).alias("_a"), F.max(F.when(second, F.col(value))).alias("_b"), F.count_if(first).alias("_n"))
        return got.where("_n > 0").select(*keys, or_nan(F.when(~null_key, F.col("_a") - F.col("_b"))).alias(value))
    left = df.where(first).drop(axis)
    right = df.where(second).drop(axis).withColumnRenamed(value, "_other")
    return paired(left, right, keys).select(*keys, or_nan(F.col(value) - F.col("_other")).alias(value))


def paired(left: DataFrame, right: DataFrame, keys: Sequence[str], one: bool = False) -> DataFrame:
    """Left join on the keys; every row with every row where there are none.

    Without keys a right side of ``one`` row goes to every task; any other is copied
    once for each of ``SPREAD`` parts of the left, so that no task has all pairs.
    """
    if keys:
        return left.join(right, list(keys), "left")
    if one:
        return left.crossJoin(F.broadcast(right))
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(SPREAD)).cast("int"))
    return dealt.join(right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), "_part", "left").drop("_part")


def expr_axis(df: DataFrame, axis: str, expr: str, value: str = VALUE, unique: bool = False) -> DataFrame:
    """An expression over the group's values; NaN if an axis value repeats or a key is missing.

    What it asks of the values are aggregates that merge.  Axis values that may repeat
    are counted by a grouping of their own first, unless they are ``unique``.
    """
    keys = rest(df, axis, value)
    v = F.col(value).cast("double")
    if not unique:
        df = df.groupBy(*keys, axis).agg(F.first(v).alias(value), (F.count("*") > 1).alias("_again"))
    known = or_nan(v)
    values = {"sum": F.sum(known), "mean": F.avg(known), "min": nan_min(known), "max": F.max(known)}
    by = lambda key: F.max(F.when(F.col(f"`{axis}`").cast("string") == key, v))
    out = or_nan(to_column(expr, {}, values, by))
    if not unique:
        out = F.when(F.max("_again"), F.lit(NAN)).otherwise(out)
    got = df.groupBy(*keys).agg(out.alias(value), F.count("*").alias("_n")) if keys else df.agg(out.alias(value), F.count("*").alias("_n"))
    return got.where("_n > 0").drop("_n")


def fuse_axes(df: DataFrame, entry: str) -> DataFrame:
    """The axes of "A&B" as one text axis; null where a part is null."""
    axes = axes_of(entry)
    for a in axes:
        if a not in df.columns:
            raise SpecError(f"axis {a} of {entry} is not there, or already gone")
    parts = [x for a in axes for x in (F.lit("&"), F.col(f"`{a}`").cast("string"))][1:]
    return df.withColumn(entry, F.concat(*parts)).drop(*axes)


def combined_key(entry: str, wanted):
    """The fused text of {axis: value}; text passes through."""
    if isinstance(wanted, Mapping):
        axes = axes_of(entry)
        if set(wanted) != set(axes):
            raise SpecError(f"{entry}: a selection must name exactly {axes}")
        return "&".join(str(wanted[a]).lower() if isinstance(wanted[a], bool) else str(wanted[a]) for a in axes)
    if isinstance(wanted, list | tuple):
        return [combined_key(entry, w) for w in wanted]
    return wanted


def matches_combined(df: DataFrame, entry: str, keys) -> Column:
    """What fused keys ask of the single axes; true where a key can't be taken apart."""
    axes, out = axes_of(entry), F.lit(False)
    for key in keys if isinstance(keys, list | tuple) else [keys]:
        parts = str(key).split("&")
        if len(parts) != len(axes) or any(a not in df.columns for a in axes):
            return F.lit(True)
        one = F.lit(True)
        for a, p in zip(axes, parts, strict=True):
            one = one & matches(df, a, p)
        out = out | one
    return out


def apply_step(df: DataFrame, entry: str, step: Step, value: str = VALUE, unique: bool = False) -> DataFrame:
    """One entry of an order: fuse if it is combined, then filter or fold."""
    wanted = step.value
    if "&" in entry:
        wanted = combined_key(entry, wanted)
        if step.op in ("filter", "diff"):
            # on the single axes, so that the filter reaches the scan
            df = df.where(matches_combined(df, entry, wanted))
        df = fuse_axes(df, entry)
    if step.op == "filter":
        return filter_axis(df, entry, wanted)
    if step.op == "diff":
        return diff_axis(df, entry, *wanted, value=value, unique=unique)
    if step.op == "expr":
        # fused texts may coincide where their parts differ
        return expr_axis(df, entry, step.expr, value, unique and "&" not in entry)
    return aggregate_axis(df, entry, step.op, wanted, step.weight, value)


def can_fuse(a: Step, b: Step) -> bool:
    """Whether two folds in a row may be one: same sum, min or max, nothing selected or weighted between."""
    return a.op == b.op and a.op in ("sum", "min", "max") and b.value is None and b.weight is None


def fold_all(df: DataFrame, order: Sequence[str], steps: Mapping[str, Step], value: str = VALUE, unique: bool = False) -> DataFrame:
    """An ordered fold; neighbours of the same sum, min or max share one grouping.

    ``unique``: no two rows of ``df`` have the same keys, as after a fold.
    """
    i, folded = 0, unique
    while i < len(order):
        entry, step = order[i], steps[order[i]]
        j = i + 1
        while step.op in AGGREGATES and "&" not in entry and j < len(order) and "&" not in order[j] and can_fuse(step, steps[order[j]]):
            j += 1
        if j > i + 1:
            gone = order[i + 1 : j]
            for a in gone:
                rest(df, a, value)
            keys = [c for c in rest(df, entry, value) if c not in gone]
            if step.value is not None:
                df = df.where(matches(df, entry, list(step.value)))
            if step.weight is not None:
                df = df.withColumn(value, F.col(value) * weight_of(df, entry, step.weight))
            df = _grouped(df, keys, AGGREGATE[step.op](F.col(value)).alias(value))
        else:
            df = apply_step(df, entry, step, value, unique=folded)
        folded = step.op != "filter" and (folded or step.op in (*AGGREGATES, "expr"))
        i = j
    return df


def collapse(df: DataFrame, identity: Sequence[str] = ("Epoch",), value: str = VALUE) -> DataFrame:
    """(identity, value, reason): reason is null where one good value is left."""
    extra = [c for c in df.columns if c not in (*identity, value)]
    if extra:
        raise SpecError(f"axes left over: {', '.join(extra)}")
    got = df.groupBy(*identity) if identity else df.groupBy()
    got = got.agg(F.count("*").alias("_n"), F.count_if(is_bad(F.col(value))).alias("_bad"), F.first(F.col(value).cast("double")).alias(value))
    reason = F.when(F.col("_n") == 0, "0 rows left").when(F.col("_n") > 1, F.concat(F.col("_n").cast("string"), F.lit(" rows left, not 1"))).when(F.col("_bad") > 0, "the value is null or NaN")
    return got.select(*identity, F.when(reason.isNull(), F.col(value)).alias(value), reason.alias("reason"))


def collapse_to_scalar(df: DataFrame, value: str = VALUE) -> float:
    """The one value that is left of a frame without keys."""
    row = collapse(df, (), value).first()
    if row["reason"]:
        raise ValueError(row["reason"])
    return float(row[value])


def probe(df: DataFrame, identity: Sequence[str] = ("Epoch",), value: str = VALUE) -> DataFrame:
    """Rows, and null or NaN values, by identity."""
    got = df.groupBy(*identity) if identity else df.groupBy()
    return got.agg(F.count("*").alias("rows"), F.count_if(is_bad(F.col(value))).alias("bad"))
