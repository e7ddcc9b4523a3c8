"""Made-up frames: dummies for missing tables, and replicas of boards and chips."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import NAN, nan_min
from ..plans.spec import AGGREGATES, CALIBRATED_TYPE, GroupDef, ScoreFile, ScorePart, SpecError, Step, is_virtual
from .fold import VALUE, apply_step, matches, weight_of
from .resolve import Catalog
from .transforms import with_groups


#: A grid that can't be folded by numbers alone has at most so many rows.
MOST_ROWS = 10_000_000


def axis_values(spark: SparkSession, catalog: Catalog, axis: str, step: Step | None) -> DataFrame:
    """The values of an axis, each once: of its map, else of any measurement, else of the selection, else 0."""
    codes = catalog.map_of(axis)
    if codes is not None:
        return codes.select(F.col("text").alias(axis)).distinct()
    for m in catalog.measurements.values():
        if axis in m.columns:
            return m.select(axis).where(F.col(axis).isNotNull()).distinct()
    if step is not None and isinstance(step.value, list) and step.value:
        return spark.createDataFrame([(v,) for v in step.value], [axis]).distinct()
    return spark.range(1).select(F.lit(0).cast("long").alias(axis))


def grid(spark: SparkSession, columns: Sequence[DataFrame]) -> DataFrame:
    """Every combination of the rows of small one-column frames; refused beyond ``MOST_ROWS``."""
    size = 1
    for c in columns:
        size *= c.count()
    if size > MOST_ROWS:
        raise SpecError(f"a grid of {size} rows")
    out = spark.range(1).select()
    for c in columns:
        out = out.crossJoin(c)
    return out


def constant_folded(spark: SparkSession, catalog: Catalog, part: ScorePart, dummy: float) -> DataFrame | None:
    """One row, value: what a part gives on a constant, from numbers of axis values alone; None where it takes a grid.

    On a constant every group of a fold looks alike, so a mean, minimum or maximum keeps
    it (times the mean, least or largest weight), and a sum multiplies it by the number
    or the weights of the values; a filter on a list leaves that many equal rows, which
    the next sum adds up.
    """
    order = [a for a in part.effective_order() if not is_virtual(a)]
    if any("&" in a or part.steps[a].op not in ("filter", *AGGREGATES) for a in order) or not order or part.steps[order[-1]].op == "filter":
        return None
    rows, value, repeats = spark.range(1).select(), F.lit(float(dummy)), F.lit(1.0)
    for i, axis in enumerate(order):
        step, own = part.steps[axis], axis_values(spark, catalog, axis, part.steps[axis])
        if step.value is not None:
            own = own.where(matches(own, axis, step.value))
        w = F.lit(1.0) if step.weight is None else weight_of(own, axis, step.weight)
        told = own.agg(F.struct(F.count("*").alias("n"), F.sum(w).alias("sum"), nan_min(w).alias("min"), F.max(w).alias("max")).alias(f"_{i}"))
        rows, got = rows.crossJoin(F.broadcast(told)), F.col(f"_{i}")  # one row
        if step.op == "filter":
            repeats = repeats * F.nullif(got["n"], F.lit(0))
            continue
        if step.op in ("min", "max"):
            other = {"min": "max", "max": "min"}[step.op]
            value = F.when(F.isnan(got["min"]) | F.isnan(got["max"]), F.lit(NAN)).when(value >= 0, value * got[step.op]).otherwise(value * got[other])
        else:
            value = value * repeats * got["sum"] if step.op == "sum" else value * (got["sum"] / F.nullif(got["n"], F.lit(0)))
        value = F.when(repeats.isNotNull(), value)
        repeats = F.when(repeats.isNotNull(), F.lit(1.0))
    return rows.select(value.alias(VALUE))


def dummy_part(spark: SparkSession, catalog: Catalog, part: ScorePart, dummy: float, file: ScoreFile | None = None) -> DataFrame:
    """What a plain part gives on a table that holds one constant everywhere: one row, value.

    The constant stands for values after the transforms, so these are left out.  Only
    parts with groups, combined axes, differences or expressions fold a real grid.
    """
    if part.relative is not None or part.type == CALIBRATED_TYPE:
        raise SpecError(f"{part.name}: no dummy for parts with a ratio, difference or conversion")
    groups = part.used_groups(file.groups if file else {})
    told = None if groups else constant_folded(spark, catalog, part, dummy)
    return grid_folded(spark, catalog, part, dummy, groups) if told is None else told


def grid_folded(spark: SparkSession, catalog: Catalog, part: ScorePart, dummy: float, groups: Mapping[str, GroupDef]) -> DataFrame:
    """The same by a grid of all axis values."""
    axes = sorted(part.required_axes(groups))
    df = grid(spark, [axis_values(spark, catalog, a, part.steps.get(a)) for a in axes]).withColumn(VALUE, F.lit(float(dummy)))
    df = with_groups(df, groups, {a for a in axes if part.named_directly(a)})
    for entry in part.effective_order():
        if not is_virtual(entry):
            df = apply_step(df, entry, part.steps[entry])
    return df


def fill_missing(scored: DataFrame, epochs: DataFrame, dummy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores with the dummy where an epoch has none, the epochs it was used for)."""
    lacking = epochs.select("Epoch").distinct().join(scored.select("Epoch"), "Epoch", "left_anti")
    filled = lacking.crossJoin(F.broadcast(dummy.select(VALUE)))  # one row
    return scored.unionByName(filled, allowMissingColumns=True), lacking


def single(df: DataFrame, column: str) -> int:
    """How many different values a column has; a bundle to replicate must have one."""
    return df.agg(F.count_distinct(column)).first()[0]


def expand_boards_chips(df: DataFrame, chips: Sequence[int], check: bool = True) -> DataFrame:
    """A one-board, one-chip table replicated to board b with ``chips[b]`` chips."""
    if not chips or any(c < 1 for c in chips):
        raise SpecError("every board needs a chip")
    if "Board" not in df.columns:
        return df
    own = [c for c in ("Board", "Chip") if c in df.columns]
    if check:
        for c in own:
            if single(df, c) > 1:
                raise SpecError(f"more than one {c}")
    boards = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("b"), F.lit(n).alias("n")) for b, n in enumerate(chips)]))
    out = df.drop(*own).withColumn("_b", boards)
    if "Chip" in own:
        out = out.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b.n").cast("long") - 1)))
    made: Mapping[str, object] = {"Board": F.col("_b.b"), "Chip": F.col("_c") if "Chip" in own else None}
    return out.select(*[made[c].alias(c) if c in own else F.col(c) for c in df.columns])


def pseudo_single(df: DataFrame) -> DataFrame:
    """The lowest board, then its lowest chip, both renumbered to 0."""
    if "Board" not in df.columns:
        return df
    zero = F.lit(0).cast("long")
    lowest = df.agg(F.min("Board").alias("_b"))
    out = df.join(F.broadcast(lowest), F.col("Board") == F.col("_b")).drop("_b").withColumn("Board", zero)
    if "Chip" in df.columns:
        lowest = out.agg(F.min("Chip").alias("_c"))
        out = out.join(F.broadcast(lowest), F.col("Chip") == F.col("_c")).drop("_c").withColumn("Chip", zero)
    return out.select(*df.columns)
