"""Nearest-key calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import guarded_div, log10_ieee, or_nan
from ..plans.spec import SpecError
from .fold import VALUE


def nearest_key(points: DataFrame, keys: DataFrame, at: str = "temp", key: str = "temp_key", ord_: str = "ord") -> DataFrame:
    """``points`` with the key nearest to ``at``, the first in order of several.

    ``keys`` is a calibration table's short list; it goes to every task as one
    sorted array, so no row is multiplied.
    """
    listed = keys.select(F.col(key).cast("double").alias("k"), F.col(ord_).cast("long").alias("o")).groupBy("k").agg(F.min("o").alias("o"))
    one = listed.agg(F.collect_list(F.struct("k", "o")).alias("_keys"))
    got = points.crossJoin(F.broadcast(one))  # one row
    best = F.array_min(F.transform("_keys", lambda x: F.struct(F.abs(x["k"] - F.col(at)).alias("d"), x["o"].alias("o"), x["k"].alias("k"))))
    return got.withColumn(key, F.when(F.col(at).isNotNull(), best["k"])).drop("_keys")


def apply_calibration(df: DataFrame, generation: str, calibration: DataFrame, temperatures: DataFrame, identity: str = "Epoch", value: str = VALUE) -> DataFrame:
    """-log10(v) / b * 1000 with b by board temperature (nearest key) and state.

    ``calibration``: generation, temp_key, ord, state, b.  ``temperatures``: Board,
    temp and, where it differs by epoch, the identity column.  What can't be looked
    up is NaN.
    """
    for axis in ("Board", "State"):
        if axis not in df.columns:
            raise SpecError(f"axis {axis} must not be folded before the conversion")
    own = calibration.where(F.col("generation") == generation)
    boards = nearest_key(temperatures, own)
    on = [c for c in (identity, "Board") if c in boards.columns and c in df.columns]
    b = boards.join(own.select("temp_key", F.col("state").alias("State"), F.col("b").alias("_b")), "temp_key").select(*on, "State", "_b")
    out = guarded_div(-log10_ieee(F.col(value)), F.col("_b")) * 1000
    return df.join(b, [*on, "State"], "left").select(*df.drop(value).columns, or_nan(out).alias(value))


def temperature_conflicts(temperatures: DataFrame) -> DataFrame:
    """(Epoch, Board), or (Board) where temperatures hold for all epochs, with more than one temperature."""
    keys = [c for c in ("Epoch", "Board") if c in temperatures.columns]
    return temperatures.groupBy(*keys).agg(F.count_distinct("temp").alias("n")).where("n > 1").select(*keys)


def conflict_failures(epochs: DataFrame, temperatures: DataFrame) -> DataFrame:
    """(Epoch, reason) of the epochs whose boards have several temperatures, of which none can be right."""
    lost = temperature_conflicts(temperatures)
    known = "Epoch" in lost.columns
    boards = F.slice(F.sort_array(F.collect_set("Board")), 1, 8)
    lost = (lost.groupBy("Epoch") if known else lost.groupBy()).agg(boards.alias("boards")).where(F.size("boards") > 0)
    both = epochs.join(lost, "Epoch") if known else epochs.crossJoin(F.broadcast(lost))  # one row
    return both.select("Epoch", F.concat(F.lit("boards with several temperatures: "), F.array_join(F.transform("boards", lambda b: b.cast("string")), ", ")).alias("reason"))


def unmatched_calibration(df: DataFrame, generation: str, calibration: DataFrame, temperatures: DataFrame, identity: str = "Epoch") -> DataFrame:
    """The (identity, Board, State) that find no coefficient."""
    own = calibration.where(F.col("generation") == generation)
    boards = nearest_key(temperatures, own)
    on = [c for c in (identity, "Board") if c in boards.columns and c in df.columns]
    b = boards.join(own.select("temp_key", F.col("state").alias("State")), "temp_key").select(*on, "State")
    return df.join(b, [*on, "State"], "left_anti").select(*dict.fromkeys([identity, "Board", "State"])).distinct()


def explode_calibration(nested: DataFrame, column: str = "coef") -> DataFrame:
    """generation -> temperature key -> state -> {a, b} maps as rows; ord is the order of the keys."""
    by_temp = nested.select(F.explode(column).alias("generation", "_temps"))
    by_state = by_temp.select("generation", F.posexplode("_temps").alias("ord", "_key", "_states"))
    rows = by_state.select("generation", "ord", F.col("_key").cast("double").alias("temp_key"), F.explode("_states").alias("state", "_c"))
    return rows.select("generation", "temp_key", "ord", "state", F.col("_c.a").alias("a"), F.col("_c.b").alias("b"))
