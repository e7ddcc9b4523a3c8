"""Axis resolution: dimension columns through side tables and code maps.

No join is hinted: side tables grow with the epochs, so Spark broadcasts them only
where their size allows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SpecError
from .fold import VALUE

SIDE_KEYS = ("InBatchEpoch", "Board", "Chip", "Block", "Measure")
OVERRIDE = "_Override"


def map_names(axis: str) -> list[str]:
    """The names of the code map of an axis, in order of preference."""
    if axis.endswith("_Label"):
        return ["Label"]
    if axis.endswith(OVERRIDE):
        return ["Override"]
    if axis == "DataName":
        return ["DataName", "dataName"]
    return [axis]


def as_override(text: Column) -> Column:
    """TRUE and 1 are true, other texts false; null stays."""
    return F.when(text.isNotNull(), F.upper(text.cast("string")).isin("TRUE", "1"))


def join_side(df: DataFrame, side: DataFrame, take: Iterable[str], identity: tuple[str, ...] = ("Epoch",)) -> DataFrame:
    """Columns of a side table, by the identity and the keys that both have."""
    take = [c for c in take if c in side.columns and c not in df.columns]
    if not take:
        return df
    keys = [c for c in (*identity, *SIDE_KEYS) if c in df.columns and c in side.columns]
    return df.join(side.select(*keys, *take), keys, "left")


def join_map(df: DataFrame, axis: str, codes: DataFrame) -> DataFrame:
    """An axis code replaced by its text; codes without text become null.

    Codes with an Epoch hold for that epoch only.
    """
    own = [c for c in ("Epoch",) if c in codes.columns and c in df.columns]
    named = codes.select(*[F.col(c).alias(f"_of_{c}") for c in own], F.col("code").alias("_code"), F.col("text").alias("_text"))
    text = as_override(F.col("_text")) if axis.endswith(OVERRIDE) else F.col("_text")
    columns = df.columns
    same = F.col(axis) == F.col("_code")
    for c in own:
        same = same & (F.col(c) == F.col(f"_of_{c}"))
    got = df.join(named, same, "left")
    return got.select(*[text.alias(c) if c == axis else F.col(c) for c in columns])


@dataclass(frozen=True)
class Catalog:
    """The tables of some epochs.

    measurements: by type, (Epoch, axes..., value).  labels and names: by type, side
    tables with the side keys.  maps: by name, (Epoch,) code, text.  temperatures: (Epoch,)
    Board, temp.  calibration: generation, temp_key, ord, state, a, b.  epochs: Epoch,
    History, EpochNo.  counts: declared numbers of axis values.  directories: Epoch, path.
    """

    measurements: Mapping[str, DataFrame]
    labels: Mapping[str, DataFrame] = field(default_factory=dict)
    names: Mapping[str, DataFrame] = field(default_factory=dict)
    maps: Mapping[str, DataFrame] = field(default_factory=dict)
    temperatures: DataFrame | None = None
    calibration: DataFrame | None = None
    epochs: DataFrame | None = None
    generation: str | None = None
    counts: Mapping[str, int] = field(default_factory=dict)
    directories: DataFrame | None = None

    def map_of(self, axis: str) -> DataFrame | None:
        return next((self.maps[n] for n in map_names(axis) if n in self.maps), None)

    def epoch_table(self) -> DataFrame:
        """All epochs, of the epoch table or else of the measurements."""
        if self.epochs is not None:
            return self.epochs
        out = None
        for m in {id(m): m for m in self.measurements.values()}.values():  # a table may have several names
            part = m.select("Epoch")
            out = part if out is None else out.unionByName(part)
        return out.distinct().select("Epoch", F.lit(None).cast("string").alias("History"), F.lit(None).cast("long").alias("EpochNo"))

    def resolve(self, type_: str, axes: Iterable[str], identity: tuple[str, ...] = ("Epoch",)) -> DataFrame:
        """The identity, the axes and the value of a type; codes as texts.

        Side tables and maps are joined only for axes that need them.  Axes that
        aren't asked for go; their rows stay, and may repeat.
        """
        axes = set(axes)
        if type_ not in self.measurements:
            raise SpecError(f"no table of type {type_}")
        df = self.measurements[type_]
        missing = axes - set(df.columns)
        if missing - {"DataName"} and type_ in self.labels:
            df = join_side(df, self.labels[type_], sorted(missing), identity)
        if "DataName" in missing and type_ in self.names:
            df = join_side(df, self.names[type_], ["DataName"], identity)
        lost = sorted(axes - set(df.columns))
        if lost:
            raise SpecError(f"type {type_} has no axis {', '.join(lost)}")
        for axis in sorted(axes):
            codes = self.map_of(axis)
            if codes is not None:
                df = join_map(df, axis, codes)
            elif axis.endswith(OVERRIDE) and dict(df.dtypes)[axis] == "string":
                df = df.withColumn(axis, as_override(F.col(axis)))
        return df.select(*identity, *sorted(axes - set(identity)), F.col(VALUE).cast("double").alias(VALUE))

    def expand(self, type_: str) -> DataFrame:
        """A type with every label, override and name it has, as texts."""
        base = [c for c in self.measurements[type_].columns if c not in (VALUE, "Epoch")]
        extra = [c for t in (self.labels.get(type_), self.names.get(type_)) if t is not None for c in t.columns if c not in (*SIDE_KEYS, "Epoch")]
        return self.resolve(type_, [*base, *extra])
