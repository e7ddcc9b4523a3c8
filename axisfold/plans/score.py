"""Score files: all parts, the expression, and every epoch in scores or in failed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.custom import custom_part
from ..functions.expressions import names_in, to_column
from ..functions.semantics import is_bad
from ..operators.fold import collapse
from ..operators.lookup import conflict_failures
from ..operators.resolve import Catalog
from ..operators.synth import dummy_part, fill_missing
from ..operators.transforms import coverage_failures, resolve_groups
from ..sources.shared import staged
from .part import folded
from .shared import Shared, shared_starts
from .spec import CALIBRATED_TYPE, ScoreFile, SpecError


class ScoreError(RuntimeError):
    """Epochs failed and the caller asked for none to fail."""


@dataclass(frozen=True)
class Scores:
    """scores: Epoch, History, EpochNo, Score, parts...  failed: Epoch, reason.  dummy_used: Epoch, part."""

    scores: DataFrame
    failed: DataFrame
    dummy_used: DataFrame
    held: DataFrame | None = None

    def release(self) -> None:
        """Free the part values that ``persist`` keeps."""
        if self.held is not None:
            self.held.unpersist()

    def require_any(self) -> Scores:
        """Raise if every epoch failed, naming the first."""
        if self.scores.isEmpty() and (first := self.failed.orderBy("Epoch").first()):
            raise ScoreError(f"all epochs failed; {first['Epoch']}: {first['reason']}")
        return self


def staged_catalogs(catalog: Catalog, file: ScoreFile) -> dict[str, Catalog]:
    """By part, a catalog whose table is resolved already and written to the shared folder.

    Parts that read the same type through the same side tables share one table of all
    their axes, so that its source is parsed and joined once; each part's scan of it
    reads its own columns only and takes its filters.
    """
    shared: dict[tuple, list] = {}
    for part in file.resolved_parts():
        if part.function or part.source_type not in catalog.measurements:
            continue
        axes = part.required_axes(part.used_groups(file.groups))
        lacking = axes - set(catalog.measurements[part.source_type].columns)
        sides = bool(lacking - {"DataName"}), "DataName" in lacking
        shared.setdefault((part.source_type, *sides), []).append((part.name, axes))
    out = {}
    for (type_, *_), users in shared.items():
        if len(users) > 1:
            table = staged(catalog.resolve(type_, set().union(*[axes for _, axes in users])))
            own = replace(catalog, measurements={**catalog.measurements, type_: table}, labels={}, names={}, maps={})
            out |= {name: own for name, _ in users}
    return out


def refused(catalog: Catalog, file: ScoreFile, known: Shared) -> DataFrame | None:
    """(Epoch, part, reason) of what must not be scored whatever value comes out: each group and type is looked at once."""
    out = None
    asked: dict[tuple[str, str], list[str]] = {}
    for part in file.resolved_parts():
        if part.function or part.source_type not in catalog.measurements:
            continue
        for name in part.used_groups(file.groups):
            asked.setdefault((part.source_type, name), []).append(part.name)
        if part.type == CALIBRATED_TYPE and catalog.temperatures is not None:
            asked.setdefault((part.source_type, ""), []).append(part.name)
    for (type_, name), parts in asked.items():
        if name:
            g = file.groups[name]
            rows = known.axes[type_, g.axis] if (type_, g.axis) in known.axes else catalog.resolve(type_, {g.axis})
            lost = coverage_failures(rows, name, g)
        else:
            epochs = known.epochs[type_] if type_ in known.epochs else catalog.measurements[type_].select("Epoch").distinct()
            lost = conflict_failures(epochs, catalog.temperatures)
        lost = lost.select("Epoch", F.explode(F.array(*map(F.lit, parts))).alias("part"), F.lit(not name).alias("last"), "reason")
        out = lost if out is None else out.unionByName(lost)
    return None if out is None else out.groupBy("Epoch", "part").agg(F.max_by("reason", F.struct("last", "reason")).alias("_refused"))


def part_values(catalog: Catalog, file: ScoreFile, stage: bool = False, share: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(Epoch, part, value, reason) of all parts, (Epoch, part) where a dummy stands in, and all epochs where they are known."""
    parts, declared = file.resolved_parts(), file.groups
    used_groups = {n: g for n, g in file.groups.items() if any(n in p.used_groups(file.groups) for p in parts)}
    file = replace(file, groups=resolve_groups(used_groups, list(catalog.measurements.values()), catalog.counts))
    tables = staged_catalogs(catalog, file) if stage else {}
    known = shared_starts(catalog, file) if share and not stage else Shared({}, {}, {})
    spark = next(iter(catalog.measurements.values())).sparkSession
    out = used = None
    for part in file.resolved_parts():
        if part.function:
            got = custom_part(part.function, catalog, part.params, declared)
        else:
            dummy = file.dummies.get(part.type)
            if dummy is not None and part.source_type not in catalog.measurements:
                epochs = catalog.epoch_table().select("Epoch").distinct()
                got = epochs.crossJoin(F.broadcast(dummy_part(spark, catalog, part, dummy, file).select("value"))).withColumn("reason", F.lit(None).cast("string"))
                lacking = epochs
            else:
                got, lacking = collapse(folded(tables.get(part.name, catalog), part, part.used_groups(file.groups), known.starts.get(part.name))), None
                if dummy is not None:
                    # only epochs without the table; an epoch whose rows fail stays failed
                    has = known.epochs[part.source_type] if part.source_type in known.epochs else catalog.measurements[part.source_type].select("Epoch").distinct()
                    absent = catalog.epoch_table().select("Epoch").join(has, "Epoch", "left_anti")
                    got, lacking = fill_missing(got, absent, dummy_part(spark, catalog, part, dummy, file))
            if lacking is not None:
                named = lacking.select("Epoch", F.lit(part.name).alias("part"))
                used = named if used is None else used.unionByName(named)
        got = got.select("Epoch", F.lit(part.name).alias("part"), "value", "reason")
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise SpecError("a score file needs a part")
    lost = refused(catalog, file, known)
    if lost is not None:
        out = out.join(lost, ["Epoch", "part"], "full")
        out = out.select("Epoch", "part", F.when(F.col("_refused").isNull(), F.col("value")).alias("value"), F.coalesce("_refused", "reason").alias("reason"))
    return out, used, _all_epochs(catalog, known)


def _all_epochs(catalog: Catalog, known: Shared) -> DataFrame | None:
    """The epochs of all tables, if the shared passes have seen them all."""
    seen = {id(catalog.measurements[t]): e for t, e in known.epochs.items()}
    if catalog.epochs is not None or any(id(m) not in seen for m in catalog.measurements.values()):
        return None
    out = None
    for e in seen.values():
        out = e if out is None else out.unionByName(e)
    return out.distinct().select("Epoch", F.lit(None).cast("string").alias("History"), F.lit(None).cast("long").alias("EpochNo"))


def compute_scores(catalog: Catalog, file: ScoreFile, strict: bool = False, persist: bool = False, stage: bool = False, share: bool = False) -> Scores:
    """Every epoch of the catalog, with all parts good in scores, else in failed.

    ``persist`` keeps the part values (one row for an epoch and part) for the frames
    that are made of them, until ``release``.  Where sources are slow to parse or join,
    ``share`` runs the first steps of all parts of a type in one pass (``shared``) and
    writes what they leave, and ``stage`` writes the resolved rows of types that several
    parts read.  Over Parquet a scan for each part is faster, since Spark filters and
    aggregates it in one narrow loop.  ``strict`` raises if an epoch fails.
    """
    names = [p.name for p in file.parts]
    if file.expression and (unknown := names_in(file.expression) - set(names)):
        raise SpecError(f"the expression names unknown parts: {sorted(unknown)}")
    values, used, epochs = part_values(catalog, file, stage, share)
    if persist:
        values = values.persist()
    epochs = epochs or catalog.epoch_table()
    epochs = epochs.select("Epoch", "History", "EpochNo").dropDuplicates(["Epoch"])
    by_part = values.groupBy("Epoch").pivot("part", names)
    wide = by_part.agg(F.first("value").alias("v"), F.first("reason").alias("r"))
    wide = epochs.join(wide, "Epoch", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"`{n}_v`").isNull(), F.concat(F.lit(f"{n}: "), F.coalesce(f"`{n}_r`", F.lit("no rows")))) for n in names]))
    score = to_column(file.expression, {n: F.col(f"`{n}_v`") for n in names}) if file.expression else F.lit(None).cast("double")
    wide = wide.withColumn("Score", score)
    expression_bad = F.lit(bool(file.expression)) & is_bad(F.col("Score"))
    wide = wide.withColumn("_reason", F.when(F.size(missing) > 0, F.array_join(missing, "; ")).when(expression_bad, F.lit("the expression gives no number")))
    good = wide.where(F.col("_reason").isNull()).select("Epoch", "History", "EpochNo", "Score", *[F.col(f"`{n}_v`").alias(n) for n in names])
    failed = wide.where(F.col("_reason").isNotNull()).select("Epoch", F.col("_reason").alias("reason"))
    if used is None:
        used = epochs.limit(0).select("Epoch", F.lit("").alias("part"))
    if strict and (first := failed.orderBy("Epoch").first()):
        raise ScoreError(f"{first['Epoch']}: {first['reason']}")
    return Scores(good, failed, used, values if persist else None)


def score_table(catalog: Catalog, file: ScoreFile, by: Sequence[str] = ("History", "EpochNo", "Epoch")) -> DataFrame:
    return compute_scores(catalog, file).scores.orderBy(*by)
