"""One score part as one lazy frame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import apply_step, collapse, fold_all
from ..operators.lookup import apply_calibration, conflict_failures
from ..operators.relative import apply_relative, relative_folded
from ..operators.resolve import Catalog
from ..operators.transforms import coverage_failures, resolve_groups, transform, with_groups
from .spec import CALIBRATE_STEP, CALIBRATED_TYPE, RELATIVE_STEP, GroupDef, ScorePart, SpecError, is_virtual


def base_frame(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef]) -> DataFrame:
    """The resolved axes and derived axes of a part."""
    own = part.used_groups(groups)
    axes = part.required_axes(own)
    return with_groups(catalog.resolve(part.source_type, axes), own, {a for a in axes if part.named_directly(a)})


def virtual_step(df: DataFrame, catalog: Catalog, part: ScorePart, step: str) -> DataFrame:
    if step == RELATIVE_STEP:
        return apply_relative(df, part.relative)
    if step == CALIBRATE_STEP:
        if catalog.calibration is None or catalog.temperatures is None or catalog.generation is None:
            raise SpecError(f"{part.name}: no calibration table, board temperatures or generation")
        return apply_calibration(df, catalog.generation, catalog.calibration, catalog.temperatures)
    return transform(df, part.steps[step])


def pairing_fold(order: list[str], i: int, part: ScorePart) -> int | None:
    """Where the sum or mean stands that ends what begins at ``i`` with a pairing and filters; None for anything else."""
    if order[i] != RELATIVE_STEP:
        return None
    for j in range(i + 1, len(order)):
        if is_virtual(order[j]) or "&" in order[j]:
            return None
        if part.steps[order[j]].op != "filter":
            return j if part.steps[order[j]].op in ("sum", "mean") else None
    return None


def folded(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef], start: tuple[DataFrame, int] | None = None) -> DataFrame:
    """The frame after all steps; folds in a row are planned together, a pairing with the sum or mean behind it.

    ``start`` is the frame behind the first steps, a fold among them, and their number.
    """
    df, i = start or (base_frame(catalog, part, groups), 0)
    order, unique = part.effective_order(), start is not None
    while i < len(order):
        at = pairing_fold(order, i, part)
        if at is not None:
            filters = [(a, part.steps[a]) for a in order[i + 1 : at]]
            df, i, unique = relative_folded(df, part.relative, filters, order[at], part.steps[order[at]]), at + 1, True
            continue
        if is_virtual(order[i]):
            df, i, unique = virtual_step(df, catalog, part, order[i]), i + 1, False
            continue
        j = i
        while j < len(order) and not is_virtual(order[j]):
            j += 1
        df, i = fold_all(df, order[i:j], part.steps, unique=unique), j
    return df


def refusals(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef]) -> list[DataFrame]:
    """(Epoch, reason) of epochs that the part must not score, whatever value comes out.

    A group must cover its axis in all rows, filtered or not, and a board must have
    one temperature.
    """
    out = [coverage_failures(catalog.resolve(part.source_type, {g.axis}), name, g) for name, g in groups.items()]
    if part.type == CALIBRATED_TYPE and catalog.temperatures is not None:
        out.append(conflict_failures(catalog.measurements[part.source_type].select("Epoch").distinct(), catalog.temperatures))
    return out


def score_part(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef] | None = None) -> DataFrame:
    """(Epoch, value, reason) of a resolved part; reason is null where value is good."""
    own = resolve_groups(part.used_groups(groups or {}), list(catalog.measurements.values()), catalog.counts)
    got = collapse(folded(catalog, part, own))
    for lost in refusals(catalog, part, own):
        got = got.join(lost.withColumnRenamed("reason", "_refused"), "Epoch", "full")
        got = got.select("Epoch", F.when(F.col("_refused").isNull(), F.col("value")).alias("value"), F.coalesce("_refused", "reason").alias("reason"))
    return got


