"""One pass over a table for all parts that read it.

The leading filters, row-wise steps and folds of a part are its prefix.  All different
prefixes of a type run together: a row is read once and goes, tagged, to the prefixes
whose filters it passes; each level of folds is one grouping by the tag and by the axes
that the tag still has, the others being null.  The folded rows, small by then, are
written to the shared folder, and every part goes on from its own slice of them.

The same pass tells which epochs there are, and which values of the axes that groups
are made of, so that neither asks for a scan of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fold import AGGREGATE, VALUE, can_fuse, matches, weight_of
from ..operators.resolve import Catalog
from ..operators.transforms import transformed, with_groups
from ..sources.shared import staged
from .spec import AGGREGATES, CALIBRATE_STEP, RELATIVE_STEP, GroupDef, ScoreFile, ScorePart, Step, is_virtual


@dataclass(frozen=True)
class Level:
    """Filters and row-wise steps, and the fold behind them."""

    before: tuple[tuple[str, Step], ...]
    axes: tuple[str, ...]
    fold: Step


@dataclass(frozen=True)
class Prefix:
    """The columns that a part begins with, and its levels; none for plain facts."""

    columns: tuple[str, ...]
    levels: tuple[Level, ...] = ()

    def alive(self, upto: int) -> list[str]:
        """The axes that are there after so many levels."""
        gone = {a for x in self.levels[:upto] for a in (*x.axes, *[n for n, s in x.before if s.op == "filter"])}
        return [c for c in self.columns if c not in gone]


def prefix_of(part: ScorePart, groups: Mapping[str, GroupDef]) -> tuple[Prefix, int]:
    """The prefix of a part, and where its order goes on behind it; without a fold it goes on at 0."""
    own, order = part.used_groups(groups), part.effective_order()
    axes = part.required_axes(own)
    columns = tuple(sorted({a for a in axes if part.named_directly(a) or all(g.axis != a for g in own.values())} | set(own)))
    levels, before, i, end = [], [], 0, 0
    while i < len(order):
        entry = order[i]
        step = part.steps.get(entry)
        if entry in (RELATIVE_STEP, CALIBRATE_STEP) or "&" in entry:
            break
        if is_virtual(entry) or step.op == "filter":
            before.append((entry, step))
            i += 1
            continue
        if step.op not in AGGREGATES:
            break
        j = i + 1
        while j < len(order) and not is_virtual(order[j]) and "&" not in order[j] and can_fuse(step, part.steps[order[j]]):
            j += 1
        levels.append(Level(tuple(before), tuple(order[i:j]), step))
        before, i, end = [], j, j
    return Prefix(columns, tuple(levels)), end


def _level_rows(df: DataFrame, level: Level) -> tuple[Column, Column]:
    """Which rows a level takes, and their values just before its fold."""
    kept, v = F.lit(True), F.col(VALUE)
    for entry, step in level.before:
        if step.op == "filter":
            kept = kept & matches(df, entry, step.value)
        else:
            v = transformed(df, v, step)
    first = level.axes[0]
    if level.fold.value is not None:
        kept = kept & matches(df, first, list(level.fold.value))
    if level.fold.weight is not None:
        v = v * weight_of(df, first, level.fold.weight)
    return kept, v.cast("double")


def _by_tag(cases: Mapping[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for tag, column in cases.items():
        out = F.when(F.col("_tag") == tag, column).otherwise(out)
    return out


def _grouped(df: DataFrame, prefixes: Sequence[Prefix], at: int) -> DataFrame:
    """One grouping for the folds of level ``at`` (from 1) of all prefixes; those that have ended keep their rows."""
    columns = sorted({c for p in prefixes for c in p.alive(at)})
    keys = [F.when(F.col("_tag").isin(*[t for t, p in enumerate(prefixes) if c in p.alive(at)]), F.col(f"`{c}`")).alias(c) for c in columns]
    ops: dict[str, list[int]] = {}
    for t, p in enumerate(prefixes):
        ops.setdefault(p.levels[at - 1].fold.op if len(p.levels) >= at else "max", []).append(t)
    made = F.lit(None).cast("double")
    for op, tags in ops.items():
        made = F.when(F.col("_tag").isin(*tags), AGGREGATE[op](F.col(VALUE))).otherwise(made)
    return df.groupBy("_tag", "Epoch", *keys).agg(made.alias(VALUE))


def run_together(df: DataFrame, prefixes: Sequence[Prefix]) -> DataFrame:
    """(_tag, Epoch, axes..., value): what every prefix leaves, told apart by its position."""
    first = [_level_rows(df, p.levels[0]) if p.levels else (F.lit(True), F.col(VALUE)) for p in prefixes]
    tags = [F.when(kept, F.lit(t)).alias(f"_tag{t}") for t, (kept, _) in enumerate(first)]
    # one row for each tag that isn't null
    got = df.select("*", *tags).unpivot(df.columns, [f"_tag{t}" for t in range(len(prefixes))], "_name", "_tag").drop("_name").where("_tag IS NOT NULL")
    got = got.withColumn(VALUE, _by_tag({t: v for t, (_, v) in enumerate(first)}, F.col(VALUE)))
    got = _grouped(got, prefixes, 1)
    for at in range(2, max(len(p.levels) for p in prefixes) + 1):
        now = {t: _level_rows(got, p.levels[at - 1]) for t, p in enumerate(prefixes) if len(p.levels) >= at}
        got = got.where(_by_tag({t: kept for t, (kept, _) in now.items()}, F.lit(True))).withColumn(VALUE, _by_tag({t: v for t, (_, v) in now.items()}, F.col(VALUE)))
        got = _grouped(got, prefixes, at)
    return got


@dataclass(frozen=True)
class Shared:
    """By part, the frame behind its prefix and where it goes on; by type, its epochs; by type and axis, (Epoch, axis)."""

    starts: Mapping[str, tuple[DataFrame, int]]
    epochs: Mapping[str, DataFrame]
    axes: Mapping[tuple[str, str], DataFrame]


def shared_starts(catalog: Catalog, file: ScoreFile) -> Shared:
    """The prefixes of all parts of a type in one pass, for types that two parts or more can share."""
    by_table: dict[tuple, list[ScorePart]] = {}
    for part in file.resolved_parts():
        if not part.function and part.source_type in catalog.measurements and prefix_of(part, file.groups)[1]:
            lacking = part.required_axes(part.used_groups(file.groups)) - set(catalog.measurements[part.source_type].columns)
            # parts that meet other side tables may see other numbers of rows
            by_table.setdefault((part.source_type, bool(lacking - {"DataName"}), "DataName" in lacking), []).append(part)
    starts, epochs, axes = {}, {}, {}
    for (type_, *_), parts in by_table.items():
        if len(parts) < 2:
            continue
        found = {p.name: prefix_of(p, file.groups) for p in parts}
        tags = {name: i for i, name in enumerate(dict.fromkeys(repr(x) for x, _ in found.values()))}  # by what they say
        prefixes = list({repr(x): x for x, _ in found.values()}.values())
        own = {n: g for n, g in file.groups.items() if any(n in p.used_groups(file.groups) for p in file.parts if p.source_type == type_)}
        needed = set().union(*[p.required_axes(p.used_groups(file.groups)) for p in parts])
        facts = sorted({g.axis for g in own.values() if g.axis in needed}) or [None]
        facts = [a for a in facts if a is None or (type_, a) not in axes]
        n = len(prefixes)
        prefixes += [Prefix((a,) if a else ()) for a in facts]
        base = with_groups(catalog.resolve(type_, needed), {k: g for k, g in own.items() if g.axis in needed}, needed)
        rows = staged(run_together(base, prefixes))
        for p in parts:
            prefix, at = found[p.name]
            tag = tags[repr(prefix)]
            starts[p.name] = rows.where(F.col("_tag") == tag).select("Epoch", *prefix.alive(len(prefix.levels)), VALUE), at
        for t, a in enumerate(facts, n):
            told = rows.where(F.col("_tag") == t)
            epochs.setdefault(type_, told.select("Epoch").distinct())
            if a:
                axes[type_, a] = told.select("Epoch", a)
    return Shared(starts, epochs, axes)
