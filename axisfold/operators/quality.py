"""Diagnosis and data-quality operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import is_bad
from ..plans.part import base_frame, virtual_step
from ..plans.spec import AGGREGATES, CALIBRATE_STEP, RELATIVE_STEP, GroupDef, ScoreFile, ScorePart, axes_of, is_virtual
from ..sources.shared import staged
from .fold import VALUE, apply_step, combined_key, fuse_axes, matches
from .lookup import unmatched_calibration
from .relative import fan_out
from .resolve import SIDE_KEYS, Catalog
from .transforms import group_label, resolve_groups, uncovered


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counted(epochs: DataFrame, df: DataFrame, steps: Sequence[tuple[int, str, str, str]]) -> DataFrame:
    """(Epoch, at, step, rows, bad) of some steps, whose rows and bad rows two flags mark, in one pass."""
    counts = [F.struct(F.lit(at).alias("at"), F.lit(name).alias("step"), F.count_if(F.col(alive)).alias("rows"), F.count_if(F.col(alive) & F.col(bad)).alias("bad")) for at, name, alive, bad in steps]
    got = df.groupBy("Epoch").agg(F.array(*counts).alias("_made"))
    none = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(name).alias("step"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("bad")) for at, name, *_ in steps])
    return epochs.join(got, "Epoch", "left").select("Epoch", F.inline(F.coalesce("_made", none)))


def step_metrics(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef] | None = None) -> DataFrame:
    """(Epoch, at, step, rows, bad) after every step; steps that leave an epoch no row have rows 0.

    Filters and row-wise steps in a row are counted in one pass, by flags.  What a fold
    or a pairing leaves is written to the shared folder, so that no step runs the steps
    before it again.
    """
    epochs = catalog.epoch_table().select("Epoch").distinct()
    order, parts = part.effective_order(), []
    df = flagged = base_frame(catalog, part, groups or {})
    steps: list[tuple[int, str, str, str]] = []

    def put(at: int, name: str, alive: Column) -> DataFrame:
        steps.append((at, name, f"_alive{at}", f"_bad{at}"))
        return flagged.withColumn(f"_alive{at}", alive).withColumn(f"_bad{at}", is_bad(F.col(VALUE)))

    flagged = put(0, "resolved", F.lit(True))
    for at, name in enumerate(order, 1):
        before = F.col(steps[-1][2])
        if is_virtual(name) and name not in (RELATIVE_STEP, CALIBRATE_STEP):
            df, flagged = virtual_step(df, catalog, part, name), virtual_step(flagged, catalog, part, name)
            flagged = put(at, name, before)
        elif not is_virtual(name) and "&" not in name and part.steps[name].op == "filter":
            flagged = put(at, name, before & F.coalesce(matches(df, name, part.steps[name].value), F.lit(False)))
            df = apply_step(df, name, part.steps[name])
        else:
            parts.append(_counted(epochs, flagged, steps))
            df = staged(virtual_step(df, catalog, part, name) if is_virtual(name) else apply_step(df, name, part.steps[name]))
            flagged, steps = df, []
            flagged = put(at, name, F.lit(True))
    parts.append(_counted(epochs, flagged, steps))
    return union(parts)


def first_offence(metrics: DataFrame) -> DataFrame:
    """(Epoch, step, what): the first step that lost all rows or brought in null or NaN."""
    before = Window.partitionBy("Epoch").orderBy("at")
    x = metrics.withColumn("_rows", F.coalesce(F.lag("rows").over(before), F.lit(1))).withColumn("_bad", F.coalesce(F.lag("bad").over(before), F.lit(0)))
    what = F.when((F.col("rows") == 0) & (F.col("_rows") > 0), "no rows left").when((F.col("bad") > 0) & (F.col("_bad") == 0), "null or NaN appeared")
    x = x.withColumn("what", what).where(F.col("what").isNotNull())
    return x.groupBy("Epoch").agg(F.min_by(F.struct("step", "what"), "at").alias("_f")).select("Epoch", "_f.step", "_f.what")


def _only(catalog: Catalog, file: ScoreFile, failed: DataFrame) -> tuple[Catalog, Mapping[str, GroupDef], list[ScorePart]]:
    """The rows of failed epochs, the groups by all rows, and the parts that have steps and a table."""
    lost = failed.select("Epoch").distinct()
    groups = resolve_groups(file.groups, list(catalog.measurements.values()), catalog.counts)
    own = {t: m.join(lost, "Epoch", "left_semi") for t, m in catalog.measurements.items()}
    own = replace(catalog, measurements=own, epochs=catalog.epoch_table().join(lost, "Epoch", "left_semi"))
    return own, groups, [p for p in file.resolved_parts() if not p.function and p.source_type in own.measurements]


def failed_causes(catalog: Catalog, file: ScoreFile, failed: DataFrame) -> DataFrame:
    """(Epoch, part, step, what): where the parts of failed epochs first lost all rows or met null or NaN.

    Only rows of the failed epochs are run again.  User-defined parts have no steps.
    """
    own, groups, parts = _only(catalog, file, failed)
    found = [first_offence(step_metrics(own, p, p.used_groups(groups))).select("Epoch", F.lit(p.name).alias("part"), "step", "what") for p in parts]
    return union(found) if found else failed.limit(0).select("Epoch", *[F.lit("").alias(c) for c in ("part", "step", "what")])


def unweighted(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef] | None = None) -> DataFrame:
    """(Epoch, at, step, axis, values): the axis values that a step meets and has no weight for, the first eight and a mark of more."""
    df, found = base_frame(catalog, part, groups or {}), []
    for at, name in enumerate(part.effective_order(), 1):
        if name in (RELATIVE_STEP, CALIBRATE_STEP):
            df = virtual_step(df, catalog, part, name)
            continue
        step, rows, axis, weights = part.steps[name], df, name, part.steps[name].weight
        if is_virtual(name):
            axis, weights = step.by, step.value
        elif isinstance(weights, Mapping):
            wanted = combined_key(name, step.value) if "&" in name else step.value
            rows = fuse_axes(df, name) if "&" in name else df
            rows = rows if wanted is None else rows.where(matches(rows, name, list(wanted)))
        if isinstance(weights, Mapping):
            lost = uncovered(rows, axis, weights).groupBy("Epoch").agg(F.sort_array(F.collect_set(axis)).alias("v"), F.count_if(F.col(axis).isNull()).alias("none"))
            shown = F.concat(F.transform(F.slice("v", 1, 8), lambda x: x.cast("string")), F.when(F.size("v") > 8, F.array(F.lit("..."))).otherwise(F.array()), F.when(F.col("none") > 0, F.array(F.lit("null"))).otherwise(F.array()))
            found.append(lost.select("Epoch", F.lit(at).alias("at"), F.lit(name).alias("step"), F.lit(axis).alias("axis"), F.array_join(shown, ", ").alias("values")))
        df = virtual_step(df, catalog, part, name) if is_virtual(name) else apply_step(df, name, step)
    return union(found) if found else df.limit(0).select("Epoch", F.lit(0).alias("at"), *[F.lit("").alias(c) for c in ("step", "axis", "values")])


def explained(catalog: Catalog, file: ScoreFile, failed: DataFrame) -> DataFrame:
    """``failed`` (Epoch, reason) whose reasons tell the steps that went wrong and the values without a weight.

    Only rows of the failed epochs are run again; user-defined parts keep their bare reasons.
    """
    own, groups, parts = _only(catalog, file, failed)
    said = [failed_causes(catalog, file, failed).select("Epoch", F.concat("part", F.lit(": "), "what", F.lit(" at "), "step").alias("text"))]
    for p in parts:
        lost = unweighted(own, p, p.used_groups(groups))
        said.append(lost.select("Epoch", F.concat(F.lit(f"{p.name}: no weight for "), "axis", F.lit(" "), "values", F.lit(" at "), "step").alias("text")))
    told = union(said).groupBy("Epoch").agg(F.array_join(F.sort_array(F.collect_list("text")), "; ").alias("_told"))
    return failed.join(told, "Epoch", "left").select("Epoch", F.concat("reason", F.coalesce(F.concat(F.lit(" ("), "_told", F.lit(")")), F.lit(""))).alias("reason"))


def relative_causes(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef] | None = None) -> DataFrame:
    """(Epoch, numerator_rows, denominator_rows, cause) of a part with a pairing."""
    df, cfg = base_frame(catalog, part, groups or {}), part.relative
    of = {"numerator_rows": matches(df, cfg.split_axis, cfg.numerator_when), "denominator_rows": matches(df, cfg.split_axis, cfg.denominator_when)}
    got = df.groupBy("Epoch").agg(*[F.count_if(c).alias(n) for n, c in of.items()])
    met = fan_out(df, cfg).select("Epoch", (F.col("single") + F.col("several")).alias("_met"))
    cause = F.when(F.col("numerator_rows") == 0, "no numerator rows").when(F.col("denominator_rows") == 0, "no denominator rows").when(F.coalesce("_met", F.lit(0)) == 0, "no pairs")
    return got.join(met, "Epoch", "left").select("Epoch", *of, cause.alias("cause"))


def filter_causes(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef] | None = None) -> DataFrame:
    """(Epoch, step, cause): filters that match nothing in an epoch's resolved rows."""
    df = base_frame(catalog, part, groups or {})
    tests = [(s, matches(df, s, part.steps[s].value)) for s in part.order if s in df.columns and part.steps[s].op == "filter"]
    if not tests:
        return df.limit(0).select("Epoch", F.lit("").alias("step"), F.lit("").alias("cause"))
    got = df.groupBy("Epoch").agg(*[F.count_if(hit).alias(f"n{i}") for i, (_, hit) in enumerate(tests)])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"n{i}").alias("n")) for i, (s, _) in enumerate(tests)]))
    return got.select("Epoch", rows.alias("x")).where("x.n = 0").select("Epoch", "x.step", F.lit("the filter matches nothing").alias("cause"))


def calibration_causes(catalog: Catalog, part: ScorePart, groups: Mapping[str, GroupDef] | None = None, shown: int = 8) -> DataFrame:
    """A report of at most ``shown`` (Epoch, Board, State) without a coefficient."""
    df = base_frame(catalog, part, groups or {})
    return unmatched_calibration(df, catalog.generation, catalog.calibration, catalog.temperatures).orderBy("Epoch", "Board", "State").limit(shown)


def _axes_of(catalog: Catalog, type_: str) -> list[tuple[DataFrame, list[str], int]]:
    """The tables of a type, each with its own axes and the position of the first of them, in header order."""
    base = catalog.measurements[type_]
    axes = [c for c in base.columns if c not in (VALUE, "Epoch")]
    out, start = [(base, axes, 0)], len(axes)
    for side in (catalog.labels.get(type_), catalog.names.get(type_)):
        own = [c for c in side.columns if c not in (*SIDE_KEYS, "Epoch", *axes)] if side is not None else []
        if own:
            out.append((side, own, start))
        start += len(own)
    return out


def axis_sizes(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """One row, sizes: by axis (size, lo, hi), about how many values it has and the least and largest, as text.

    Each task adds its rows up to one sketch for each axis, whatever the number of
    values: exact for some hundred of them, within about 3 % beyond.
    """
    told = [F.struct(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(a).cast("string"))).alias("size"), F.min(a).cast("string").alias("lo"), F.max(a).cast("string").alias("hi")) for a in axes]
    return df.agg(F.array(*told).alias("sizes"))


def _as_texts(catalog: Catalog, got: DataFrame, axes: Sequence[str]) -> DataFrame:
    """(axis, pos, code, ...) with ``value``, the text of the code where the axis has a map; codes without text go."""
    texts = None
    for a in axes:
        codes = catalog.map_of(a)
        if codes is not None:
            named = codes.select(F.lit(a).alias("axis"), F.col("code").cast("string").alias("code"), F.col("text").cast("string").alias("text")).distinct()
            texts = named if texts is None else texts.unionByName(named)
    if texts is None:
        return got.withColumn("value", F.col("code"))
    mapped = texts.select("axis").distinct().withColumn("has_map", F.lit(True))
    got = got.join(texts, ["axis", "code"], "left").join(mapped, "axis", "left")
    return got.withColumn("value", F.when(F.col("has_map"), F.col("text")).otherwise(F.col("code")))


def axis_catalog(catalog: Catalog, type_: str) -> DataFrame:
    """(type, axis, pos, value): the values of every axis as text, in header order.

    Label columns without any value are left out; the name axis is there only if
    the type has a name table.  One pass finds the distinct values of all axes.
    """
    found = []
    for df, own, start in _axes_of(catalog, type_):
        shown = F.explode(F.array(*[F.struct(F.lit(start + i).alias("pos"), F.lit(a).alias("axis"), F.col(a).cast("string").alias("code")) for i, a in enumerate(own)]))
        found.append(df.select(shown.alias("x")).select("x.*").where(F.col("code").isNotNull()).distinct())
    got = _as_texts(catalog, union(found), [a for _, own, _ in _axes_of(catalog, type_) for a in own])
    return got.where(F.col("value").isNotNull()).select(F.lit(type_).alias("type"), "axis", "pos", "value").distinct()


def bounded_catalog(catalog: Catalog, type_: str, most: int = 1_000) -> DataFrame:
    """(type, axis, pos, value, size, lo, hi): the catalogue with no more than about ``most`` values an axis.

    An axis that a sketch finds to have more is one row without a value, with their
    estimated number and their range; of others every value is a row, without these.
    Values of large axes never pass a shuffle.
    """
    found = []
    for df, own, start in _axes_of(catalog, type_):
        sizes = axis_sizes(df, own)
        large = [F.struct(F.lit(start + i).alias("pos"), F.lit(a).alias("axis"), F.col("sizes")[i].alias("told")) for i, a in enumerate(own)]
        large = sizes.select(F.explode(F.array(*large)).alias("x")).select("x.pos", "x.axis", "x.told.*").where(F.col("size") > most)
        code = lambda i, a: F.when(F.col("sizes")[i]["size"] <= most, F.col(a).cast("string"))
        shown = F.explode(F.array(*[F.struct(F.lit(start + i).alias("pos"), F.lit(a).alias("axis"), code(i, a).alias("code")) for i, a in enumerate(own)]))
        small = df.select(*own).crossJoin(F.broadcast(sizes)).select(shown.alias("x")).select("x.*").where(F.col("code").isNotNull()).distinct()  # one row
        found.append(small.unionByName(large, allowMissingColumns=True))
    got = _as_texts(catalog, union(found), [a for _, own, _ in _axes_of(catalog, type_) for a in own])
    shown = ["axis", "pos", F.when(F.col("size").isNull(), F.col("value")).alias("value"), "size", "lo", "hi"]
    return got.where(F.col("value").isNotNull() | F.col("size").isNotNull()).select(F.lit(type_).alias("type"), *shown).distinct()


def candidates(codes: DataFrame, present: DataFrame) -> DataFrame:
    """The texts of a map that occur, by code; all of them if none does.

    ``present``: code, the codes that occur.
    """
    hit = codes.join(present.select("code").distinct(), "code", "left_semi")
    some = hit.agg((F.count("*") > 0).alias("_some"))
    kept = codes.join(present.select("code").distinct().withColumn("_in", F.lit(True)), "code", "left").crossJoin(F.broadcast(some))
    return kept.where(~F.col("_some") | F.col("_in")).select("code", "text")


def measure_labels(catalog: Catalog, type_: str) -> DataFrame:
    """Distinct (Measure, DataName) of a type."""
    axes = ["Measure", "DataName"] if type_ in catalog.names else ["Measure"]
    return catalog.resolve(type_, axes).drop(VALUE, "Epoch").distinct()


def spec_values(file: ScoreFile) -> list[tuple[str, str, str, str]]:
    """(part, type, axis, value as text) that filters, selections, differences and splits name."""
    rows = []
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    for p in file.resolved_parts():
        for entry in p.order:
            step = p.steps.get(entry)
            if step is None or step.value is None or step.op not in ("filter", "diff", *AGGREGATES):
                continue
            wanted = step.value if isinstance(step.value, list | tuple) else [step.value]
            for w in wanted:
                pairs = w.items() if isinstance(w, Mapping) else zip(axes_of(entry), str(w).split("&"), strict=False) if "&" in entry else [(entry, w)]
                rows += [(p.name, p.source_type, a, text(v)) for a, v in pairs if a not in file.groups]
        if p.relative is not None:
            for side in (p.relative.numerator_when, p.relative.denominator_when):
                rows += [(p.name, p.source_type, p.relative.split_axis, text(v)) for v in (side if isinstance(side, list | tuple) else [side])]
    return list(dict.fromkeys(rows))


def spec_mismatch(spark: SparkSession, file: ScoreFile, known: DataFrame) -> DataFrame:
    """Values that the specification names and the data (type, axis, value) don't have."""
    named = spark.createDataFrame(spec_values(file) or [("", "", "", "")], "part string, type string, axis string, value string").where("part <> ''")
    return named.join(known.select("type", "axis", "value"), ["type", "axis", "value"], "left_anti").select("part", "type", "axis", "value")


def parts_without_data(spark: SparkSession, file: ScoreFile, present: DataFrame) -> DataFrame:
    """Parts whose type isn't among the present ones (type)."""
    named = spark.createDataFrame([(p.name, p.source_type) for p in file.parts], "part string, type string")
    return named.join(present.select("type").distinct(), "type", "left_anti").select("part", "type")


def range_gaps(n: DataFrame, g: GroupDef) -> DataFrame:
    """Runs lo..hi of the axis values 0..N-1 that are in no range. ``n``: one row, n."""
    ids = n.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).where(group_label(F.col("i"), g.groups).isNull())
    return runs(ids, F.col("i"))


def runs(ids: DataFrame, i: Column) -> DataFrame:
    """(lo, hi) of consecutive whole numbers."""
    ordered = Window.partitionBy(F.lit(0)).orderBy("_i")  # the values of one axis
    x = ids.select(i.cast("long").alias("_i")).distinct().withColumn("_run", F.col("_i") - F.row_number().over(ordered))
    return x.groupBy("_run").agg(F.min("_i").alias("lo"), F.max("_i").alias("hi")).select("lo", "hi")


def runs_text(found: DataFrame) -> DataFrame:
    """One row: the runs as "0-2, 5"."""
    shown = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    got = found.agg(F.sort_array(F.collect_list(F.struct("lo", shown.alias("s")))).alias("_x"))
    return got.select(F.array_join(F.transform("_x", lambda x: x["s"]), ", ").alias("runs"))


def ranges_beyond(n: DataFrame, g: GroupDef) -> DataFrame:
    """Ranges (name, lo, hi, n) that reach outside 0..N-1."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi")) for k, (lo, hi) in g.groups.items()]))
    return n.select("n", rows.alias("x")).select("x.name", "x.lo", "x.hi", "n").where("lo < 0 OR hi > n - 1")


def count_mismatch(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Axes (axis, declared, observed) whose declared number of values isn't what the data have."""
    return declared.join(observed, "axis").where("declared <> observed").select("axis", "declared", "observed")


def unmatched_thresholds(spark: SparkSession, file: ScoreFile) -> DataFrame:
    """Threshold keys that name no part."""
    keys = spark.createDataFrame([(k,) for k in file.thresholds] or [("",)], "key string").where("key <> ''")
    parts = spark.createDataFrame([(p.name,) for p in file.parts], "key string")
    return keys.join(parts, "key", "left_anti")
