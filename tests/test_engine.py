import math
import random

import pytest
from pyspark.sql import functions as F

from axisfold.functions import custom
from axisfold.functions.expressions import ExpressionError
from axisfold.operators import fold as fo
from axisfold.operators import lookup, quality, relative, synth, transforms
from axisfold.operators.resolve import Catalog
from axisfold.plans import presets
from axisfold.plans.part import folded, score_part
from axisfold.plans.score import ScoreError, compute_scores
from axisfold.plans.spec import GroupDef, Relative, ScoreFile, ScorePart, SpecError, Step, file_from

MEAN, SUM, MAX = Step("mean"), Step("sum"), Step("max")
NAN = math.nan


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def values(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def fbc(spark):
    rows = [(e, b, w, s, st, float(10 * e + 3 * b + w + 2 * s + (st == "R2A"))) for e in (1, 2) for b in (0, 1) for w in range(4) for s in range(2) for st in ("R2A", "A2R")]
    return spark.createDataFrame(rows, "Epoch int, Board long, WL long, STR long, State string, value double")


def part(order, steps, type_="FBC", **more):
    return ScorePart("p", type_, tuple(order), steps, **more).resolved({}, {})


def test_keys_of_a_fold_are_all_that_stays(spark, fbc):
    out = fo.aggregate_axis(fbc, "WL", "mean")
    assert out.columns == ["Epoch", "Board", "STR", "State", "value"] and out.count() == 16


def test_mean_of_means_is_not_fused(spark):
    df = frame(spark, [(1, 0, 0, 1.0), (1, 0, 1, 3.0), (1, 1, 0, 8.0)], "Epoch int, a int, b int, value double")
    assert values(fo.fold_all(df, ["b", "a"], {"a": MEAN, "b": MEAN}), "Epoch") == {1: 5.0}


@pytest.mark.parametrize("op", ["sum", "min", "max"])
def test_fused_folds_equal_single_ones(spark, fbc, op):
    step = {a: Step(op) for a in ("WL", "STR", "Board")}
    once = fo.fold_all(fbc, ["WL", "STR", "Board"], step)
    one_by_one = fbc
    for a in ("WL", "STR", "Board"):
        one_by_one = fo.aggregate_axis(one_by_one, a, op)
    assert values(once, "Epoch", "State") == values(one_by_one, "Epoch", "State")


def test_filters(spark, fbc):
    assert fo.filter_axis(fbc, "State", "R2A").count() == 32
    assert fo.filter_axis(fbc, "WL", [0, 3]).count() == 32
    null = frame(spark, [(1, None, 1.0), (1, "x", 2.0)], "Epoch int, a string, value double")
    assert [r["value"] for r in fo.filter_axis(null, "a", "x").collect()] == [2.0]
    with pytest.raises(SpecError):
        fo.filter_axis(fbc, "Nothing", 1)


def test_diff_rules(spark):
    rows = [(1, "k", "a", 5.0), (1, "k", "b", 2.0), (1, "m", "a", 7.0), (1, "n", "b", 9.0), (1, "d", "a", 1.0), (1, "d", "a", 2.0), (1, "d", "b", 1.0)]
    df = frame(spark, rows, "Epoch int, key string, ax string, value double")
    got = sorted(((r["key"], r["value"]) for r in fo.diff_axis(df, "ax", "a", "b").collect()), key=str)
    assert got[:3] == [("d", 0.0), ("d", 1.0), ("k", 3.0)] and got[3][0] == "m" and math.isnan(got[3][1]) and len(got) == 4
    unique = df.where("key <> 'd'")
    plain, fast = (values(fo.diff_axis(unique, "ax", "a", "b", unique=u), "key") for u in (False, True))
    assert plain["k"] == fast["k"] == 3.0 and math.isnan(fast["m"]) and set(plain) == set(fast)


def test_expr_by_and_values(spark):
    df = frame(spark, [(1, "A", 2.0), (1, "B", 8.0), (2, "A", 1.0), (3, "A", 1.0), (3, "A", 2.0), (3, "B", 1.0)], "Epoch int, ax string, value double")
    got = values(fo.expr_axis(df, "ax", "by['B'] / by['A'] + max(values)"), "Epoch")
    assert got[1] == 12.0 and math.isnan(got[2]) and math.isnan(got[3])


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_expr_asks_for_aggregates_only(spark):
    text = "max(values) - min(values) + sum(values) / mean(values) + by['A'] * (1 if by[1] > 2 else -1)"
    df = frame(spark, [(1, "A", 2.0), (1, "1", 3.0), (1, None, 5.0), (2, "A", None), (2, "1", 1.0), (3, None, 1.0), (3, None, 1.0), (4, "A", float("nan")), (4, "1", 1.0)], "Epoch int, ax string, value double")
    for unique in (False, True):
        made = fo.expr_axis(df.where("Epoch <> 3") if unique else df, "ax", text, unique=unique)
        assert "collect_list" not in plan_of(made)
        got = values(made, "Epoch")
        assert got.pop(1) == 3.0 + 10 / (10 / 3) + 2.0 and all(math.isnan(x) for x in got.values()) and len(got) == 3 - unique
    with pytest.raises(ExpressionError):
        fo.expr_axis(df, "ax", "log(values)")
    with pytest.raises(ExpressionError):
        fo.expr_axis(df, "ax", "values")
    total = fo.expr_axis(df.where("Epoch = 1").drop("Epoch"), "ax", "sum(values)")
    assert total.first()["value"] == 10.0 and fo.expr_axis(df.where("Epoch = 9").drop("Epoch"), "ax", "sum(values)").count() == 0


@pytest.mark.parametrize("mode", ["ratio", "diff"])
@pytest.mark.parametrize("pre", [(), (("b", MEAN),)])
@pytest.mark.parametrize("step", [MEAN, SUM, Step("mean", [0, 1], weight={"0": 2.0, "1": 0.5})])
def test_sums_over_pairs_equal_the_pairs(spark, mode, pre, step):
    """Many partners, none, zeros in the denominator of either sign of numerator, nulls and NaN."""
    draw = random.Random(7)
    rows = [(e, draw.choice("nd"), draw.randrange(3), draw.randrange(2), draw.randrange(2), float(draw.randrange(-3, 4))) for e in range(12) for _ in range(draw.randrange(2, 25))]
    rows += [(20, "n", 0, 0, 0, None), (20, "d", 0, 0, 0, 1.0), (21, "n", 0, 0, 0, 1.0), (21, "d", 0, 0, 0, None), (22, "n", 0, 0, 0, float("nan")), (22, "d", 0, 0, 0, -1.0), (23, "n", 1, 0, 0, 1.0)]
    df = frame(spark, rows, "Epoch int, side string, a int, b int, c int, value double")
    cfg = Relative("side", "n", "d", mode, 1.0, pre)
    filters = [("c", Step("filter", 0))]
    want = fo.fold_all(relative.apply_relative(df, cfg), ["c", "a", "b"], {"c": filters[0][1], "a": step, "b": MAX})
    got = fo.fold_all(relative.relative_folded(df, cfg, filters, "a", step), ["b"], {"b": MAX}, unique=True)
    want, got = values(want, "Epoch"), values(got, "Epoch")
    assert set(want) == set(got) and any(map(math.isfinite, want.values())) and any(map(math.isnan, want.values()))
    for e, x in want.items():
        assert got[e] == pytest.approx(x, nan_ok=True), e


def test_pairs_without_a_key(spark):
    df = frame(spark, [("n", 1.0), ("n", 3.0), ("d", 1.0), ("d", 3.0), ("d", 0.0)], "side string, value double")
    many = relative.apply_relative(df, Relative("side", "n", "d", "ratio", 1.0))
    assert sorted(r["value"] for r in many.collect()) == sorted((n + 1) / (d + 1) for n in (1, 3) for d in (1, 3, 0))
    df = df.withColumn("a", F.lit(0))
    one = relative.apply_relative(df, Relative("side", "n", "d", "diff", 0.0, (("a", SUM),)))
    assert sorted(r["value"] for r in one.collect()) == [-3.0, -1.0] and "CartesianProduct" not in plan_of(one)
    assert relative.relative_folded(df.drop("a").withColumn("k", F.lit(1)), Relative("side", "n", "d", "diff", 0.0, (("k", SUM),)), [], "k", MEAN).first()["value"] == -2.0


def test_a_part_with_many_partners_makes_no_pairs(spark):
    rows = [(1, "n", i % 2, float(i)) for i in range(400)] + [(1, "d", i % 2, float(i)) for i in range(400)]
    cat = Catalog({"T": frame(spark, rows, "Epoch int, side string, a int, value double")})
    p = ScorePart("p", "T", ("a",), {"a": MEAN}, Relative("side", "n", "d", "ratio", 1.0)).resolved({}, {})
    got = values(score_part(cat, p), "Epoch")[1]
    assert got == pytest.approx(sum((i + 1) / (j + 1) for i in range(400) for j in range(400) if i % 2 == j % 2) / 80_000)


def test_weights_are_not_normalised_and_uncovered_is_nan(spark):
    df = frame(spark, [(1, "A", 2.0), (1, "B", 4.0), (2, "C", 1.0)], "Epoch int, ax string, value double")
    got = values(fo.aggregate_axis(df, "ax", "mean", weight={"A": 1, "B": 0.5}), "Epoch")
    assert got[1] == 2.0 and math.isnan(got[2])
    assert [tuple(r) for r in transforms.uncovered(df, "ax", ["A", "B"]).collect()] == [(2, "C")]


def test_inline_weight_equals_weight_step(spark, fbc):
    w = {"R2A": 0.5, "A2R": 2.0}
    inline = part(["WL", "STR", "Board", "State"], {"WL": MEAN, "STR": MEAN, "Board": MEAN, "State": Step("sum", weight=w)})
    stepped = part(["WL", "STR", "Board", "__mul__", "State"], {"WL": MEAN, "STR": MEAN, "Board": MEAN, "__mul__": Step("mul", w, by="State"), "State": SUM})
    cat = Catalog({"FBC": fbc})
    assert values(score_part(cat, inline), "Epoch") == pytest.approx(values(score_part(cat, stepped), "Epoch"))


def test_groups(spark, fbc):
    overlap = GroupDef("WL", {"low": (0, 2), "high": (2, 3)})
    labels = {r["WL"]: r["G"] for r in transforms.with_groups(fbc, {"G": overlap}, {"WL"}).select("WL", "G").distinct().collect()}
    assert labels == {0: "low", 1: "low", 2: "high", 3: "high"}
    physical = transforms.resolve_groups({"G": GroupDef("WL", {"a": (0, 0)}, logical=False)}, [fbc])
    assert physical["G"].groups == {"a": (3, 3)}
    assert {r["WL"] for r in transforms.outside_groups(fbc, GroupDef("WL", {"a": (1, 3)})).collect()} == {0}
    with pytest.raises(SpecError):
        transforms.resolve_groups({"G": GroupDef("XX", {"a": (0, 0)}, logical=False)}, [fbc])
    with pytest.raises(SpecError):
        ScoreFile((), groups={"WL": GroupDef("WL", {})}).resolved_parts()


def test_group_and_its_axis_fold_in_turn(spark, fbc):
    p = part(["State", "STR", "Board", "WL", "G"], {"State": Step("filter", "R2A"), "STR": MEAN, "Board": MEAN, "WL": MEAN, "G": Step("max")})
    groups = {"G": GroupDef("WL", {"low": (0, 1), "high": (2, 3)})}
    want = {e: 10 * e + 1.5 + 1 + 1 + 2.5 for e in (1, 2)}
    assert values(score_part(Catalog({"FBC": fbc}), p, groups), "Epoch") == pytest.approx(want)


def test_combined_axis_equals_filtered_parts(spark, fbc):
    cat = Catalog({"FBC": fbc})
    rest = {"WL": MEAN, "STR": MEAN}
    both = part(["WL", "STR", "Board&State"], {**rest, "Board&State": Step("sum", [{"Board": 0, "State": "R2A"}, {"Board": 1, "State": "A2R"}])})
    one = [part(["Board", "State", "WL", "STR"], {**rest, "Board": Step("filter", b), "State": Step("filter", s)}) for b, s in ((0, "R2A"), (1, "A2R"))]
    a, b = (values(score_part(cat, p), "Epoch") for p in one)
    assert values(score_part(cat, both), "Epoch") == pytest.approx({e: a[e] + b[e] for e in a})
    with pytest.raises(SpecError):
        fo.combined_key("Board&State", {"Board": 0})
    null = frame(spark, [(1, None, "x", 1.0)], "Epoch int, a string, b string, value double")
    assert fo.fuse_axes(null, "a&b").first()["a&b"] is None


@pytest.fixture(scope="module")
def ratio_rows(spark):
    rows = [(1, b, w, ev, float(v)) for b, w, ev, v in [(0, 0, True, 9), (0, 1, True, 4), (0, 0, False, 3), (0, 1, False, 1), (1, 0, True, 5)]]
    return spark.createDataFrame(rows, "Epoch int, Board int, WL int, IsEval boolean, value double")


def test_relative(spark, ratio_rows):
    cfg = Relative("IsEval", True, False, "ratio", 1.0)
    got = values(relative.apply_relative(ratio_rows, cfg), "Board", "WL")
    assert got[0, 0] == 2.5 and got[0, 1] == 2.5 and math.isnan(got[1, 0])
    pre = Relative("IsEval", True, False, "ratio", 1.0, (("WL", MEAN),))
    got = values(relative.apply_relative(ratio_rows, pre), "Board", "WL")
    assert got[0, 0] == pytest.approx(10 / 3) and got[0, 1] == pytest.approx(5 / 3)
    diff = values(relative.apply_relative(ratio_rows, Relative("IsEval", True, False, "diff", 5.0)), "Board", "WL")
    assert diff[0, 0] == 6.0
    fan = relative.fan_out(ratio_rows, cfg).first()
    assert (fan["without"], fan["single"], fan["several"]) == (1, 2, 0)


def test_offset_step_equals_ratio_offset(spark, ratio_rows):
    df = ratio_rows.where("Board = 0")
    added = relative.apply_relative(transforms.transform(df, Step("add", 1)), Relative("IsEval", True, False))
    assert values(added, "WL") == values(relative.apply_relative(df, Relative("IsEval", True, False, "ratio", 1.0)), "WL")


def test_relative_without_keys(spark):
    df = frame(spark, [("n", 6.0), ("d", 3.0)], "side string, value double")
    assert relative.apply_relative(df, Relative("side", "n", "d")).first()["value"] == 2.0


def calibration(spark):
    return spark.createDataFrame([("B", -30.0, 0, "R2A", 0.0, -2.0), ("B", 85.0, 1, "R2A", 0.0, -4.0), ("B", 85.0, 1, "A2R", 0.0, 0.0)], "generation string, temp_key double, ord int, state string, a double, b double")


def test_nearest_key_and_calibration(spark):
    temps = frame(spark, [(0, -28.236), (1, 82.934), (2, 27.5), (3, None)], "Board long, temp double")
    keys = {r["Board"]: r["temp_key"] for r in lookup.nearest_key(temps, calibration(spark)).collect()}
    assert keys == {0: -30.0, 1: 85.0, 2: -30.0, 3: None}
    df = frame(spark, [(1, 0, "R2A", 0.01), (1, 1, "R2A", 0.01), (1, 1, "B2A", 0.01), (1, 0, "R2A", -1.0)], "Epoch int, Board long, State string, value double")
    got = lookup.apply_calibration(df, "B", calibration(spark), temps).collect()
    out = sorted((r["Board"], r["State"], str(r["value"])) for r in got)
    assert out == [(0, "R2A", "-1000.0"), (0, "R2A", "nan"), (1, "B2A", "nan"), (1, "R2A", "-500.0")]
    lost = lookup.unmatched_calibration(df, "B", calibration(spark), temps).collect()
    assert [tuple(r) for r in lost] == [(1, 1, "B2A")]
    with pytest.raises(SpecError):
        lookup.apply_calibration(df.drop("State"), "B", calibration(spark), temps)


def test_collapse(spark):
    df = frame(spark, [(1, 2.0), (2, NAN), (3, 1.0), (3, 1.0), (4, None)], "Epoch int, value double")
    got = {r["Epoch"]: (r["value"], r["reason"]) for r in fo.collapse(df).collect()}
    assert got[1] == (2.0, None) and got[2][0] is None and "NaN" in got[2][1] and "2 rows" in got[3][1] and got[4][1]
    with pytest.raises(SpecError):
        fo.collapse(df.withColumn("left", F.lit(1)))
    assert fo.collapse_to_scalar(frame(spark, [(3.0,)], "value double")) == 3.0
    with pytest.raises(ValueError):
        fo.collapse_to_scalar(frame(spark, [], "value double"))


def side_catalog(spark):
    base = frame(spark, [(1, 0, 0, 0, 5.0), (1, 0, 1, 1, 7.0), (1, 0, 2, 9, 8.0)], "Epoch int, Board long, Measure long, State long, value double")
    label = frame(spark, [(1, 0, 0, 1, 0, None), (1, 0, 1, 2, 1, None)], "Epoch int, Board long, Measure long, Read_Label long, Read_Override long, Erase_Label long")
    name = frame(spark, [(1, 0, 0, 3), (1, 0, 1, 4)], "Epoch int, Board long, Measure long, DataName long")
    maps = {"State": [(0, "R2A"), (1, "A2R")], "Label": [(1, "upper"), (2, "lower")], "Override": [(0, "false"), (1, "TRUE")], "dataName": [(3, "x"), (4, "y")]}
    return Catalog({"FBC": base}, {"FBC": label}, {"FBC": name}, {n: frame(spark, r, "code long, text string") for n, r in maps.items()})


def test_resolve(spark):
    cat = side_catalog(spark)
    df = cat.resolve("FBC", ["State", "Read_Label", "Read_Override", "DataName"])
    assert df.columns == ["Epoch", "DataName", "Read_Label", "Read_Override", "State", "value"] and dict(df.dtypes)["Read_Override"] == "boolean"
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "x", "upper", False, "R2A", 5.0), (1, "y", "lower", True, "A2R", 7.0), (1, None, None, None, None, 8.0)]
    assert "Measure" not in cat.resolve("FBC", ["State"]).columns
    with pytest.raises(SpecError):
        cat.resolve("FBC", ["Nothing"])
    assert set(cat.expand("FBC").columns) >= {"Board", "Erase_Label", "Read_Label", "DataName", "State"}


def test_catalog_and_candidates(spark):
    cat = side_catalog(spark)
    got = {(r["axis"], r["value"]) for r in quality.axis_catalog(cat, "FBC").collect()}
    assert got == {("Board", "0"), ("Measure", "0"), ("Measure", "1"), ("Measure", "2"), ("State", "R2A"), ("State", "A2R"), ("Read_Label", "upper"), ("Read_Label", "lower"), ("Read_Override", "TRUE"), ("Read_Override", "false"), ("DataName", "x"), ("DataName", "y")}
    codes = cat.maps["Label"]
    assert [r["text"] for r in quality.candidates(codes, frame(spark, [(2,)], "code long")).collect()] == ["lower"]
    assert quality.candidates(codes, frame(spark, [(7,)], "code long")).count() == 2
    assert {tuple(r) for r in quality.measure_labels(cat, "FBC").select("Measure", "DataName").collect()} == {(0, "x"), (1, "y"), (2, None)}


def scores_of(spark, fbc, epochs=(1, 2), **more):
    cat = Catalog({"FBC": fbc.where(F.col("Epoch").isin(*epochs))})
    p = ScorePart("a", "FBC", ("WL", "STR", "State", "Board"), {k: MEAN for k in ("WL", "STR", "State", "Board")})
    q = ScorePart("b", "FBC", ("State", "WL", "STR", "Board"), {"State": Step("filter", "R2A"), "WL": Step("max"), "STR": MEAN, "Board": Step("diff", [1, 0])})
    return compute_scores(cat, ScoreFile((p, q), "a + 10 * b", **more))


def test_batch_equals_single_epochs(spark, fbc):
    both = {r["Epoch"]: tuple(r) for r in scores_of(spark, fbc).scores.collect()}
    for e in (1, 2):
        assert tuple(scores_of(spark, fbc, (e,)).scores.first()) == both[e]
    assert both[1][3] == pytest.approx(both[1][4] + 30)


def test_every_epoch_is_scored_or_failed(spark, fbc):
    broken = fbc.withColumn("value", F.when(F.col("Epoch") == 2, F.lit(NAN)).otherwise(F.col("value")))
    extra = spark.createDataFrame([(3, None, None), (1, None, None), (2, None, None)], "Epoch int, History string, EpochNo long")
    cat = Catalog({"FBC": broken}, epochs=extra)
    file = ScoreFile((ScorePart("a", "FBC", ("WL", "STR", "State", "Board"), {k: MEAN for k in ("WL", "STR", "State", "Board")}),), "a")
    got = compute_scores(cat, file)
    assert [r["Epoch"] for r in got.scores.collect()] == [1]
    assert {r["Epoch"]: r["reason"] for r in got.failed.collect()} == {2: "a: the value is null or NaN", 3: "a: no rows"}
    with pytest.raises(ScoreError):
        compute_scores(cat, file, strict=True)
    assert got.require_any() is got
    with pytest.raises(ScoreError):
        compute_scores(Catalog({"FBC": broken.where("Epoch = 2")}), file).require_any()


def test_dummies(spark):
    sgwld = frame(spark, [(i, t) for i, t in enumerate("SGSB SGS DS0 DS1 DS2 DL0 DU0 DD2 DD1 DD0 SGD SGDT".split())], "code long, text string")
    cat = Catalog({"FBC": frame(spark, [(1, 0, 1.0)], "Epoch int, Board long, value double")}, maps={"SGWLD": sgwld})
    kld = presets.log_sum("kld", "KLD").resolved({}, {})
    others = [r["text"] for r in sgwld.collect() if r["text"] not in presets.SELECT_GATES]
    shift = presets.abs_sum("shift", "dVthSGWLD", others).resolved({}, {})
    assert fo.collapse_to_scalar(synth.dummy_part(spark, cat, kld, 0.0)) == 0.0
    assert fo.collapse_to_scalar(synth.dummy_part(spark, cat, shift, 1.0)) == 8.0
    got = compute_scores(cat, ScoreFile((kld, shift), "kld + shift", dummies={"KLD": 0.0, "dVthSGWLD": 1.0}))
    assert got.scores.first()["Score"] == 8.0 and got.dummy_used.count() == 2
    with pytest.raises(SpecError):
        synth.dummy_part(spark, cat, part(["Board"], {"Board": MEAN}, relative=Relative("x", 1, 2)), 1.0)


def test_replicas(spark):
    one = frame(spark, [(0, 0, 1, 5.0), (0, 0, 2, 7.0)], "Board long, Chip long, WL long, value double")
    many = synth.expand_boards_chips(one, [1, 3])
    assert many.columns == one.columns and many.count() == 8
    assert many.agg(F.avg("value")).first()[0] == one.agg(F.avg("value")).first()[0]
    back = synth.pseudo_single(many.withColumn("Board", F.col("Board") + 4))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, one.collect()))
    with pytest.raises(SpecError):
        synth.expand_boards_chips(many, [2])


def test_diagnosis(spark, fbc):
    cat = Catalog({"FBC": fbc})
    p = part(["State", "__mul__", "WL", "STR", "Board"], {"State": Step("filter", "R2A"), "__mul__": Step("mul", {"0": 1.0}, by="WL"), "WL": MEAN, "STR": MEAN, "Board": MEAN})
    first = {r["Epoch"]: (r["step"], r["what"]) for r in quality.first_offence(quality.step_metrics(cat, p)).collect()}
    assert first == {e: ("__mul__", "null or NaN appeared") for e in (1, 2)}
    none = part(["State", "WL", "STR", "Board"], {"State": Step("filter", "Z"), "WL": MEAN, "STR": MEAN, "Board": MEAN})
    assert {tuple(r) for r in quality.filter_causes(cat, none).collect()} == {(e, "State", "the filter matches nothing") for e in (1, 2)}
    r = part(["WL", "STR", "Board"], {"WL": MEAN, "STR": MEAN, "Board": MEAN}, relative=Relative("State", "R2A", "Z"))
    assert {x["cause"] for x in quality.relative_causes(cat, r).collect()} == {"no denominator rows"}


def test_range_reports(spark):
    n = frame(spark, [(7,)], "n long")
    gaps = quality.range_gaps(n, GroupDef("WL", {"a": (3, 4)}))
    assert quality.runs_text(gaps).first()["runs"] == "0-2, 5-6"
    assert [r["name"] for r in quality.ranges_beyond(n, GroupDef("WL", {"a": (0, 6), "b": (5, 7)})).collect()] == ["b"]


def test_custom_parts(spark, fbc):
    custom.register("constant", lambda cat, params: cat.measurements["FBC"].groupBy("Epoch").agg(F.lit(42.0).alias("value")))
    custom.register("nan", lambda cat, params: cat.measurements["FBC"].groupBy("Epoch").agg(F.lit(NAN).alias("value")))
    cat = Catalog({"FBC": fbc})
    good = compute_scores(cat, ScoreFile((ScorePart("c", "FBC", function="constant"),), "c"))
    assert [r["Score"] for r in good.scores.collect()] == [42.0, 42.0]
    assert compute_scores(cat, ScoreFile((ScorePart("c", "FBC", function="nan"),), "c")).failed.count() == 2
    got = {r["Epoch"]: r["reason"] for r in custom.by_epoch(fbc, lambda rows, p: True if rows["Epoch"].iloc[0] == 1 else 1 / 0, {}).collect()}
    assert "True" in got[1] and "ZeroDivisionError" in got[2]
    with pytest.raises(ValueError):
        custom.register("_private", None)


def test_spec_checks(spark, fbc):
    for axis, step in [("A", Step("median")), ("A", Step("filter")), ("A", Step("filter", [])), ("A", Step("filter", [[1]])), ("A", Step("diff", [1])), ("A", Step("expr")), ("A", Step("filter", 1, weight=2.0)), ("__div__", Step("div", 0)), ("__log__", Step("log")), ("__mul__", Step("mul", {"a": 1})), ("A", Step("sum", ref="none"))]:
        with pytest.raises(SpecError):
            part([axis], {axis: step})
    with pytest.raises(SpecError):
        part(["A"], {})
    with pytest.raises(SpecError):
        part(["__relative__"], {})
    with pytest.raises(SpecError):
        part(["__dvtbudget__"], {})
    moved = ScorePart("p", "dVtBudget", ("State", "WL"), {}, Relative("R", 1, 2)).effective_order()
    assert moved == ["__relative__", "__dvtbudget__", "State", "WL"]
    with pytest.raises(SpecError):
        folded(Catalog({"FBC": fbc}), part(["WL", "WL"], {"WL": MEAN}), {})
    read = file_from({"parts": [{"name": "a", "type": "FBC", "order": ["WL"], "aggregations": {"WL": {"op": "mean"}}, "relative": {"split_axis": "s", "numerator_when": True, "denominator_when": False, "denominator_offset": 1, "denominator_pre_aggregation": [{"axis": "WL", "op": "mean"}]}}], "groups": {"G": {"axis": "WL", "groups": {"a": [0, 1]}}}, "expression": "a"})
    assert read.parts[0].relative.denominator_pre_aggregation == (("WL", MEAN),) and read.groups["G"].groups == {"a": (0, 1)}


def mean_of_rows(what):
    # a local class, so that it travels to the tasks by value
    class Mean(custom.Aggregate):
        """Sum and number; an epoch whose rows are all below 0 can't be merged."""

        def zero(self, params):
            return [0.0, 0, 0]

        def update(self, state, rows):
            return [state[0] + rows["value"].sum(), state[1] + len(rows), max(state[2], len(rows))]

        def merge(self, a, b):
            if a[0] < 0:
                raise ValueError("below 0")
            return [a[0] + b[0], a[1] + b[1], max(a[2], b[2])]

        def finish(self, state):
            return {"most": state[2]}.get(self.what, state[0] / state[1])

    Mean.what = what
    return Mean()


def test_mergeable_aggregates_see_no_whole_epoch(spark):
    rows = [("hot", float(i)) for i in range(6000)] + [(f"e{i % 50}", float(i)) for i in range(500)] + [("low", -1.0)] * 40 + [(None, 2.0)] * 3 + [("inf", math.inf)]
    df = spark.createDataFrame(rows, "Epoch string, value double").repartition(8)
    got = {r["Epoch"]: (r["value"], r["reason"]) for r in custom.merged_by_epoch(df, mean_of_rows("mean"), {}).collect()}
    assert len(got) == 54 and got["hot"] == (2999.5, None) and got["e7"] == (232.0, None) and got[None] == (2.0, None)
    assert got["low"] == (None, "ValueError: below 0") and got["inf"][1].startswith("not a finite number")
    most = mean_of_rows("most")
    assert {r["Epoch"]: r["value"] for r in custom.merged_by_epoch(df, most, {}).collect()}["hot"] < 1000
    assert custom.merged_by_epoch(df.limit(0), most, {}).count() == 0


def test_dummies_by_numbers_equal_a_grid(spark):
    draw, ops = random.Random(4), ("mean", "sum", "min", "max")
    maps = {a: frame(spark, [(e, i, f"{a}{i}") for e in (1, 2) for i in range(n)], "Epoch int, code int, text string") for a, n in (("a", 3), ("b", 4), ("c", 1))}
    cat = Catalog({"X": frame(spark, [(1, 5, 1.0), (1, 6, 1.0)], "Epoch int, d int, value double")}, maps=maps)
    for dummy in (2.5, -2.5) * 6:
        order, steps = draw.sample("abcd", 4), {}
        for axis in order:
            some = [5, 6] if axis == "d" else [f"{axis}{i}" for i in draw.sample(range(4), draw.randrange(1, 4))]
            op = draw.choice(("filter", *ops))
            weight = draw.choice([None, 0.5, {str(v): draw.choice([2.0, -1.0]) for v in some}])
            steps[axis] = Step(op, some if op == "filter" or draw.random() < 0.5 else None, weight=None if op == "filter" else weight)
        steps[order[-1]] = Step("sum")
        p = part(order, steps, "Y")
        got, want = (x.first()["value"] for x in (synth.constant_folded(spark, cat, p, dummy), synth.grid_folded(spark, cat, p, dummy, {})))
        assert got == pytest.approx(want, nan_ok=True) or got is want is None, p


def test_dummies_over_large_axes(spark):
    big = spark.range(1_000_000).select(F.col("id").alias("code"), F.concat(F.lit("t"), "id").alias("text"))
    cat = Catalog({"X": frame(spark, [(1, 1.0)], "Epoch int, value double")}, maps={"a": big, "b": big})
    p = part(["a", "b"], {"a": Step("mean", weight=0.5), "b": SUM}, "Y")
    assert synth.dummy_part(spark, cat, p, 2.0).first()["value"] == 1e6
    with pytest.raises(SpecError, match="grid"):
        synth.dummy_part(spark, cat, part(["a&b"], {"a&b": MEAN}, "Y"), 2.0)


def test_catalogue_of_large_axes_by_sketches(spark):
    df = spark.range(50_000).select(F.lit(1).alias("Epoch"), F.col("id").alias("Measure"), (F.col("id") % 5).alias("WL"), F.lit(None).cast("long").alias("Void"), F.lit(1.0).alias("value"))
    codes = spark.range(3).select(F.col("id").alias("code"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    cat = Catalog({"T": df}, maps={"WL": codes})
    got = quality.bounded_catalog(cat, "T", 100).collect()
    (large,) = [r for r in got if r["value"] is None]
    assert (large["axis"], large["pos"], large["lo"], large["hi"]) == ("Measure", 0, "0", "49999") and abs(large["size"] - 50_000) < 2_500
    assert sorted((r["axis"], r["pos"], r["value"]) for r in got if r["value"]) == [("WL", 1, f"w{i}") for i in range(3)]
    whole = {(r["axis"], r["value"]) for r in quality.axis_catalog(cat, "T").collect()}
    assert whole == {(r["axis"], r["value"]) for r in quality.bounded_catalog(cat, "T", 10**6).collect()} and len(whole) == 50_003
    assert quality.bounded_catalog(Catalog({"T": df.limit(0)}), "T").count() == 0


def test_values_without_a_weight(spark):
    rows = [(1, w, s, 1.0) for w in range(12) for s in ("A", "B")] + [(2, 0, "A", 1.0), (2, None, "A", 1.0), (3, 0, "A", 1.0)]
    cat = Catalog({"T": spark.createDataFrame(rows, "Epoch int, WL int, State string, value double")})
    by = Step("mul", {"0": 2.0}, by="WL")
    row_wise = ScorePart("a", "T", ("__mul__", "WL", "State"), {"__mul__": by, "WL": Step("mean"), "State": Step("mean")})
    assert {tuple(r) for r in quality.unweighted(cat, row_wise).collect()} == {(1, 1, "__mul__", "WL", "1, 2, 3, 4, 5, 6, 7, 8, ..."), (2, 1, "__mul__", "WL", "null")}
    chosen = ScorePart("b", "T", ("State", "WL"), {"State": Step("filter", "A"), "WL": Step("sum", [0, 1, 2], weight={"0": 1.0, "2": 1.0})})
    assert [tuple(r) for r in quality.unweighted(cat, chosen).collect()] == [(1, 2, "WL", "WL", "1")]
    fused = ScorePart("c", "T", ("State&WL",), {"State&WL": Step("sum", weight={"A&0": 1.0, "B&0": 1.0, **{f"{s}&{w}": 1.0 for s in "AB" for w in range(1, 11)}, "A&11": 1.0})})
    assert {tuple(r) for r in quality.unweighted(cat, fused).where("Epoch <> 2").collect()} == {(1, 1, "State&WL", "State&WL", "B&11")}
    plain = ScorePart("d", "T", ("WL", "State"), {"WL": Step("mean"), "State": Step("mean")})
    assert quality.unweighted(cat, plain).count() == 0
