"""Run configurations and epoch directories, from files to scores."""

import json
import random
import shutil
import tarfile
from dataclasses import replace
from statistics import mean

import pytest

from axisfold.__main__ import generation_info, histories_of, load_functions, main
from axisfold.functions.custom import custom_part
from axisfold.operators.resolve import Catalog
from axisfold.plans.score import compute_scores
from axisfold.plans.spec import GroupDef, SpecError, file_from, json_with_comments
from axisfold.sources.bundles import main as bundles
from axisfold.sources.history import open_catalog

CONFIG = """{
  "Generation": "B9LS", // a comment
  "optimization": {
    /* "inside": 1 */
    "vthSkip": {"epochs": 10, "dummyKLDValue": 0.5},
    "constraintThreshold": {"nowhere": {"value": 1}},
    "WLgroupDefinLogical": "True",
    "WLgroup": {"a": [0, 1], "b": [2, 3]},
    "WLgroupWeight": {"a": 2, "b": 0.5},
    "score_parts": [
      {"name": "ratio", "type": "FBC",
       "relative": {"split_axis": "Read_Override", "numerator_when": true, "denominator_when": false, "denominator_offset": 1,
                    "denominator_pre_aggregation": [{"axis": "WL", "op": "mean"}]},
       "order": ["Read_Label", "State", "WL", "WLgroup", "Board"],
       "aggregations": {"Read_Label": {"op": "filter", "value": "upper//1"}, "State": {"op": "filter", "value": "A2B"},
                        "WL": {"op": "mean"}, "WLgroup": {"op": "max", "weight_ref": "WLgroupWeight"}, "Board": {"op": "mean"}}},
      {"name": "top", "type": "FBC", "order": ["State", "WL", "Board", "Read_Override"],
       "aggregations": {"State": {"op": "filter", "value": "A2B"}, "WL": {"op": "max"}, "Board": {"op": "sum"}, "Read_Override": {"op": "max"}}},
      {"name": "kld", "type": "KLD", "order": ["SGWLD"], "aggregations": {"SGWLD": {"op": "mean"}}},
    ],
    "expression": "ratio + kld",
  },
}"""


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """Two epochs whose State codes differ, the second without KLD; and the rows they hold."""
    base, rng, rows = tmp_path_factory.mktemp("made"), random.Random(3), {}
    (base / "run.jsonc").write_text(CONFIG)
    root = base / "exp" / "Step1" / "Loop01" / "result_history"
    for no in (1, 2):
        d = root / f"result.{no:04d}"
        d.mkdir(parents=True)
        own = rows[no] = [(b, m, w, s, rng.randint(1, 50)) for b in (0, 1) for m in (0, 1) for w in range(4) for s in (0, 1)]
        head = "InBatchEpoch,Board,Chip,Block,Measure,WL,State,FBC" if no == 1 else "Board,InBatchEpoch,Chip,Block,Measure,WL,State,FBC"
        (d / "FBC.csv").write_text(head + "\n" + "".join(f"{0 if no == 1 else b},{b if no == 1 else 0},0,0,{m},{w},{s},{v}\n" for b, m, w, s, v in own))
        (d / "parameterLabel_FBC.csv").write_text("InBatchEpoch,Board,Chip,Block,Measure,Read_Label,Read_Override\n" + "".join(f"0,{b},0,0,{m},1,{m}\n" for b in (0, 1) for m in (0, 1)))
        (d / "map_Label.csv").write_text("1,upper//1")
        (d / "map_Override.csv").write_text("0,FALSE\n1,TRUE")
        (d / "map_State.csv").write_text("0,R2A\n1,A2B" if no == 1 else "0,A2B\n1,R2A")
        if no == 1:
            (d / "KLD.csv").write_text("InBatchEpoch,Board,Chip,SGWLD,KLD\n0,0,0,0,4\n0,0,0,1,8\n")
    return base, root, rows


def expected(rows, code):
    """The parts ratio and top, in plain Python."""
    v = {(b, m, w): x for b, m, w, s, x in rows if s == code}
    boards = []
    for b in (0, 1):
        # WLgroup is there from the start, so the denominator keeps it
        below = {g: mean(v[b, 0, w] for w in g) + 1 for g in ((0, 1), (2, 3))}
        boards.append(max(weight * mean((v[b, 1, w] + 1) / below[g] for w in g) for g, weight in (((0, 1), 2), ((2, 3), 0.5))))
    return mean(boards), max(sum(max(v[b, m, w] for w in range(4)) for b in (0, 1)) for m in (0, 1))


@pytest.mark.parametrize("stage", [False, True])
def test_histories_are_scored_as_configured(spark, made, stage):
    _, root, rows = made
    catalog = open_catalog(spark, [f"file://{root}"])
    assert set(catalog.measurements) == {"FBC", "KLD"}
    got = compute_scores(catalog, file_from(json_with_comments(CONFIG)), persist=True, stage=stage)
    assert got.failed.isEmpty()
    by = {r["EpochNo"]: r for r in got.scores.collect()}
    for no, code, kld in ((1, 1, 6.0), (2, 0, 0.5)):
        ratio, top = expected(rows[no], code)
        assert (by[no]["ratio"], by[no]["top"], by[no]["kld"], by[no]["Score"]) == (pytest.approx(ratio), top, kld, pytest.approx(ratio + kld))
    assert {tuple(r) for r in got.dummy_used.collect()} == {("exp/Step1/Loop01#0002", "kld")}
    got.release()


def test_packed_epochs_score_like_loose_ones(spark, made, tmp_path):
    """The tables of one epoch in an archive, but for one that lies beside it; the other epoch all loose."""
    _, root, rows = made
    packed = tmp_path / "exp" / "Step1" / "Loop01" / "result_history"
    shutil.copytree(root, packed)
    first = packed / "result.0001"
    with tarfile.open(first / "all.tar.gz", "w:gz") as t:
        for f in sorted(first.glob("*.csv")):
            if f.name != "KLD.csv":
                t.add(f, f"wrapped/{f.name}")
                f.unlink()
    got = compute_scores(open_catalog(spark, {"x": f"file://{packed}"}), file_from(json_with_comments(CONFIG)), persist=True)
    by = {r["EpochNo"]: r for r in got.scores.collect()}
    for no, code, kld in ((1, 1, 6.0), (2, 0, 0.5)):
        ratio, top = expected(rows[no], code)
        assert (by[no]["Epoch"], by[no]["ratio"], by[no]["top"], by[no]["kld"]) == (f"x#000{no}", pytest.approx(ratio), top, kld)
    got.release()


def test_command_line(spark, made, capsys, tmp_path):
    base, root, rows = made
    main(["--config", f"file://{base}/run.jsonc", "--data-dir", f"file://{root}/result.0001"], spark)
    out = capsys.readouterr()
    ratio, top = expected(rows[1], 1)
    assert json.loads(out.out) == {"Score": pytest.approx(ratio + 6), "ratio": pytest.approx(ratio), "top": top, "kld": 6.0}
    assert "nowhere" in out.err
    main(["--config", f"file://{base}/run.jsonc", "--history", f"mine=file://{root}", "--out", f"file://{tmp_path}/scores"], spark)
    got = spark.read.option("header", True).csv(f"file://{tmp_path}/scores").collect()
    assert [r["Epoch"] for r in sorted(got, key=lambda r: r["Epoch"])] == ["mine#0001", "mine#0002"]
    dummies = spark.read.option("header", True).csv(f"file://{tmp_path}/scores.dummy").collect()
    assert [tuple(r) for r in dummies] == [("mine#0002", "kld")]
    for _ in (1, 2):
        main(["--config", f"file://{base}/run.jsonc", "--history", f"mine=file://{root}", "--out", f"file://{tmp_path}/again{_}", "--by-epoch"], spark)
    assert spark.read.parquet(f"file://{tmp_path}/again1").count() == 2
    (root / "result.0001" / "B9LS.json").write_text('{"numWLs": 4}')
    assert generation_info(spark, f"file://{root}/result.0001", "B9LS") == {"numWLs": 4} and generation_info(spark, f"file://{root}", "B9LS") == {}
    (root / "result.0001" / "B9LS.json").unlink()
    with pytest.raises(SystemExit):
        histories_of(["a=x", "y"])
    with pytest.raises(SystemExit):
        histories_of(["a=x", "a=y"])


def test_failures_name_step_and_values(spark, made, tmp_path):
    base, root, rows = made
    steps = {"WL": {"op": "sum", "weight": {"0": 1, "1": 2}}, "Board": {"op": "mean"}}
    (tmp_path / "weights.jsonc").write_text(json.dumps({"score_parts": [{"name": "w", "type": "FBC", "order": list(steps), "aggregations": steps}], "expression": "w"}))
    lacking = ", ".join(map(str, sorted({r[2] for r in rows[1]} - {0, 1})))
    told = f"w: the value is null or NaN (w: no weight for WL {lacking} at WL; w: null or NaN appeared at WL)"
    with pytest.raises(SystemExit) as stopped:
        main(["--config", f"file://{tmp_path}/weights.jsonc", "--data-dir", f"file://{root}/result.0001"], spark)
    assert str(stopped.value).endswith(told)
    main(["--config", f"file://{tmp_path}/weights.jsonc", "--history", f"mine=file://{root}", "--out", f"file://{tmp_path}/scores"], spark)
    failed = spark.read.option("header", True).option("escape", '"').csv(f"file://{tmp_path}/scores.failed").collect()
    assert {r["Epoch"] for r in failed} == {"mine#0001", "mine#0002"} and told in {r["reason"] for r in failed}


def test_configurations_that_cannot_run():
    part = {"name": "a", "type": "FBC"}
    with pytest.raises(SpecError, match="numerator_when"):
        file_from({"optimization": {"score_parts": [part | {"relative": {"split_axis": "s", "denominator_when": 1}}]}})
    with pytest.raises(SpecError, match="weight set"):
        file_from({"optimization": {"weightSets": {"w": {"a": "x"}}}})
    with pytest.raises(SpecError, match="true or false"):
        file_from({"optimization": {"WLgroup": {"a": [0, 1]}, "WLgroupDefinLogical": "maybe"}})
    with pytest.raises(SpecError, match="custom"):
        file_from({"score_parts": [{"name": "a", "type": "custom", "order": ["WL"]}]})
    assert file_from({"score_parts": [{"name": "mine", "type": "custom"}]}).parts[0].function == "mine"
    assert json_with_comments('{"a": "x // y, ]", /* b */ "c": [1, 2,],}') == {"a": "x // y, ]", "c": [1, 2]}


def test_functions_of_an_epochs_directory(spark, made, tmp_path):
    base, root, rows = made
    (tmp_path / "own.py").write_text(
        "def lines(ctx):\n    return len((ctx.data_dir / 'FBC.csv').read_text().splitlines()) - 1 + ctx.params['more']\n"
        "def kld(ctx):\n    return float((ctx.data_dir / 'KLD.csv').read_text().splitlines()[1].split(',')[-1])\n"
        "def told(ctx):\n    return float(ctx.generation == 'B9LS' and ctx.group_defs['G'].groups['a'] == (0, 1))\n"
        "def classic(catalog, params):\n    return catalog.measurements['FBC'].groupBy('Epoch').agg({'value': 'max'}).toDF('Epoch', 'value')\n"
    )
    load_functions(str(tmp_path / "own.py"))
    config = {"score_parts": [{"name": n, "type": "custom", "params": {"more": 0.5}} for n in ("lines", "told", "classic")]}
    file = replace(file_from(config), groups={"G": GroupDef("WL", {"a": (0, 1)})})
    got = {r["EpochNo"]: r for r in compute_scores(open_catalog(spark, [str(root)], generation="B9LS"), file).scores.collect()}
    assert {no: (r["lines"], r["told"], r["classic"]) for no, r in got.items()} == {no: (len(own) + 0.5, 1.0, max(x[-1] for x in own)) for no, own in rows.items()}
    lost = compute_scores(open_catalog(spark, [str(root)]), file_from({"score_parts": [{"name": "kld", "type": "custom"}]}))
    assert [(r["EpochNo"], r["kld"]) for r in lost.scores.collect()] == [(1, 4.0)]
    (failed,) = lost.failed.collect()
    assert "FileNotFoundError" in failed["reason"]
    (one,) = compute_scores(open_catalog(spark, data_dir=str(root / "result.0001")), file).scores.collect()
    assert (one["lines"], one["told"]) == (len(rows[1]) + 0.5, 0.0)
    with pytest.raises(ValueError, match="directories"):
        custom_part("lines", Catalog({}), {})


def test_bundles_rewritten_from_the_command_line(spark, made, tmp_path):
    _, root, rows = made
    source = tmp_path / "source"
    shutil.copytree(root / "result.0001", source)
    (source / "initial_temperature.csv").write_text("1,30.5\n0,28.25\n")
    (source / "B9LS.json").write_text('{"numWLs": 4}')
    (source / "note.csv").write_text('Name,Text\n1,"a, b"\n')
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    bundles([f"--data-dir={source}", f"--out={one}", "--single"], spark)
    bundles([f"--data-dir={one}", f"--out={many}", "--chips=1,2"], spark)
    own = sorted((m, w, s, float(v)) for b, m, w, s, v in rows[1] if b == 0)
    cat = open_catalog(spark, data_dir=one)
    assert sorted(map(tuple, cat.measurements["FBC"].select("Measure", "WL", "State", "value").collect())) == own
    assert [tuple(r) for r in cat.temperatures.select("Board", "temp").collect()] == [(0, 28.25)]
    assert generation_info(spark, many, "B9LS") == {"numWLs": 4}
    cat = open_catalog(spark, data_dir=many)
    got = sorted(tuple(r) for r in cat.measurements["FBC"].select("Board", "Chip", "Measure", "WL", "State", "value").collect())
    assert got == sorted((b, c, *x) for b, c in ((0, 0), (1, 0), (1, 1)) for x in own)
    assert sorted(tuple(r) for r in cat.temperatures.select("Board", "temp").collect()) == [(0, 28.25), (1, 28.25)]
    assert cat.maps["State"].count() == 2 and cat.labels["FBC"].count() == 6
    assert [r[0] for r in spark.read.text(f"{many}/note.csv").collect()] == ["Name,Text", '1,"a, b"']
    with pytest.raises(SpecError, match="more than one Board"):
        bundles([f"--data-dir={source}", f"--out={tmp_path / 'no'}", "--chips=2"], spark)
