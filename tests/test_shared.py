"""Parts that share one pass give what each gives alone."""

import math
import random

import pytest

from axisfold import queries
from axisfold.operators.resolve import Catalog
from axisfold.plans.score import compute_scores
from axisfold.plans.shared import prefix_of, shared_starts
from axisfold.plans.spec import GroupDef, Relative, ScoreFile, ScorePart, Step

MEAN, SUM, MIN, MAX = (Step(op) for op in ("mean", "sum", "min", "max"))
GROUPS = {"G": GroupDef("w", {"lo": (0, 1), "hi": (2, 9)}), "H": GroupDef("w", {"only": (0, 3)})}


def p(name, *order, **more):
    return ScorePart(name, more.pop("type_", "T"), tuple(a for a, _ in order), {a: s for a, s in order if s is not None}, **more)


PARTS = (
    p("plain", ("w", MEAN), ("s", SUM), ("b", MAX)),
    p("same", ("w", MEAN), ("s", SUM), ("b", MIN)),
    p("fused", ("w", SUM), ("b", SUM), ("s", SUM)),
    p("filtered", ("s", Step("filter", "x")), ("w", Step("mean", [0, 1, 2])), ("b", Step("sum", weight={"0": 2.0, "1": 0.5}))),
    p("several", ("b", Step("filter", [0, 1])), ("__mul__", Step("mul", {"x": 2.0, "y": 3.0}, by="s")), ("w", MIN), ("__abs__", Step("abs")), ("s", MEAN)),
    p("late filter", ("w", MEAN), ("s", Step("filter", "y")), ("__log__", Step("log", floor=0.1)), ("b", MEAN)),
    p("last filter", ("w", MEAN), ("b", MEAN), ("s", Step("filter", "y"))),
    p("grouped", ("w", MEAN), ("G", MAX), ("b", MEAN)),
    p("both", ("H", Step("filter", "only")), ("G", Step("filter", "hi")), ("w", MAX)),
    p("expr", ("w", SUM), ("s", Step("expr", expr="by['x'] / by['y'] + max(values)")), ("b", MEAN)),
    p("expr of repeats", ("b", Step("filter", [0, 1])), ("s", Step("expr", expr="max(values)"))),
    p("diff", ("w", SUM), ("b", MEAN), ("s", Step("diff", ["x", "y"]))),
    p("fuse", ("w", MEAN), ("b&s", Step("sum", ["0&x", "1&y"]))),
    p("later pairs", ("__add__", Step("add", 1)), ("w", MEAN), ("__relative__", None), ("b", MEAN), relative=Relative("s", "x", "y", "ratio", 1.0)),
    p("pairs", ("w", MEAN), ("b", MEAN), relative=Relative("s", "x", "y", "diff", 0.0, (("w", MEAN),))),
    p("other", ("w", MEAN), type_="U"),
    p("more", ("w", SUM), ("s", MEAN), type_="U"),
)


@pytest.fixture(scope="module")
def catalog(spark):
    draw, rows = random.Random(11), []
    for e in range(12):
        for _ in range(draw.randrange(1, 60)):
            x = math.nan if e == 7 and draw.random() < 0.1 else None if e == 8 and draw.random() < 0.1 else draw.randrange(-40, 40) / 4
            rows.append((e, draw.randrange(0, 5 if e == 9 else 4), draw.choice("xy" if e != 10 else "xyz"), None if e == 6 and draw.random() < 0.2 else draw.randrange(2), x))
    t = spark.createDataFrame(rows, "Epoch int, w int, s string, b int, value double")
    return Catalog({"T": t, "U": t.where("Epoch % 2 = 0").select("Epoch", "w", "s", "value")})


def told(got, names):
    scores = {r["Epoch"]: {n: None if r[n] is None else round(r[n], 9) for n in names} for r in got.scores.collect()}
    return scores, {r["Epoch"]: r["reason"] for r in got.failed.collect()}, sorted(map(tuple, got.dummy_used.collect()))


@pytest.mark.parametrize("chosen", [[x] for x in range(len(PARTS) - 2)] + [list(range(len(PARTS))), list(range(0, len(PARTS), 2))])
def test_shared_passes_change_nothing(catalog, chosen):
    parts = tuple(PARTS[i] for i in chosen) + ((PARTS[0], PARTS[3]) if len(chosen) == 1 and chosen[0] not in (0, 3) else ())
    file = ScoreFile(parts, groups=GROUPS, dummies={"U": 3.0})
    names = [x.name for x in parts]
    alone, together = (told(compute_scores(catalog, file, share=s), names) for s in (False, True))
    assert alone == together
    if len(chosen) == 1:
        assert len(alone[0]) + len(alone[1]) == 12


def test_prefixes_end_where_parts_differ():
    whole = {x.name: prefix_of(x.resolved({}, {}), GROUPS) for x in PARTS}
    assert whole["plain"][1] == 3 and whole["same"][1] == 3 and whole["fused"][1] == 3 and len(whole["fused"][0].levels) == 1
    assert whole["diff"][1] == 2 and whole["fuse"][1] == 1 and whole["later pairs"][1] == 2 and whole["pairs"][1] == 0 and whole["expr of repeats"][1] == 0
    assert whole["last filter"][1] == 2 and whole["grouped"][0].columns == ("G", "b", "w") and whole["both"][0].columns == ("G", "H", "w")


def test_equal_prefixes_run_once(catalog):
    file = ScoreFile(tuple(p(f"p{i}", ("w", MEAN), ("s", MEAN), ("b", op)) for i, op in enumerate((Step("expr", expr="max(values)"), Step("expr", expr="min(values)"), Step("diff", [0, 1])))))
    starts = shared_starts(catalog, file).starts
    assert len(starts) == 3 and len({str(df._jdf.queryExecution().analyzed().canonicalized()) for df, _ in starts.values()}) == 1


def test_scans_of_a_score_table(spark):
    """Beside the pass that two parts share, only the part that pairs rows reads the table: its two sides."""
    got = compute_scores(queries.catalog(spark, "/root/testdata/sf0.001"), queries.score_file(), share=True)
    plan = got.scores._jdf.queryExecution().executedPlan().toString()
    assert sum("lineitem.parquet" in x for x in plan.split("FileScan")[1:]) == 2
