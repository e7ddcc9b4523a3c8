"""The engine's operators as queries over the driver tables, with their SQL.

Roles: the epoch is the ship year, a board is a supplier, a measure is an order,
the state is the line status, and the value is the quantity.  Orders are the side
table, suppliers' nations the names, nations the code map, and account balances the
board temperatures.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import custom
from .operators import fold as fo
from .operators import lookup, quality, relative, synth, transforms
from .operators.resolve import Catalog
from .plans import presets
from .plans.part import score_part
from .plans.score import compute_scores
from .plans.spec import GroupDef, Relative, ScoreFile, ScorePart, Step, file_from, json_with_comments
from .sources import bundles, tables
from .sources.headers import header_index
from .sources.history import open_catalog
from .sources.shared import shared_dir
from .streaming.incremental import closed_epochs, current, late_rows, score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The base rows of the SQL side, under short names.
BASE = """
WITH b AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS epoch, l_suppkey AS board, l_orderkey AS measure,
         CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag, l_linestatus AS state, l_quantity AS v,
         o_orderpriority AS prio, CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN '1' ELSE 'false' END AS ovr, n_name AS nation
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey)
"""


def query(sql: str | None = None, base: bool = True):
    """Register a function as a query of its own name."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = (BASE if base else "") + sql
        return fn

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    qty = line.select(
        F.year("l_shipdate").alias("Epoch"),
        F.col("l_suppkey").alias("Board"),
        F.col("l_orderkey").alias("Measure"),
        F.col("l_linenumber").cast("long").alias("Line"),
        F.col("l_returnflag").alias("Flag"),
        F.col("l_linestatus").alias("State"),
        F.col("l_quantity").alias("value"),
    )
    override = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "1").otherwise("false")
    labels = orders.select(F.col("o_orderkey").alias("Measure"), F.col("o_orderpriority").alias("Priority"), override.alias("Read_Override"))
    names = supplier.select(F.col("s_suppkey").alias("Board"), F.col("s_nationkey").cast("long").alias("DataName"))
    codes = nation.select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("text"))
    steps = nation.select(F.lit("G").alias("generation"), (F.col("n_nationkey") * 4.0).alias("temp_key"), F.col("n_nationkey").alias("ord"), F.explode(F.array(F.lit("O"), F.lit("F"))).alias("state"))
    slope = -(F.lit(1.0) + F.col("ord") / 10 + F.when(F.col("state") == "F", 0.5).otherwise(0.0))
    calibration = steps.select("*", F.lit(0.0).alias("a"), slope.alias("b"))
    temps = supplier.select(F.col("s_suppkey").alias("Board"), (F.col("s_acctbal") / 100).alias("temp"))
    return Catalog({"QTY": qty, "FBC": qty}, {"QTY": labels, "FBC": labels}, {"QTY": names, "FBC": names}, {"DataName": codes}, temps, calibration, None, "G")


def six(x: str | Column = "value") -> Column:
    return F.round(x, 6)


def part(*order: tuple[str, Step], type_: str = "QTY", name: str = "p", **more) -> ScorePart:
    return ScorePart(name, type_, tuple(a for a, _ in order), dict(order), **more).resolved(SELECTIONS, WEIGHTS)


def result(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("reason").isNull()).select(F.col("Epoch").alias("epoch"), six().alias("value"))


def run(spark: SparkSession, sf_dir: str, p: ScorePart, groups=None) -> DataFrame:
    return result(score_part(catalog(spark, sf_dir), p, groups))


MEAN, SUM, MIN, MAX = Step("mean"), Step("sum"), Step("min"), Step("max")
SELECTIONS = {"first_lines": [1, 2, 3], "outer": ["A", "R"]}
WEIGHTS = {"flags": {"A": 0.5, "N": 1.0, "R": 2.0}, "tenth": 0.1, "lines": {"1": 0.5, "2": 1.0, "3": 2.0}}
GROUPS = {"LineGroup": GroupDef("Line", {"G1": (1, 3), "G2": (4, 7)})}


def nested(*folds: tuple[str, str], src: str = "b", keys: str = "epoch", v: str = "v", where: str = "true") -> str:
    """Nested group-bys: each fold (axes that stay, aggregate), from the inside out."""
    inner = f"SELECT *, {v} AS x FROM {src} WHERE {where}"
    for stay, agg in folds:
        cols = ", ".join(c for c in (keys, stay) if c)
        inner = f"SELECT {cols}, {agg.format('x')} AS x FROM ({inner}) GROUP BY {cols}"
    return f"SELECT epoch, round(x, 6) AS value FROM ({inner})"


# --- resolution ------------------------------------------------------------------


@query("SELECT prio AS priority, nation AS name, count(*) AS n, round(sum(v), 6) AS total FROM b GROUP BY prio, nation")
def resolve_side_map(spark, sf_dir):
    df = catalog(spark, sf_dir).resolve("QTY", ["Priority", "DataName"])
    return df.groupBy(F.col("Priority").alias("priority"), F.col("DataName").alias("name")).agg(F.count("*").alias("n"), six(F.sum("value")).alias("total"))


@query("SELECT epoch, upper(ovr) IN ('TRUE', '1') AS override, count(*) AS n FROM b GROUP BY ALL")
def resolve_override_bool(spark, sf_dir):
    df = catalog(spark, sf_dir).resolve("QTY", ["Read_Override"])
    return df.groupBy(F.col("Epoch").alias("epoch"), F.col("Read_Override").alias("override")).agg(F.count("*").alias("n"))


@query("SELECT epoch, prio AS priority, upper(ovr) IN ('TRUE', '1') AS override, nation AS name, flag, state, count(*) AS n, round(sum(v), 6) AS total FROM b GROUP BY ALL")
def full_expansion(spark, sf_dir):
    df = catalog(spark, sf_dir).expand("QTY")
    keys = {"Epoch": "epoch", "Priority": "priority", "Read_Override": "override", "DataName": "name", "Flag": "flag", "State": "state"}
    return df.groupBy(*[F.col(a).alias(b) for a, b in keys.items()]).agg(F.count("*").alias("n"), six(F.sum("value")).alias("total"))


# --- folds -----------------------------------------------------------------------


def _three(op: Step):
    return part(("Line", op), ("Flag", op), ("State", op))


@query(nested(("flag, state", "avg({})"), ("state", "avg({})"), ("", "avg({})")))
def fold_mean(spark, sf_dir):
    return run(spark, sf_dir, _three(MEAN))


@query(nested(("", "sum({})")))
def fold_sum(spark, sf_dir):
    return run(spark, sf_dir, _three(SUM))


@query(nested(("flag, state", "sum({})"), ("state", "avg({})"), ("", "min({})")))
def fold_min(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", SUM), ("Flag", MEAN), ("State", MIN)))


@query(nested(("flag, state", "avg({})"), ("state", "max({})"), ("", "max({})")))
def fold_max(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", MEAN), ("Flag", MAX), ("State", MAX)))


@query("""
SELECT epoch, board, bool_or(v = 50 AND line = 7) AS poisoned, count(*) AS n,
       CASE WHEN NOT bool_or(v = 50 AND line = 7) THEN min(v) END AS least, CASE WHEN NOT bool_or(v = 50 AND line = 7) THEN max(v) END AS most
FROM b GROUP BY epoch, board
""")
def fold_nan_poison(spark, sf_dir):
    df = catalog(spark, sf_dir).resolve("QTY", ["Board", "Line"])
    df = df.withColumn("value", F.when((F.col("value") == 50) & (F.col("Line") == 7), F.lit(float("nan"))).otherwise(F.col("value")))
    low, high = (fo.aggregate_axis(df, "Line", op).withColumnRenamed("value", op) for op in ("min", "max"))
    n = df.groupBy("Epoch", "Board").agg(F.count("*").alias("n"))
    both = low.join(high, ["Epoch", "Board"]).join(n, ["Epoch", "Board"])
    good = lambda c: F.when(~F.isnan(c), F.col(c))
    return both.select(F.col("Epoch").alias("epoch"), F.col("Board").alias("board"), (F.isnan("min") & F.isnan("max")).alias("poisoned"), "n", good("min").alias("least"), good("max").alias("most"))


@query(nested(("flag", "avg({})"), ("", "sum({})"), where="line IN (1, 2, 3)"))
def fold_select_subset(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", Step("mean", ref="first_lines")), ("Flag", SUM)))


@query(nested(("flag", "avg({})"), ("", "avg({})"), where="state = 'O'"))
def filter_scalar(spark, sf_dir):
    return run(spark, sf_dir, part(("State", Step("filter", "O")), ("Line", MEAN), ("Flag", MEAN)))


@query(nested(("line", "sum({})"), ("", "avg({})"), where="flag IN ('A', 'R')"))
def filter_in_duplicates(spark, sf_dir):
    return run(spark, sf_dir, part(("Flag", Step("filter", ref="outer")), ("State", SUM), ("Line", MEAN)))


_FLAG = "CASE flag WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.0 ELSE 2.0 END"


@query(nested(("flag", "avg({})"), ("", "sum({})")).replace("avg(x)", f"avg(x) * ({_FLAG})"))
def weight_dict(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", MEAN), ("Flag", Step("sum", weight={"A": 0.5, "N": 1.0, "R": 2.0}))))


@query(nested(("flag", "avg({})"), ("", "avg(0.1 * {})")))
def weight_scalar(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", MEAN), ("Flag", Step("mean", weight=0.1))))


@query(nested(("flag", "avg({})"), ("", "max({})")).replace("avg(x)", f"avg(x) * ({_FLAG})"))
def weight_ref(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", MEAN), ("Flag", Step("max", weight_ref="flags"))))


# --- row-wise steps --------------------------------------------------------------


@query(nested(("flag", "avg({})"), ("", "avg({})"), v="((v + 1) * 2 - 3) / 4"))
def transform_chain(spark, sf_dir):
    return run(spark, sf_dir, part(("__add__", Step("add", 1)), ("__mul__", Step("mul", 2)), ("__sub__", Step("sub", 3)), ("__div__", Step("div", 4)), ("Line", MEAN), ("Flag", MEAN)))


@query(nested(("flag", "avg({})"), ("", "sum({})"), v=f"v * ({_FLAG})"))
def transform_by(spark, sf_dir):
    return run(spark, sf_dir, part(("__mul__", Step("mul", by="Flag", ref="flags")), ("Line", MEAN), ("Flag", SUM)))


@query(nested(("flag", "avg({})"), ("", "sum({})"), v="v * 0.1"))
def transform_by_scalar(spark, sf_dir):
    return run(spark, sf_dir, part(("__mul__", Step("mul", by="Flag", ref="tenth")), ("Line", MEAN), ("Flag", SUM)))


@query(nested(("flag", "avg({})"), ("", "avg({})"), v="ln(greatest(abs(v - 25), 0.000001))"))
def transform_abs_log(spark, sf_dir):
    return run(spark, sf_dir, part(("__sub__", Step("sub", 25)), ("__abs__", Step("abs")), ("__log__", Step("log", floor=1e-6)), ("Line", MEAN), ("Flag", MEAN)))


# --- derived and combined axes ---------------------------------------------------


@query("""
SELECT epoch, round(max(x), 6) AS value FROM (SELECT epoch, g, avg(v) AS x FROM (
  SELECT epoch, line, CASE WHEN line BETWEEN 1 AND 3 THEN 'G1' ELSE 'G2' END AS g, sum(v) AS v FROM b GROUP BY ALL) GROUP BY epoch, g) GROUP BY epoch
""")
def group_ranges(spark, sf_dir):
    p = part(("Flag", SUM), ("Line", MEAN), ("LineGroup", MAX))
    return run(spark, sf_dir, p, GROUPS)


@query("""
SELECT epoch, CASE WHEN line BETWEEN 3 AND 5 THEN 'mid' WHEN line BETWEEN 1 AND 4 THEN 'low' WHEN line BETWEEN 4 AND 7 THEN 'high' END AS label, count(*) AS n
FROM b GROUP BY ALL
""")
def group_overlap_last_wins(spark, sf_dir):
    g = GroupDef("Line", {"high": (4, 7), "low": (1, 4), "mid": (3, 5)})
    df = transforms.with_groups(catalog(spark, sf_dir).resolve("QTY", ["Line"]), {"G": g}, set())
    return df.groupBy(F.col("Epoch").alias("epoch"), F.col("G").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT epoch, CASE WHEN line BETWEEN (SELECT max(line) FROM b) - 2 AND (SELECT max(line) FROM b) THEN 'first' ELSE 'rest' END AS label, round(avg(v), 6) AS value FROM b GROUP BY ALL")
def group_physical(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    groups = transforms.resolve_groups({"G": GroupDef("Line", {"first": (0, 2), "rest": (3, 7)}, logical=False)}, [cat.measurements["QTY"]])
    df = transforms.with_groups(cat.resolve("QTY", ["Line"]), groups, set())
    return df.groupBy(F.col("Epoch").alias("epoch"), F.col("G").alias("label")).agg(six(F.avg("value")).alias("value"))


@query("SELECT DISTINCT epoch, line FROM b WHERE NOT (line BETWEEN 1 AND 2 OR line BETWEEN 4 AND 5)")
def group_uncovered(spark, sf_dir):
    g = GroupDef("Line", {"a": (1, 2), "b": (4, 5)})
    return transforms.outside_groups(catalog(spark, sf_dir).resolve("QTY", ["Line"]), g).select(F.col("Epoch").alias("epoch"), F.col("Line").alias("line"))


@query("SELECT DISTINCT epoch, 'p: values of Line in no range of LineGroup: 7' AS reason FROM b WHERE epoch >= 1995 AND line = 7")
def group_coverage_failed(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    cat = Catalog({"QTY": cat.measurements["QTY"].where("Epoch >= 1995 OR Line < 7")})
    p = ScorePart("p", "QTY", ("Flag", "Line", "LineGroup"), {"Flag": SUM, "Line": MEAN, "LineGroup": MAX})
    got = compute_scores(cat, ScoreFile((p,), groups={"LineGroup": GroupDef("Line", {"G1": (1, 3), "G2": (4, 6)})}))
    return got.failed.select(F.col("Epoch").alias("epoch"), "reason")


def _combined(step: Step) -> ScorePart:
    # rows of one line number repeat, so the mean over them is the first fold
    return ScorePart("p", "QTY", ("Flag&State", "Line") if step.op == "filter" else ("Line", "Flag&State"), {"Flag&State": step, "Line": MEAN}).resolved(SELECTIONS, WEIGHTS)


@query("SELECT epoch, round(avg(v), 6) AS value FROM b WHERE (flag = 'A' AND state = 'F') OR (flag = 'R' AND state = 'O') GROUP BY epoch")
def combined_filter(spark, sf_dir):
    return run(spark, sf_dir, _combined(Step("filter", [{"Flag": "A", "State": "F"}, {"Flag": "R", "State": "O"}])))


@query(nested(("flag, state", "avg({})"), ("", "sum({})")))
def combined_sum(spark, sf_dir):
    return run(spark, sf_dir, _combined(SUM))


@query("SELECT epoch, round(avg(v) FILTER (WHERE flag = 'A' AND state = 'F') - avg(v) FILTER (WHERE flag = 'R' AND state = 'O'), 6) AS value FROM b GROUP BY epoch")
def combined_diff(spark, sf_dir):
    return run(spark, sf_dir, _combined(Step("diff", ["A&F", {"Flag": "R", "State": "O"}])))


@query("SELECT a.epoch, round(avg(a.x - c.x), 6) AS value FROM (SELECT epoch, line, sum(v) AS x FROM b WHERE flag = 'R' GROUP BY ALL) a JOIN (SELECT epoch, line, sum(v) AS x FROM b WHERE flag = 'A' GROUP BY ALL) c ON a.epoch = c.epoch AND a.line = c.line GROUP BY a.epoch")
def fold_diff(spark, sf_dir):
    return run(spark, sf_dir, part(("State", SUM), ("Flag", Step("diff", ["R", "A"])), ("Line", MEAN)))


_SUMS = "SELECT epoch, state, sum(v) FILTER (WHERE flag = 'A') AS a, sum(v) FILTER (WHERE flag = 'N') AS n, sum(v) FILTER (WHERE flag = 'R') AS r FROM b GROUP BY epoch, state"


@query(f"SELECT epoch, round(avg((r - a) / n + log10(r)), 6) AS value FROM ({_SUMS}) GROUP BY epoch")
def fold_expr_by(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", SUM), ("Flag", Step("expr", expr="(by['R'] - by['A']) / by['N'] + log(by['R'])")), ("State", MEAN)))


@query(f"SELECT epoch, round(avg(greatest(a, n, r) - least(a, n, r) + (a + n + r) / 3 ** 2 + sqrt((a + n + r) / 3)), 6) AS value FROM ({_SUMS}) GROUP BY epoch")
def fold_expr_values(spark, sf_dir):
    return run(spark, sf_dir, part(("Line", SUM), ("Flag", Step("expr", expr="max(values) - min(values) + sum(values) / 3 ** 2 + sqrt(mean(values))")), ("State", MEAN)))


# --- pairing ---------------------------------------------------------------------


def _pair(mode: str, offset: float = 0.0, pre=()) -> Relative:
    return Relative("Flag", "R", "A", mode, offset, tuple(pre))


_SIDES = "n AS (SELECT epoch, state, line, sum(v) AS x FROM b WHERE flag = 'R' GROUP BY ALL), d AS (SELECT epoch, state, line, sum(v) AS x FROM b WHERE flag = 'A' GROUP BY ALL)"


@query(f", {_SIDES} SELECT n.epoch, round(avg((n.x + 1) / (d.x + 1)), 6) AS value FROM n JOIN d USING (epoch, state, line) GROUP BY n.epoch")
def relative_ratio(spark, sf_dir):
    return _ratio(spark, sf_dir, "ratio", 1.0)


@query(f", {_SIDES} SELECT n.epoch, round(avg(n.x - d.x), 6) AS value FROM n JOIN d USING (epoch, state, line) GROUP BY n.epoch")
def relative_diff(spark, sf_dir):
    return _ratio(spark, sf_dir, "diff", 1.0)


def _ratio(spark, sf_dir, mode, offset):
    """Boards are summed first, so that pairs are unique; the mean is over state and line at once."""
    df = fo.aggregate_axis(catalog(spark, sf_dir).resolve("QTY", ["Board", "Flag", "State", "Line"]), "Board", "sum")
    pairs = relative.apply_relative(df, _pair(mode, offset))
    return result(fo.collapse(fo.aggregate_axis(fo.fuse_axes(pairs, "State&Line"), "State&Line", "mean")))


_FLAGSHIP = """
, d AS (SELECT epoch, grp, prio, avg(v) AS dv FROM g WHERE flag = 'A' AND state = 'O' GROUP BY ALL),
r AS (SELECT g.epoch, g.line, g.grp, g.prio, (g.v + 1) / (d.dv + 1) AS v FROM g LEFT JOIN d USING (epoch, grp, prio) WHERE flag = 'R' AND state = 'O'),
f AS (SELECT epoch, grp, prio, avg(v) AS v FROM r GROUP BY ALL)
SELECT epoch, round(avg(v), 6) AS value FROM (SELECT epoch, prio, max(v) AS v FROM f GROUP BY ALL) GROUP BY epoch
"""
_WITH_GROUP = ", g AS (SELECT *, CASE WHEN line BETWEEN 1 AND 3 THEN 'G1' ELSE 'G2' END AS grp FROM b)"


def flagship() -> ScorePart:
    cfg = _pair("ratio", 1.0, [("Line", MEAN)])
    steps = {"State": Step("filter", "O"), "Line": MEAN, "LineGroup": MAX, "Priority": MEAN}
    return ScorePart("flagship", "QTY", ("State", "Line", "LineGroup", "Priority"), steps, cfg).resolved({}, {})


@query(_WITH_GROUP + _FLAGSHIP)
def score_part_ratio(spark, sf_dir):
    return run(spark, sf_dir, flagship(), GROUPS)


@query(f", {_SIDES}, m AS (SELECT epoch, state, avg(x) AS x FROM d GROUP BY ALL) SELECT epoch, round(avg(v), 6) AS value FROM (SELECT n.epoch, n.state, max(n.x / m.x) AS v FROM n LEFT JOIN m USING (epoch, state) GROUP BY ALL) GROUP BY epoch")
def relative_preagg(spark, sf_dir):
    df = fo.aggregate_axis(catalog(spark, sf_dir).resolve("QTY", ["Board", "Flag", "State", "Line"]), "Board", "sum")
    pairs = relative.apply_relative(df, _pair("ratio", 0.0, [("Line", MEAN)]))
    return result(fo.collapse(fo.fold_all(pairs, ["Line", "State"], {"Line": MAX, "State": MEAN})))


@query("""
, d AS (SELECT epoch, state, avg(v * CASE line WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 2.0 END) AS dv FROM b WHERE flag = 'A' AND line IN (1, 2, 3) GROUP BY ALL)
SELECT epoch, round(avg(x), 6) AS value FROM (SELECT b.epoch, b.state, max(v / dv) AS x, bool_or(dv IS NULL) AS lost FROM b LEFT JOIN d USING (epoch, state) WHERE flag = 'R' GROUP BY ALL)
GROUP BY epoch HAVING NOT bool_or(lost)
""")
def preagg_weight_ref(spark, sf_dir):
    cfg = _pair("ratio", 0.0, [("Line", Step("mean", ref="first_lines", weight_ref="lines"))])
    return run(spark, sf_dir, ScorePart("p", "QTY", ("Line", "State"), {"Line": MAX, "State": MEAN}, cfg).resolved(SELECTIONS, WEIGHTS))


@query(", s AS (SELECT line, sum(v) AS x FROM b WHERE flag = 'R' GROUP BY line) SELECT line, round(x / (SELECT sum(v) FROM b WHERE flag = 'A'), 6) AS value FROM s")
def relative_scalar(spark, sf_dir):
    df = catalog(spark, sf_dir).resolve("QTY", ["Flag", "Line"]).drop("Epoch").groupBy("Flag", "Line").agg(F.sum("value").alias("value"))
    pairs = relative.apply_relative(df, _pair("ratio", 0.0, [("Line", SUM)]))
    return pairs.select(F.col("Line").alias("line"), six().alias("value"))


_BOARDS = "n AS (SELECT epoch, board, measure, sum(v) AS x FROM b WHERE flag = 'R' GROUP BY ALL), d AS (SELECT epoch, board, measure, sum(v) AS x FROM b WHERE flag = 'A' GROUP BY ALL)"


@query(f", {_BOARDS} SELECT n.epoch, count(*) AS n, count(*) FILTER (WHERE d.x IS NULL) AS unmatched FROM n LEFT JOIN d USING (epoch, board, measure) GROUP BY n.epoch")
def relative_missing_partner(spark, sf_dir):
    df = fo.aggregate_axis(catalog(spark, sf_dir).resolve("QTY", ["Board", "Measure", "Flag", "Line"]), "Line", "sum")
    pairs = relative.apply_relative(df, _pair("ratio"))
    return fo.probe(pairs).select(F.col("Epoch").alias("epoch"), F.col("rows").alias("n"), F.col("bad").alias("unmatched"))


@query(", d AS (SELECT epoch, board, line, count(*) AS k FROM b WHERE flag = 'A' GROUP BY ALL) SELECT b.epoch, count(*) FILTER (WHERE k IS NULL) AS without, count(*) FILTER (WHERE k = 1) AS single, count(*) FILTER (WHERE k > 1) AS several FROM b LEFT JOIN d USING (epoch, board, line) WHERE flag = 'R' GROUP BY b.epoch")
def relative_fan_out(spark, sf_dir):
    df = catalog(spark, sf_dir).resolve("QTY", ["Board", "Flag", "Line"])
    return relative.fan_out(df, _pair("ratio")).withColumnRenamed("Epoch", "epoch")


@query("""
SELECT n.epoch, round(avg((n.v + 1) / (d.v + 1)), 6) AS value FROM (SELECT * FROM b WHERE flag = 'R' AND state = 'F') n
LEFT JOIN (SELECT * FROM b WHERE flag = 'A') d ON n.epoch = d.epoch AND n.line = d.line AND n.state = d.state GROUP BY n.epoch HAVING NOT bool_or(d.v IS NULL)
""")
def relative_many_to_many(spark, sf_dir):
    """Every numerator row meets hundreds of denominator rows; the pairs are never made."""
    return run(spark, sf_dir, part(("State", Step("filter", "F")), ("Line", MEAN), relative=_pair("ratio", 1.0)))


# --- calibration -----------------------------------------------------------------

_KEYS = "SELECT s_suppkey AS board, s_acctbal / 100 AS temp, (SELECT arg_min(n_nationkey, struct_pack(d := abs(n_nationkey * 4.0 - s_acctbal / 100), o := n_nationkey)) FROM nation) AS o FROM supplier"


@query(f"SELECT board, round(temp, 6) AS temp, o * 4.0::DOUBLE AS temp_key FROM ({_KEYS})", base=False)
def nearest_key(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    got = lookup.nearest_key(cat.temperatures, cat.calibration)
    return got.select(F.col("Board").alias("board"), six("temp").alias("temp"), "temp_key")


@query(f", k AS ({_KEYS}), x AS (SELECT epoch, board, state, -log10(avg(v) / 100) / -(1.0 + o / 10.0 + CASE state WHEN 'F' THEN 0.5 ELSE 0.0 END) * 1000 AS v FROM b JOIN k USING (board) GROUP BY epoch, board, state, o) SELECT epoch, round(avg(v), 6) AS value FROM (SELECT epoch, state, max(v) AS v FROM x GROUP BY ALL) GROUP BY epoch")
def calibrated_budget(spark, sf_dir):
    p = part(("Line", MEAN), ("__div__", Step("div", 100)), ("__dvtbudget__", Step("abs")), ("Board", MAX), ("State", MEAN), type_="dVtBudget")
    return run(spark, sf_dir, p)


@query("SELECT CAST(1996 AS INTEGER) AS epoch, 'boards with several temperatures: ' || min(board) AS reason FROM b WHERE epoch = 1996")
def temperature_conflict(spark, sf_dir):
    from dataclasses import replace

    cat = catalog(spark, sf_dir)
    own = cat.measurements["FBC"].select("Epoch", "Board").distinct().join(cat.temperatures, "Board")
    least = own.where("Epoch = 1996").orderBy("Board").limit(1)
    cat = replace(cat, temperatures=own.unionByName(least.withColumn("temp", F.col("temp") + 60)))
    p = part(("Line", MEAN), ("__div__", Step("div", 100)), ("__dvtbudget__", Step("abs")), ("Board", MAX), ("State", MEAN), type_="dVtBudget")
    return score_part(cat, p).where(F.col("reason").isNotNull()).select(F.col("Epoch").alias("epoch"), "reason")


@query("SELECT DISTINCT epoch, board, state FROM b JOIN supplier ON board = s_suppkey WHERE state = 'F' ORDER BY 1, 2, 3 LIMIT 8")
def calibration_causes(spark, sf_dir):
    from dataclasses import replace

    cat = catalog(spark, sf_dir)
    cat = replace(cat, calibration=cat.calibration.where("state = 'O'"))
    p = part(("Board", MAX), ("State", MEAN), type_="dVtBudget")
    return quality.calibration_causes(cat, p).toDF("epoch", "board", "state")


# --- scores ----------------------------------------------------------------------


def score_file(**more) -> ScoreFile:
    parts = (
        ScorePart("ratio", "QTY", flagship().order, flagship().steps, flagship().relative),
        ScorePart("level", "QTY", ("Line", "Flag"), {"Line": MEAN, "Flag": MEAN}),
        ScorePart("span", "QTY", ("Flag", "Line"), {"Flag": SUM, "Line": Step("expr", expr="max(values) - min(values)")}),
    )
    return ScoreFile(parts, "0.5 * ratio + log(span) - level / 100", GROUPS, SELECTIONS, WEIGHTS, **more)


_PARTS = (
    _WITH_GROUP
    + _FLAGSHIP.replace("SELECT epoch, round(avg(v), 6) AS value FROM (SELECT epoch, prio, max(v) AS v FROM f GROUP BY ALL) GROUP BY epoch", "")
    + ", p1 AS (SELECT epoch, avg(v) AS ratio FROM (SELECT epoch, prio, max(v) AS v FROM f GROUP BY ALL) GROUP BY epoch)"
    + ", p2 AS (SELECT epoch, avg(v) AS level FROM (SELECT epoch, flag, avg(v) AS v FROM b GROUP BY ALL) GROUP BY epoch)"
    + ", p3 AS (SELECT epoch, max(v) - min(v) AS span FROM (SELECT epoch, line, sum(v) AS v FROM b GROUP BY ALL) GROUP BY epoch)"
)


@query(_PARTS + " SELECT epoch, round(0.5 * ratio + log10(span) - level / 100, 6) AS score, round(ratio, 6) AS ratio, round(level, 6) AS level, round(span, 6) AS span FROM p1 JOIN p2 USING (epoch) JOIN p3 USING (epoch)")
def score_table(spark, sf_dir):
    got = compute_scores(catalog(spark, sf_dir), score_file()).scores
    return got.select(F.col("Epoch").alias("epoch"), six("Score").alias("score"), six("ratio").alias("ratio"), six("level").alias("level"), six("span").alias("span")).orderBy("epoch")


CONFIG = """{
  "Generation": "G",  // as a run configuration writes it
  "optimization": {
    "groupDefs": {"LineGroup": {"axis": "Line", "groups": {"G1": [1, 3], "G2": [4, 7]}}},
    "selectionSets": {"chosen": [2, 3, 5]},
    "score_parts": [
      {"name": "level", "type": "QTY", "order": ["Line", "Flag"], "aggregations": {"Line": {"op": "mean"}, "Flag": {"op": "mean"}}},
      {"name": "top", "type": "QTY", "order": ["State", "Line", "LineGroup"],
       "aggregations": {"State": {"op": "filter", "value": "F"}, "Line": {"op": "sum"}, "LineGroup": {"op": "max"}}},
      /* selected by name */
      {"name": "chosen", "type": "QTY", "order": ["Line"], "aggregations": {"Line": {"op": "mean", "ref": "chosen"}}},
    ],
    "expression": "level + chosen - top / 1000",
  }
}"""


@query(
    ", p1 AS (SELECT epoch, avg(v) AS level FROM (SELECT epoch, flag, avg(v) AS v FROM b GROUP BY ALL) GROUP BY epoch)"
    ", p2 AS (SELECT epoch, max(v) AS top FROM (SELECT epoch, line <= 3 AS g, sum(v) AS v FROM b WHERE state = 'F' GROUP BY ALL) GROUP BY epoch)"
    ", p3 AS (SELECT epoch, avg(v) AS chosen FROM b WHERE line IN (2, 3, 5) GROUP BY epoch)"
    " SELECT epoch, round(level + chosen - top / 1000, 6) AS score, round(level, 6) AS level, round(top, 6) AS top, round(chosen, 6) AS chosen FROM p1 JOIN p2 USING (epoch) JOIN p3 USING (epoch)"
)
def score_config(spark, sf_dir):
    """A run configuration with comments, whose parts share one written table of resolved rows."""
    got = compute_scores(catalog(spark, sf_dir), file_from(json_with_comments(CONFIG)), stage=True).scores
    return got.select(F.col("Epoch").alias("epoch"), *[six(c).alias(c.lower()) for c in ("Score", "level", "top", "chosen")])


@query(ORACLE_SQL["score_table"], base=False)
def score_table_shared(spark, sf_dir):
    """The same scores, the first steps of the parts in one pass."""
    got = compute_scores(catalog(spark, sf_dir), score_file(), share=True).scores
    return got.select(F.col("Epoch").alias("epoch"), six("Score").alias("score"), six("ratio").alias("ratio"), six("level").alias("level"), six("span").alias("span"))


def _late(spark, sf_dir) -> tuple[Catalog, ScoreFile]:
    cat = catalog(spark, sf_dir)
    late = cat.measurements["QTY"].where("Epoch >= 1998")
    cat = Catalog({"QTY": cat.measurements["QTY"], "LATE": late})
    file = ScoreFile((ScorePart("all", "QTY", ("Line",), {"Line": MEAN}), ScorePart("late", "LATE", ("Flag", "Line"), {"Flag": Step("filter", "R"), "Line": MEAN})))
    return cat, file


@query(", e AS (SELECT DISTINCT epoch FROM b), p AS (SELECT DISTINCT epoch FROM b WHERE epoch >= 1998 AND flag = 'R') SELECT epoch, 'late: no rows' AS reason FROM e WHERE epoch NOT IN (SELECT epoch FROM p)")
def score_failed(spark, sf_dir):
    return compute_scores(*_late(spark, sf_dir)).failed.select(F.col("Epoch").alias("epoch"), "reason")


@query(", e AS (SELECT DISTINCT epoch FROM b), p AS (SELECT DISTINCT epoch FROM b WHERE epoch >= 1998 AND flag = 'R') SELECT epoch, 'late' AS part, CASE WHEN epoch < 1998 THEN 'resolved' ELSE 'Flag' END AS step, 'no rows left' AS what FROM e WHERE epoch NOT IN (SELECT epoch FROM p)")
def failed_causes(spark, sf_dir):
    cat, file = _late(spark, sf_dir)
    return quality.failed_causes(cat, file, compute_scores(cat, file).failed).withColumnRenamed("Epoch", "epoch")


@query(
    ", e AS (SELECT DISTINCT epoch FROM b), p AS (SELECT DISTINCT epoch FROM b WHERE epoch >= 1998 AND flag = 'R'), w AS (SELECT epoch, string_agg(line::VARCHAR, ', ' ORDER BY line) AS v FROM (SELECT DISTINCT epoch, line FROM b WHERE line > 3) GROUP BY epoch), l AS (SELECT epoch, epoch NOT IN (SELECT epoch FROM p) AS late FROM e)"
    " SELECT epoch, 'all: the value is null or NaN' || CASE WHEN late THEN '; late: no rows' ELSE '' END || ' (all: no weight for Line ' || v || ' at Line; all: null or NaN appeared at Line'"
    " || CASE WHEN late THEN '; late: no rows left at ' || CASE WHEN epoch < 1998 THEN 'resolved' ELSE 'Flag' END ELSE '' END || ')' AS reason FROM l JOIN w USING (epoch)"
)
def failed_reasons(spark, sf_dir):
    """Reasons that tell the step and the axis values without a weight."""
    cat, file = _late(spark, sf_dir)
    weighted = ScorePart("all", "QTY", ("Line",), {"Line": Step("sum", weight={"1": 1.0, "2": 0.5, "3": 2.0})})
    file = ScoreFile((weighted, file.parts[1]))
    return quality.explained(cat, file, compute_scores(cat, file).failed).withColumnRenamed("Epoch", "epoch")


@query("SELECT round(sum(2.0::DOUBLE) * 0.1, 6) AS value FROM nation", base=False)
def dummy_part(spark, sf_dir):
    p = part(("__log__", Step("log", floor=1e-6)), ("DataName", Step("sum", weight=0.1)))
    return synth.dummy_part(spark, catalog(spark, sf_dir), p, 2.0).select(six().alias("value"))


@query(", l AS (SELECT epoch, avg(v) AS v FROM b WHERE epoch >= 1998 GROUP BY epoch) SELECT e.epoch, round(coalesce(l.v, 7.0), 6) AS value, l.v IS NULL AS dummy FROM (SELECT DISTINCT epoch FROM b) e LEFT JOIN l USING (epoch)")
def dummy_fill(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    cat = Catalog({"QTY": cat.measurements["QTY"], "LATE": cat.measurements["QTY"].where("Epoch >= 1998")})
    file = ScoreFile((ScorePart("late", "LATE", ("Line",), {"Line": MEAN}),), dummies={"LATE": 7.0})
    got = compute_scores(cat, file)
    used = got.dummy_used.select("Epoch", F.lit(True).alias("dummy"))
    return got.scores.join(used, "Epoch", "left").select(F.col("Epoch").alias("epoch"), six("late").alias("value"), F.coalesce("dummy", F.lit(False)).alias("dummy"))


@query("SELECT epoch, round(sum(0.1 * ln(greatest(abs(v), 0.000001))), 6) AS value FROM (SELECT epoch, line, avg(v) AS v FROM (SELECT epoch, flag, line, avg(v) AS v FROM b GROUP BY ALL) GROUP BY ALL) GROUP BY epoch")
def preset_log_sum(spark, sf_dir):
    return run(spark, sf_dir, presets.log_sum("kld", "QTY", ("Board", "Flag"), "Line").resolved({}, {}))


@query("SELECT epoch, round(sum(abs(v)), 6) AS value FROM (SELECT epoch, line, avg(v) AS v FROM (SELECT epoch, flag, line, avg(v) AS v FROM b GROUP BY ALL) GROUP BY ALL) WHERE line IN (2, 3, 4, 5) GROUP BY epoch")
def preset_abs_sum(spark, sf_dir):
    return run(spark, sf_dir, presets.abs_sum("shift", "QTY", [2, 3, 4, 5], ("Board", "Flag"), "Line").resolved({}, {}))


# --- replicas --------------------------------------------------------------------


def _bundle(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("Board"), F.col("l_partkey").alias("Chip"), F.col("l_linenumber").alias("Line"), F.col("l_quantity").alias("value"))


_LOW = "x AS (SELECT * FROM lineitem WHERE l_suppkey = (SELECT min(l_suppkey) FROM lineitem)), y AS (SELECT * FROM x WHERE l_partkey = (SELECT min(l_partkey) FROM x))"


@query(f"WITH {_LOW} SELECT CAST(0 AS BIGINT) AS board, CAST(0 AS BIGINT) AS chip, l_linenumber AS line, l_quantity AS value FROM y", base=False)
def pseudo_single(spark, sf_dir):
    return synth.pseudo_single(_bundle(spark, sf_dir)).toDF("board", "chip", "line", "value")


@query(f"WITH {_LOW}, g AS (SELECT unnest([0, 0, 1, 1, 1])::BIGINT AS board, unnest([0, 1, 0, 1, 2])::BIGINT AS chip) SELECT board, chip, l_linenumber AS line, l_quantity AS value FROM y CROSS JOIN g", base=False)
def replicate_grid(spark, sf_dir):
    one = synth.pseudo_single(_bundle(spark, sf_dir))
    return synth.expand_boards_chips(one, [2, 3]).toDF("board", "chip", "line", "value")


@query(f"WITH {_LOW}, g AS (SELECT unnest([0, 0, 1, 1, 1])::BIGINT AS board, unnest([0, 1, 0, 1, 2])::BIGINT AS chip) SELECT board, chip, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS DOUBLE) AS value FROM y CROSS JOIN g", base=False)
def bundle_replicas(spark, sf_dir):
    made = shared_dir(spark)
    tables.write_bundle({"QTY": _bundle(spark, sf_dir)}, f"{made}/whole")
    bundles.single_bundle(spark, f"{made}/whole", f"{made}/single")
    bundles.replicate_bundle(spark, f"{made}/single", f"{made}/many", [2, 3])
    got = open_catalog(spark, data_dir=f"{made}/many").measurements["QTY"]
    return got.select(F.col("Board").alias("board"), F.col("Chip").alias("chip"), F.col("Line").alias("line"), "value")


# --- data quality ----------------------------------------------------------------


@query("""
SELECT 'QTY' AS type, axis, pos, value FROM (
  SELECT 'Board' AS axis, 0 AS pos, CAST(board AS VARCHAR) AS value FROM b UNION SELECT 'Measure', 1, CAST(measure AS VARCHAR) FROM b
  UNION SELECT 'Line', 2, CAST(line AS VARCHAR) FROM b UNION SELECT 'Flag', 3, flag FROM b UNION SELECT 'State', 4, state FROM b
  UNION SELECT 'Priority', 5, o_orderpriority FROM orders
  UNION SELECT 'Read_Override', 6, CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN '1' ELSE 'false' END FROM orders
  UNION SELECT 'DataName', 7, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
""")
def axis_catalog(spark, sf_dir):
    return quality.axis_catalog(catalog(spark, sf_dir), "QTY")


@query("""
SELECT 'QTY' AS type, axis, pos, value, lo, hi FROM (
  SELECT 'Board' AS axis, 0 AS pos, NULL AS value, CAST(min(board) AS VARCHAR) AS lo, CAST(max(board) AS VARCHAR) AS hi FROM b HAVING count(DISTINCT board) > 7
  UNION ALL SELECT DISTINCT 'Board', 0, CAST(board AS VARCHAR), NULL, NULL FROM b WHERE (SELECT count(DISTINCT board) FROM b) <= 7
  UNION ALL SELECT 'Measure', 1, NULL, CAST(min(measure) AS VARCHAR), CAST(max(measure) AS VARCHAR) FROM b
  UNION ALL SELECT DISTINCT 'Line', 2, CAST(line AS VARCHAR), NULL, NULL FROM b
  UNION ALL SELECT DISTINCT 'Flag', 3, flag, NULL, NULL FROM b UNION ALL SELECT DISTINCT 'State', 4, state, NULL, NULL FROM b
  UNION ALL SELECT DISTINCT 'Priority', 5, o_orderpriority, NULL, NULL FROM orders
  UNION ALL SELECT DISTINCT 'Read_Override', 6, CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN '1' ELSE 'false' END, NULL, NULL FROM orders
  UNION ALL SELECT 'DataName', 7, NULL, CAST(min(s_nationkey) AS VARCHAR), CAST(max(s_nationkey) AS VARCHAR) FROM supplier HAVING count(DISTINCT s_nationkey) > 7
  UNION ALL SELECT DISTINCT 'DataName', 7, n_name, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE (SELECT count(DISTINCT s_nationkey) FROM supplier) <= 7)
""")
def bounded_catalog(spark, sf_dir):
    return quality.bounded_catalog(catalog(spark, sf_dir), "QTY", most=7).drop("size")  # estimates; their error is tested


@query("SELECT CAST(n_nationkey AS BIGINT) AS code, n_name AS text FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)", base=False)
def axis_candidates(spark, sf_dir):
    cat = catalog(spark, sf_dir)
    return quality.candidates(cat.maps["DataName"], cat.names["QTY"].select(F.col("DataName").alias("code")))


@query("SELECT DISTINCT measure, nation AS name FROM b")
def measure_labels(spark, sf_dir):
    return quality.measure_labels(catalog(spark, sf_dir), "QTY").select(F.col("Measure").alias("measure"), F.col("DataName").alias("name"))


@query("SELECT * FROM (VALUES ('a', 'QTY', 'Flag', 'X'), ('a', 'QTY', 'Line', '9'), ('b', 'QTY', 'State', 'Z')) t(part, type, axis, value) WHERE value NOT IN (SELECT flag FROM b UNION SELECT CAST(line AS VARCHAR) FROM b UNION SELECT state FROM b)")
def spec_mismatch(spark, sf_dir):
    a = ScorePart("a", "QTY", ("Flag", "Line"), {"Flag": Step("filter", ["A", "X"]), "Line": Step("sum", [1, 9])})
    b = ScorePart("b", "QTY", ("Line",), {"Line": MEAN}, Relative("State", "O", "Z"))
    return quality.spec_mismatch(spark, ScoreFile((a, b)), quality.axis_catalog(catalog(spark, sf_dir), "QTY"))


@query(", i AS (SELECT unnest(range(0, (SELECT max(line) + 1 FROM b))) AS i), o AS (SELECT i, i - row_number() OVER (ORDER BY i) AS r FROM i WHERE NOT (i BETWEEN 2 AND 3 OR i = 5)) SELECT min(i) AS lo, max(i) AS hi FROM o GROUP BY r")
def range_gaps(spark, sf_dir):
    n = catalog(spark, sf_dir).measurements["QTY"].agg((F.max("Line") + 1).alias("n"))
    return quality.range_gaps(n, GroupDef("Line", {"a": (2, 3), "b": (5, 5)}))


@query("SELECT * FROM (SELECT 'Line' AS axis, CAST(9 AS BIGINT) AS declared, max(line) + 1 AS observed FROM b UNION ALL SELECT 'Board', 100, max(board) + 1 FROM b) WHERE declared <> observed")
def count_mismatch(spark, sf_dir):
    observed = catalog(spark, sf_dir).measurements["QTY"].agg(*[(F.max(a) + 1).alias(a) for a in ("Line", "Board")])
    observed = observed.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("observed")) for a in ("Line", "Board")])).alias("x")).select("x.*")
    declared = spark.createDataFrame([("Line", 9), ("Board", 100)], "axis string, declared long")
    return quality.count_mismatch(declared, observed)


@query("SELECT 'lost' AS part, 'XYZ' AS type WHERE 'XYZ' NOT IN (SELECT event_type FROM events)", base=False)
def parts_without_data(spark, sf_dir):
    file = ScoreFile((ScorePart("lost", "XYZ"), ScorePart("there", "click")))
    return quality.parts_without_data(spark, file, read(spark, sf_dir, "events").select(F.col("event_type").alias("type")))


@query("SELECT n_name AS key FROM nation WHERE n_name NOT IN ('NATION_0', 'NATION_1')", base=False)
def threshold_unmatched(spark, sf_dir):
    keys = [r[0] for r in read(spark, sf_dir, "nation").select("n_name").collect()]
    file = ScoreFile((ScorePart("NATION_0", "QTY"), ScorePart("NATION_1", "QTY")), thresholds={k: 1.0 for k in keys})
    return quality.unmatched_thresholds(spark, file)


def _lossy() -> ScorePart:
    return part(("Flag", Step("filter", "R")), ("State", Step("filter", "O")), ("__mul__", Step("mul", by="Line", value={str(i): 1.0 for i in range(1, 7)})), ("Line", MEAN))


_STEPS = """
, r AS (SELECT epoch, count(*) AS n0, count(*) FILTER (WHERE flag = 'R') AS n1, count(*) FILTER (WHERE flag = 'R' AND state = 'O') AS n2, count(*) FILTER (WHERE flag = 'R' AND state = 'O' AND line = 7) AS b3 FROM b GROUP BY epoch)
"""


@query(_STEPS + """
SELECT epoch, 0 AS at, 'resolved' AS step, n0 AS "rows", CAST(0 AS BIGINT) AS bad FROM r UNION ALL SELECT epoch, 1, 'Flag', n1, 0 FROM r UNION ALL SELECT epoch, 2, 'State', n2, 0 FROM r
UNION ALL SELECT epoch, 3, '__mul__', n2, b3 FROM r UNION ALL SELECT epoch, 4, 'Line', CASE WHEN n2 > 0 THEN 1 ELSE 0 END, CASE WHEN b3 > 0 THEN 1 ELSE 0 END FROM r
""")
def step_metrics(spark, sf_dir):
    return quality.step_metrics(catalog(spark, sf_dir), _lossy()).withColumnRenamed("Epoch", "epoch")


@query(_STEPS + "SELECT epoch, CASE WHEN n1 = 0 THEN 'Flag' WHEN n2 = 0 THEN 'State' ELSE '__mul__' END AS step, CASE WHEN n1 = 0 OR n2 = 0 THEN 'no rows left' ELSE 'null or NaN appeared' END AS what FROM r WHERE n1 = 0 OR n2 = 0 OR b3 > 0")
def first_offence(spark, sf_dir):
    return quality.first_offence(quality.step_metrics(catalog(spark, sf_dir), _lossy())).withColumnRenamed("Epoch", "epoch")


@query("SELECT epoch, count(*) FILTER (WHERE flag = 'R') AS numerator_rows, count(*) FILTER (WHERE flag = 'X') AS denominator_rows, CASE WHEN count(*) FILTER (WHERE flag = 'R') = 0 THEN 'no numerator rows' ELSE 'no denominator rows' END AS cause FROM b GROUP BY epoch")
def step_causes(spark, sf_dir):
    p = part(("Line", MEAN), relative=Relative("Flag", "R", "X"))
    return quality.relative_causes(catalog(spark, sf_dir), p).withColumnRenamed("Epoch", "epoch")


@query("SELECT DISTINCT epoch, 'Flag' AS step, 'the filter matches nothing' AS cause FROM b")
def filter_causes(spark, sf_dir):
    p = part(("Flag", Step("filter", "X")), ("State", Step("filter", "O")), ("Line", MEAN))
    return quality.filter_causes(catalog(spark, sf_dir), p).withColumnRenamed("Epoch", "epoch")


# --- user functions, epochs, streams ---------------------------------------------


def _mean_plus(cat: Catalog, params) -> DataFrame:
    return cat.measurements["QTY"].groupBy("Epoch").agg((F.avg("value") + params["offset"]).alias("value"))


custom.register("mean_plus", _mean_plus)


@query("SELECT epoch, round(avg(v) + 3, 6) AS value FROM b GROUP BY epoch")
def custom_part(spark, sf_dir):
    return result(custom.custom_part("mean_plus", catalog(spark, sf_dir), {"offset": 3.0}))


@query("SELECT epoch, CASE WHEN epoch <> 1996 THEN round(median(v), 6) END AS value, epoch = 1996 AS failed FROM b GROUP BY epoch")
def custom_by_epoch(spark, sf_dir):
    def middle(rows, params):
        if rows["Epoch"].iloc[0] == params["broken"]:
            raise ValueError("broken")
        rows = rows.sort_values("value")
        upto, n = rows["n"].cumsum(), rows["n"].sum()
        at = lambda k: rows["value"][upto > k].iloc[0]
        return float((at((n - 1) // 2) + at(n // 2)) / 2)

    # counted first: an epoch has as many rows as there are values
    counts = catalog(spark, sf_dir).measurements["QTY"].groupBy("Epoch", "value").agg(F.count("*").alias("n"))
    got = custom.by_epoch(counts, middle, {"broken": 1996})
    return got.select(F.col("Epoch").alias("epoch"), six().alias("value"), F.col("reason").isNotNull().alias("failed"))


class Quantile(custom.Aggregate):
    """A quantile of whole numbers from counts by value, as a sketch whose states merge."""

    def rows(self, catalog, params):
        return catalog.measurements[params["type"]].select("Epoch", "value")

    def zero(self, params):
        return {"at": params["at"], "broken": params.get("broken"), "counts": {}}

    def update(self, state, rows):
        if rows["Epoch"].iloc[0] == state["broken"]:
            raise ValueError("broken")
        for v, n in rows["value"].value_counts().items():
            state["counts"][v] = state["counts"].get(v, 0) + n
        return state

    def merge(self, state, other):
        for v, n in other["counts"].items():
            state["counts"][v] = state["counts"].get(v, 0) + n
        return state

    def finish(self, state):
        left = math.ceil(state["at"] * sum(state["counts"].values()))
        for v, n in sorted(state["counts"].items()):
            left -= n
            if left <= 0:
                return float(v)


custom.register("quantile", Quantile())


@query("SELECT epoch, CASE WHEN epoch <> 1996 THEN quantile_disc(v, 0.9) END AS value, epoch = 1996 AS failed FROM b GROUP BY epoch")
def custom_mergeable(spark, sf_dir):
    """A user's sketch over whole epochs, of which no task sees more than its own rows."""
    got = custom.custom_part("quantile", catalog(spark, sf_dir), {"type": "QTY", "at": 0.9, "broken": 1996})
    return got.select(F.col("Epoch").alias("epoch"), "value", F.col("reason").isNotNull().alias("failed"))


_PATHS = "SELECT '/data/exp/Step' || (o_custkey % 3) || '/Loop0' || (o_custkey % 2) || '/result_history/result.' || lpad(CAST(o_custkey % 50 AS VARCHAR), 4, '0') || '/' || o_orderstatus || '.csv' AS path FROM orders"


def _files(spark, sf_dir) -> DataFrame:
    c = F.col("o_custkey")
    path = F.format_string("/data/exp/Step%d/Loop0%d/result_history/result.%04d/%s.csv", c % 3, c % 2, c % 50, F.col("o_orderstatus"))
    p = F.col("path")
    named = read(spark, sf_dir, "orders").select(path.alias("path")).distinct()
    return named.select("path", tables.epoch_of(p).alias("Epoch"), tables.label_of(p).alias("History"), tables.epoch_no_of(p).alias("EpochNo"), F.regexp_extract(p, tables.TABLE_FILE, 1).alias("name"))


@query(f"SELECT DISTINCT regexp_extract(path, 'exp/Step[0-9]+/Loop[0-9]+') || '#' || regexp_extract(path, 'result\\.(\\d+)', 1) AS epoch, regexp_extract(path, 'exp/Step[0-9]+/Loop[0-9]+') AS history, CAST(regexp_extract(path, 'result\\.(\\d+)', 1) AS BIGINT) AS epoch_no FROM ({_PATHS})", base=False)
def epoch_ids(spark, sf_dir):
    return tables.enumerate_epochs(_files(spark, sf_dir)).toDF("epoch", "history", "epoch_no")


@query(f"WITH f AS (SELECT DISTINCT regexp_extract(path, 'exp/Step[0-9]+/Loop[0-9]+') || '#' || regexp_extract(path, 'result\\.(\\d+)', 1) AS epoch, regexp_extract(path, '([A-Z])\\.csv', 1) AS name FROM ({_PATHS})), e AS (SELECT DISTINCT epoch FROM f), n AS (SELECT epoch, unnest(['F', 'O', 'P', 'Q']) AS name FROM e) SELECT n.epoch, 'missing: ' || string_agg(n.name, ', ' ORDER BY n.name) AS reason FROM n LEFT JOIN f USING (epoch, name) WHERE f.name IS NULL GROUP BY n.epoch", base=False)
def epoch_validate(spark, sf_dir):
    files = _files(spark, sf_dir)
    return tables.missing_files(tables.enumerate_epochs(files), files, ["F", "O", "P", "Q"]).toDF("epoch", "reason")


@query("SELECT strftime(ts, '%Y-%m-%d') AS epoch, round(avg(value) FILTER (WHERE event_type = 'purchase') + avg(value) FILTER (WHERE event_type = 'click'), 6) AS score FROM events GROUP BY 1 HAVING score IS NOT NULL", base=False)
def stream_scores(spark, sf_dir):
    source = f"{sf_dir}/event[s].parquet"
    events = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 50).parquet(source)
    rows = events.select(F.date_format("ts", "yyyy-MM-dd").alias("Epoch"), F.col("event_type").alias("type"), (F.col("user_id") % 10).alias("User"), "value")
    names = ("purchase", "click")
    file = ScoreFile(tuple(ScorePart(n, n, ("User",), {"User": MEAN}) for n in names), "purchase + click")

    def split(df: DataFrame) -> Catalog:
        return Catalog({n: df.where(F.col("type") == n).select("Epoch", "User", "value") for n in names})

    out = shared_dir(spark)
    score_stream(rows, split, file, out, f"{out}/checkpoint", names).awaitTermination()
    return current(spark, out)[0].select(F.col("Epoch").alias("epoch"), six("Score").alias("score"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS epoch, round(sum(value) FILTER (WHERE event_type = 'purchase') + sum(value) FILTER (WHERE event_type = 'click'), 6) AS score FROM events GROUP BY 1 HAVING score IS NOT NULL", base=False)
def stream_two_batches(spark, sf_dir):
    """Every table of every epoch comes in two batches, of which the second completes the sums."""
    events = read(spark, sf_dir, "events")
    rows = events.select(F.date_format("ts", "yyyy-MM-dd").alias("Epoch"), F.col("event_type").alias("type"), (F.col("user_id") % 10).alias("User"), "value")
    out = shared_dir(spark)
    for half in (0, 1):
        rows.where(F.col("User") % 2 == half).coalesce(1).write.parquet(f"{out}/in/half={half}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in/half=*")
    names = ("purchase", "click")
    file = ScoreFile(tuple(ScorePart(n, n, ("User",), {"User": SUM}) for n in names), "purchase + click")

    def split(df: DataFrame) -> Catalog:
        return Catalog({n: df.where(F.col("type") == n).select("Epoch", "User", "value") for n in names})

    score_stream(stream, split, file, out, f"{out}/checkpoint", names).awaitTermination()
    return current(spark, out)[0].select(F.col("Epoch").alias("epoch"), six("Score").alias("score"))


_DAYS = "WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS epoch, date_trunc('day', ts) AS d, event_type, value, user_id % 10 % 2 AS half FROM events), w AS (SELECT max(d) FILTER (WHERE half = 0) - INTERVAL 10 DAY AS w FROM e)"


def _closing_stream(spark, sf_dir) -> str:
    """Three batches: early days, ten later days by which the early ones close, and the other half of all days."""
    events = read(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    rows = events.select(F.date_format("ts", "yyyy-MM-dd").alias("Epoch"), F.col("event_type").alias("type"), (F.col("user_id") % 10).alias("User"), "value", day.alias("day"))
    reached = rows.where("User % 2 = 0").agg(F.expr("max(day) - INTERVAL 10 DAY").alias("w"))
    dealt = rows.crossJoin(F.broadcast(reached)).withColumn("part", F.when(F.col("User") % 2 == 1, 2).when(F.col("day") < F.col("w"), 0).otherwise(1)).drop("w")  # one row
    out = shared_dir(spark)
    for i in range(3):
        dealt.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{out}/in/part={i}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in/part=*")
    names = ("purchase", "click")
    file = ScoreFile(tuple(ScorePart(n, n, ("User",), {"User": SUM}) for n in names), "purchase + click")

    def split(df: DataFrame) -> Catalog:
        return Catalog({n: df.where(F.col("type") == n).select("Epoch", "User", "value") for n in names})

    score_stream(stream, split, file, out, f"{out}/checkpoint", names, "day", timedelta(days=10)).awaitTermination()
    return out


@query(_DAYS + ", k AS (SELECT e.*, d < w AS closed FROM e, w WHERE half = 0 OR d >= w) SELECT epoch, round(sum(value) FILTER (WHERE event_type = 'purchase') + sum(value) FILTER (WHERE event_type = 'click'), 6) AS score, closed FROM k GROUP BY epoch, closed HAVING score IS NOT NULL", base=False)
def stream_closing(spark, sf_dir):
    """Scores of open and closed days; what came after a day closed doesn't count."""
    out = _closing_stream(spark, sf_dir)
    done = closed_epochs(spark, out).withColumn("closed", F.lit(True))
    return current(spark, out)[0].join(done, "Epoch", "left").select(F.col("Epoch").alias("epoch"), six("Score").alias("score"), F.coalesce("closed", F.lit(False)).alias("closed"))


@query(_DAYS + ' SELECT epoch, count(*) AS "rows" FROM e, w WHERE half = 1 AND d < w GROUP BY epoch', base=False)
def stream_late_rows(spark, sf_dir):
    return late_rows(spark, _closing_stream(spark, sf_dir)).withColumnRenamed("Epoch", "epoch")


# --- sources and sinks: tables written as the sources expect them, and read back --------


def _epoch_dir(base: str, no: int) -> str:
    return f"{base}/exp/Step1/Loop01/result_history/result.{no:04d}"


def _years(df: DataFrame) -> list[int]:
    return [r[0] for r in df.select("Epoch").distinct().orderBy("Epoch").collect()]


@query("SELECT 'exp/Step1/Loop01#' || epoch AS epoch, line, count(*) AS n, round(sum(v), 6) AS total FROM b GROUP BY epoch, line")
def source_measurements(spark, sf_dir):
    """Plain and gzipped tables with their columns in two orders."""
    rows = catalog(spark, sf_dir).measurements["QTY"].select("Epoch", "Board", "Line", F.col("value").alias("QTY"))
    base = shared_dir(spark)
    for no in _years(rows):
        own = rows.where(F.col("Epoch") == no).drop("Epoch")
        own = own.select("QTY", "Line", "Board") if no % 2 else own
        own.write.option("header", True).option("compression", "gzip" if no % 3 else "none").csv(f"{_epoch_dir(base, no)}/QTY.csv")
    got = tables.read_measurement(spark, _epoch_dir(base, 0)[:-5] + ".*/QTY.csv", "QTY")
    return got.groupBy(F.col("Epoch").alias("epoch"), F.col("Line").alias("line")).agg(F.count("*").alias("n"), six(F.sum("value")).alias("total"))


def _write_archives(rows: DataFrame, base: str) -> None:
    """One zip for each epoch, its table in a wrapping directory; rows stream into it in epoch order."""
    import io

    def run(batches):
        import zipfile

        import pyarrow as pa
        from pyarrow import csv
        from pyarrow.fs import FileSystem

        now, packed, member, done = None, None, None, 0
        for b in batches:
            epochs = b.column(0).to_numpy()
            cuts = [0, *[i for i in range(1, len(epochs)) if epochs[i] != epochs[i - 1]], len(epochs)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if epochs[lo] != now:
                    if member is not None:
                        member.close(), packed.close(), out.close()  # noqa: F821
                    now, done = epochs[lo], done + 1
                    system, path = FileSystem.from_uri(f"{_epoch_dir(base, now)}/all.zip")
                    system.create_dir(path.rsplit("/", 1)[0])
                    out = system.open_output_stream(path)
                    packed = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    member = packed.open("wrapped/QTY.csv", "w")
                    member.write(b"Line,Board,QTY\n")
                text = io.BytesIO()
                csv.write_csv(pa.Table.from_batches([b.slice(lo, hi - lo).select([1, 2, 3])]), text, csv.WriteOptions(include_header=False))
                member.write(text.getvalue())
        if member is not None:
            member.close(), packed.close(), out.close()
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    rows.repartition("Epoch").sortWithinPartitions("Epoch").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query("SELECT 'exp/Step1/Loop01#' || epoch AS epoch, line, count(*) AS n, round(sum(v), 6) AS total FROM b GROUP BY epoch, line")
def source_archives(spark, sf_dir):
    """Epochs as archives, and one as a loose gzipped table beside an archive that lacks it."""
    rows = catalog(spark, sf_dir).measurements["QTY"].select("Epoch", "Line", "Board", F.col("value").alias("QTY"))
    base = shared_dir(spark)
    base = base if "://" in base else "file://" + base.removeprefix("file:")
    _write_archives(rows.where("Epoch <> 1996"), base)
    rows.where("Epoch = 1996").drop("Epoch").write.option("header", True).option("compression", "gzip").csv(f"{_epoch_dir(base, 1996)}/loose")
    lines = tables.archive_lines(spark, f"{_epoch_dir(base, 0)[:-5]}.*/all.zip")
    loose = tables.loose_lines(spark, f"{_epoch_dir(base, 1996)}/loose/*.csv.gz").where("pos > 0")
    got = tables.measurement_of_lines(lines, "QTY", ["Line"]).select("Epoch", "Line", "value")
    cells = F.split("line", ",")
    got = got.unionByName(loose.select("Epoch", cells[0].cast("long").alias("Line"), cells[2].cast("double").alias("value")))
    return got.groupBy(F.col("Epoch").alias("epoch"), F.col("Line").alias("line")).agg(F.count("*").alias("n"), six(F.sum("value")).alias("total"))


@query("SELECT DISTINCT l_returnflag AS type FROM lineitem WHERE l_returnflag <> 'N' UNION SELECT DISTINCT l_linestatus FROM lineitem", base=False)
def detected_types(spark, sf_dir):
    """Tables with and without a column of their own name, and side tables, told apart by their first bytes."""
    line, base = read(spark, sf_dir, "lineitem"), shared_dir(spark)
    for flag in [r[0] for r in line.select("l_returnflag").distinct().collect()]:
        named = flag if flag != "N" else "other"
        line.where(F.col("l_returnflag") == flag).select(F.col("l_linenumber").alias("Line"), F.col("l_quantity").alias(named)).write.option("header", True).csv(f"{_epoch_dir(base, 1)}/{flag}.csv")
    for state in [r[0] for r in line.select("l_linestatus").distinct().collect()]:
        line.where(F.col("l_linestatus") == state).select(F.lit(0).alias("InBatchEpoch"), F.col("l_orderkey").alias("Measure")).distinct().write.option("header", True).csv(f"{_epoch_dir(base, 1)}/dataName_{state}.csv")
    return tables.detect_types(header_index(spark, f"{_epoch_dir(base, 1)}/*.csv"))


def _side(spark, sf_dir, file: str, column: str, code: Column) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    rows = orders.select(F.lit(0).alias("InBatchEpoch"), F.lit(0).alias("Board"), F.col("o_orderkey").alias("Measure"), code.alias(column))
    empty = rows.limit(1).select(*[F.lit(None).cast("long").alias(c) for c in rows.columns])
    base = shared_dir(spark)
    rows.unionByName(empty).write.option("header", True).csv(f"{_epoch_dir(base, 1)}/{file}")
    got = tables.read_side(spark, f"{_epoch_dir(base, 1)}/{file}")
    return got.groupBy(F.col("Epoch").alias("epoch"), F.col(column).alias("code")).agg(F.count("*").alias("n"), F.max("Measure").alias("last"))


_SIDE_SQL = "SELECT 'exp/Step1/Loop01#0001' AS epoch, CAST(o_custkey % {} AS BIGINT) AS code, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 2"


@query(_SIDE_SQL.format(3), base=False)
def source_labels(spark, sf_dir):
    return _side(spark, sf_dir, "parameterLabel_QTY.csv", "Read_Label", F.col("o_custkey") % 3)


@query(_SIDE_SQL.format(4), base=False)
def source_names(spark, sf_dir):
    return _side(spark, sf_dir, "dataName_QTY.csv", "DataName", F.col("o_custkey") % 4)


@query("SELECT 'DataName' AS map_name, CAST(n_nationkey AS BIGINT) AS code, n_name AS text FROM nation", base=False)
def source_maps(spark, sf_dir):
    base = shared_dir(spark)
    for no in (1, 2):
        path = f"{_epoch_dir(base, no)}/map_DataName.csv"
        read(spark, sf_dir, "nation").select("n_nationkey", "n_name").coalesce(1).write.csv(path)
    return tables.read_map(spark, f"{_epoch_dir(base, 0)[:-5]}.*/map_DataName.csv").distinct().select(F.lit("DataName").alias("map_name"), "code", "text")


@query("SELECT 'exp/Step1/Loop01#000' || no AS epoch, CAST(s_suppkey AS BIGINT) AS board, round(s_acctbal / 100 + no, 6) AS temp FROM supplier, (SELECT unnest([1, 2]) AS no)", base=False)
def source_temperatures(spark, sf_dir):
    """A table without a header, and one with a header and its columns in another order."""
    base, rows = shared_dir(spark), read(spark, sf_dir, "supplier").select(F.lit(0).alias("InBatchEpoch"), F.col("s_suppkey").alias("Board"), (F.col("s_acctbal") / 100).alias("Temp"))
    rows.select("Board", F.col("Temp") + 1).coalesce(1).write.csv(f"{_epoch_dir(base, 1)}/initial_temperature.csv")
    rows.select("InBatchEpoch", (F.col("Temp") + 2).alias("Temp"), "Board").coalesce(1).write.option("header", True).csv(f"{_epoch_dir(base, 2)}/initial_temperature.csv")
    got = tables.read_temperatures(spark, f"{_epoch_dir(base, 0)[:-5]}.*/initial_temperature.csv")
    return got.select(F.col("Epoch").alias("epoch"), F.col("Board").alias("board"), six("temp").alias("temp"))


@query("SELECT 'G' AS generation, n_nationkey * 4.0::DOUBLE AS temp_key, CAST(n_nationkey AS INTEGER) AS ord, state, round(-1.0::DOUBLE - n_nationkey, 6) AS b FROM nation, (SELECT unnest(['O', 'F']) AS state)", base=False)
def source_calibration(spark, sf_dir):
    coef = lambda n: F.struct(F.lit(0.0).alias("a"), (-1.0 - n).alias("b"))
    by_key = F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda n: F.struct((n * 4).cast("string").alias("k"), F.create_map(F.lit("O"), coef(n), F.lit("F"), coef(n)).alias("v")))
    nested = read(spark, sf_dir, "nation").agg(F.to_json(F.create_map(F.lit("G"), F.map_from_entries(by_key))).alias("value"))
    path = shared_dir(spark)
    nested.write.text(path)
    return tables.read_calibration(spark, path).select("generation", "temp_key", "ord", "state", six("b").alias("b"))


@query("SELECT 'exp/Step1/Loop01#' || epoch AS epoch, 'exp/Step1/Loop01' AS history, CAST(epoch AS BIGINT) AS epoch_no, round(avg(v), 6) AS score FROM b WHERE state = 'F' GROUP BY epoch")
def history_scores(spark, sf_dir):
    """A history of epoch directories, each with its own code map, opened and scored in one go."""
    rows, base = catalog(spark, sf_dir).measurements["QTY"], shared_dir(spark)
    for no in _years(rows):
        first = "O" if no % 2 else "F"
        code = F.when(F.col("State") == first, 0).otherwise(1)
        own = rows.where(F.col("Epoch") == no).select(F.lit(0).alias("InBatchEpoch"), "Board", "Line", code.alias("State"), F.col("value").alias("QTY"))
        own.write.option("header", True).csv(f"{_epoch_dir(base, no)}/QTY.csv")
        codes = rows.select("State").distinct().select(F.when(F.col("State") == first, 0).otherwise(1), "State")
        codes.write.csv(f"{_epoch_dir(base, no)}/map_State.csv")
    cat = open_catalog(spark, [_epoch_dir(base, 0)[: -len("/result.0000")]], types=["QTY"])
    got = compute_scores(cat, ScoreFile((ScorePart("level", "QTY", ("State", "Line"), {"State": Step("filter", "F"), "Line": MEAN}),), "level")).scores
    return got.select(F.col("Epoch").alias("epoch"), F.col("History").alias("history"), F.col("EpochNo").alias("epoch_no"), six("Score").alias("score"))


def _levels(spark, sf_dir):
    file = ScoreFile((ScorePart("level", "QTY", ("Line", "Flag"), {"Line": MEAN, "Flag": MEAN}),), "level * 2")
    return compute_scores(catalog(spark, sf_dir), file)


_LEVEL_SQL = "SELECT epoch, round(2 * avg(x), 6) AS score, round(avg(x), 6) AS level FROM (SELECT epoch, flag, avg(v) AS x FROM b GROUP BY ALL) GROUP BY epoch"


@query(_LEVEL_SQL)
def sink_scores_csv(spark, sf_dir):
    path = shared_dir(spark)
    tables.write_scores(_levels(spark, sf_dir).scores, path)
    got = spark.read.option("header", True).csv(path)
    return got.select(F.col("Epoch").cast("int").alias("epoch"), six(F.col("Score").cast("double")).alias("score"), six(F.col("level").cast("double")).alias("level"))


@query(_LEVEL_SQL)
def sink_scores_json(spark, sf_dir):
    path = shared_dir(spark)
    tables.json_results(_levels(spark, sf_dir).scores).write.text(path)
    got = spark.read.text(path).select(F.from_json("value", "Epoch int, Score double, level double").alias("r"))
    return got.select(F.col("r.Epoch").alias("epoch"), six("r.Score").alias("score"), six("r.level").alias("level"))


@query("SELECT epoch, round(avg(CASE WHEN epoch = 1996 THEN v + 1 ELSE v END), 6) AS level FROM b GROUP BY epoch")
def sink_by_epoch(spark, sf_dir):
    """All epochs written, then one of them again with other values: it is replaced, the others stay."""
    cat, path = catalog(spark, sf_dir), shared_dir(spark)
    rows = cat.measurements["QTY"]
    file = ScoreFile((ScorePart("level", "QTY", ("Line",), {"Line": MEAN}),))
    tables.replace_epochs(compute_scores(Catalog({"QTY": rows}), file).scores, path)
    tables.replace_epochs(compute_scores(Catalog({"QTY": rows.where("Epoch = 1996").withColumn("value", F.col("value") + 1)}), file).scores, path)
    return spark.read.parquet(path).select(F.col("Epoch").cast("int").alias("epoch"), six("level").alias("level"))


@query("SELECT DISTINCT epoch, 'p: no rows' AS reason FROM b")
def sink_failed(spark, sf_dir):
    p, path = ScorePart("p", "QTY", ("Flag", "Line"), {"Flag": Step("filter", "X"), "Line": MEAN}), shared_dir(spark)
    tables.write_failed(compute_scores(catalog(spark, sf_dir), ScoreFile((p,))).failed, path)
    return spark.read.option("header", True).csv(path).select(F.col("Epoch").cast("int").alias("epoch"), "reason")


@query("SELECT board, line, count(*) AS n, round(sum(v), 6) AS total FROM b GROUP BY board, line")
def sink_bundle(spark, sf_dir):
    path = shared_dir(spark)
    tables.write_bundle({"QTY": catalog(spark, sf_dir).measurements["QTY"].select("Epoch", "Board", "Line", "value")}, path)
    got = spark.read.option("header", True).schema("Board long, Line long, QTY double").csv(f"{path}/QTY.csv")
    return got.groupBy(F.col("Board").alias("board"), F.col("Line").alias("line")).agg(F.count("*").alias("n"), six(F.sum("QTY")).alias("total"))


@query("SELECT round(sum(v), 6) AS value FROM b")
def scalar_total(spark, sf_dir):
    df = fo.aggregate_axis(catalog(spark, sf_dir).measurements["QTY"].select("Line", "value"), "Line", "sum")
    return spark.range(1).select(F.round(F.lit(fo.collapse_to_scalar(df)), 6).alias("value"))


@query("SELECT epoch, round(avg(v), 6) AS value FROM b WHERE line IN (1, 2) GROUP BY epoch")
def filter_of_other_kind(spark, sf_dir):
    """Text on an axis of numbers: what reads as a number counts, a word matches nothing."""
    return run(spark, sf_dir, part(("Line", Step("filter", ["1", 2, "two"])), ("Flag&State", MEAN))).where("value IS NOT NULL")


ENTRY = score_part_ratio
