"""Score expressions: Python expression text turned into a Spark column.

Names are part values; in an ``expr`` fold ``values`` are the group's values, of which
the minimum, maximum, mean and sum can be taken, and ``by[key]`` is the value at one
axis value.  These become aggregates that merge, so that no group is ever a list.
``log`` is the decadic logarithm, ``ln`` the natural one.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import guarded_div, ieee_log, log10_ieee, nan_least, null_greatest


class ExpressionError(ValueError):
    """The text is not an expression over the given names."""


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _lists(whole: Callable[[Column], Column], several: Callable[..., Column]):
    """A function of one list or of several numbers."""
    return lambda *xs: whole(xs[0].column) if len(xs) == 1 and isinstance(xs[0], _List) else several(*xs)


class _List:
    def __init__(self, column: Column):
        self.column = column


def _array_min(values: Column) -> Column:
    return F.when(F.exists(values, F.isnan), F.lit(float("nan"))).otherwise(F.array_min(values))


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "log": log10_ieee,
    "ln": lambda x: ieee_log(x, F.ln),
    "log2": lambda x: ieee_log(x, F.log2),
    "exp": F.exp,
    "sqrt": lambda x: F.when(x < 0, F.lit(float("nan"))).otherwise(F.sqrt(x)),
    "abs": F.abs,
    "min": _lists(_array_min, nan_least),
    "max": _lists(F.array_max, null_greatest),
    "mean": _lists(lambda v: guarded_div(_add(v), F.size(v)), lambda *xs: sum(xs[1:], xs[0]) / F.lit(float(len(xs)))),
    "sum": _lists(_add, lambda *xs: sum(xs[1:], xs[0])),
    "int": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double"),
    "float": lambda x: x.cast("double"),
}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: guarded_div,
    ast.FloorDiv: lambda a, b: F.floor(guarded_div(a, b)).cast("double"),
    ast.Mod: lambda a, b: a - b * F.floor(guarded_div(a, b)),
    ast.Pow: F.pow,
}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}


def to_column(text: str, names: Mapping[str, Column], values: Mapping[str, Column] | None = None, by: Callable[[str], Column] | None = None) -> Column:
    """The expression as a column; null where a name is null or a key of ``by`` is missing.

    ``values`` has the column of each function of all values, ``by`` makes that of a key.
    """
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"not an expression: {text!r}") from e

    def of(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            if node.id in names:
                return names[node.id]
            raise ExpressionError(f"unknown name {node.id!r} in {text!r}")
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "by" and by is not None and isinstance(node.slice, ast.Constant):
            key = node.slice.value
            return by(str(key).lower() if isinstance(key, bool) else str(key))
        if isinstance(node, ast.List | ast.Tuple):
            return _List(F.array(*[of(x) for x in node.elts]))
        if isinstance(node, ast.UnaryOp):
            x = of(node.operand)
            return -x if isinstance(node.op, ast.USub) else ~x if isinstance(node.op, ast.Not) else x
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.BoolOp):
            parts = [of(x) for x in node.values]
            out = parts[0]
            for x in parts[1:]:
                out = out & x if isinstance(node.op, ast.And) else out | x
            return out
        if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [of(x) for x in (node.left, *node.comparators)]
            out = None
            for o, a, b in zip(node.ops, sides, sides[1:], strict=False):
                held = _COMPARE[type(o)](a, b)
                out = held if out is None else out & held
            return out
        if isinstance(node, ast.IfExp):
            return F.when(of(node.test), of(node.body)).otherwise(of(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and values is not None and [getattr(x, "id", None) for x in node.args] == ["values"]:
            if node.func.id not in values:
                raise ExpressionError(f"not a function of all values: {node.func.id!r}")
            return values[node.func.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*[of(x) for x in node.args])
        raise ExpressionError(f"not allowed in an expression: {ast.unparse(node)!r}")

    out = of(tree)
    if isinstance(out, _List):
        raise ExpressionError(f"the expression is a list: {text!r}")
    return out.cast("double")


def names_in(text: str) -> set[str]:
    """The names that an expression reads, without its functions."""
    tree = ast.parse(text.strip(), mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called
