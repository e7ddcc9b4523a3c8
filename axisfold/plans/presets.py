"""Ready-made parts."""

from __future__ import annotations

from .spec import ScorePart, Step

#: The select-gate elements that the absolute-shift part leaves out.
SELECT_GATES = ("SGSB", "SGS", "SGD", "SGDT")


def log_sum(name: str, type_: str, mean_over: tuple[str, ...] = ("Board", "Chip"), axis: str = "SGWLD", floor: float = 1e-6, weight: float = 0.1) -> ScorePart:
    """Means, floored logarithm, weighted sum."""
    steps = {a: Step("mean") for a in mean_over} | {"__log__": Step("log", floor=floor), axis: Step("sum", weight=weight)}
    return ScorePart(name, type_, (*mean_over, "__log__", axis), steps)


def abs_sum(name: str, type_: str, elements: list, mean_over: tuple[str, ...] = ("Board", "Chip", "Block"), axis: str = "SGWLD") -> ScorePart:
    """Means, absolute value, sum over the chosen elements."""
    steps = {a: Step("mean") for a in mean_over} | {"__abs__": Step("abs"), axis: Step("sum", value=list(elements))}
    return ScorePart(name, type_, (*mean_over, "__abs__", axis), steps)
