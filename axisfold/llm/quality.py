"""Quality rules: a learned decision list of threshold conjunctions.

Text statistics are computed with Spark expressions only.  Rules that find bad
documents are learned by sequential covering from labelled statistics: a rule
grows by the threshold that gains most information on the growing rows, is pruned
on held-back rows, and its covered rows leave before the next rule is sought.
Thresholds move to the middle of the gap between the rows on either side.
What comes out is an ordered list of conjunctions, applied as one Spark
conditional expression.

Each step of the search is one grouped count over binned statistics, so the
driver sees counts by bin only, never rows.

Defined cases: a null text counts as empty; a text without words fails the base
rule and all its ratios are 0; labels that repeat for a document count as bad if
any says so; without labels of both kinds the list is empty and the base rule
alone decides; repeated rows are judged alike; extra columns pass through, those
named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, settled, table, words

#: At most so many labelled documents are learned from, those of lowest hash.
MAX_LABELLED = 10_000
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "mark_ratio", "words_a_line"]
#: Learned from: the ratios that depend neither on the language nor on the length.
FEATURES = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio"]


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur at least twice, the first included.

    Window hashes are sorted with their positions; equal neighbours give the
    repeated windows, whose positions in order give the words they cover.
    """
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)).alias("h"), i.alias("i")))
    ordered = F.sort_array(windows)

    def repeated(s: Column) -> Column:
        near = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(near, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    bind = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  evaluates value once
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(bind(ordered, lambda s: bind(repeated(s), covered)))


def statistics(docs: DataFrame, ratios: Sequence[str] = RATIOS, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the counts and the given ratios of the text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*COUNTS, *RATIOS}]
    # the row travels as one column, so its names can't clash with the helpers'
    x = docs.select(F.struct(*kept).alias("row"), body.alias("body"))
    x = settled(x, ["row", "body"], w=words(F.col("body")))
    x = settled(x, ["row", "body", "w"], joined=F.array_join("w", ""), filled=F.filter(F.split("body", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))
    w, b, joined, filled, n = F.col("w"), F.col("body"), F.col("joined"), F.col("filled"), F.col("n_words")
    # what only some ratios need is left out with them
    needed = {
        "distinct_ratio": ("distinct", F.size(F.array_distinct(w))),
        "upper_ratio": ("upper", F.length(F.regexp_replace(joined, "[^\\p{Lu}]+", ""))),
        "mark_ratio": ("marks", F.length(F.regexp_replace(joined, "[^!?]+", ""))),
    }
    x = settled(
        x,
        ["row"],
        n_words=F.size(w).cast("long"),
        word_chars=F.length(joined).cast("long"),
        n_symbols=F.length(F.regexp_replace(b, f"[^{SYMBOLS}]+", "")).cast("long"),
        lines=F.size(filled).cast("long"),
        n_dup_lines=(F.size(filled) - F.size(F.array_distinct(filled))).cast("long"),
        n_repeat_words=repeat_words(w),
        **dict(needed[r] for r in ratios if r in needed),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    made = {
        "mean_word_chars": (F.col("word_chars"), n),
        "symbol_ratio": (F.col("n_symbols"), n),
        "dup_line_ratio": (F.col("n_dup_lines"), F.col("lines")),
        "repeat_ratio": (F.col("n_repeat_words"), n),
        "distinct_ratio": (F.col("distinct"), n),
        "upper_ratio": (F.col("upper"), F.col("word_chars")),
        "mark_ratio": (F.col("marks"), n),
        "words_a_line": (n, F.col("lines")),
    }
    return x.select("row.*", *COUNTS, *[share(*made[r]).alias(r) for r in RATIOS if r in ratios])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        x = F.col(self.feature)
        return x > self.threshold if self.above else x <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.holds()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def entropy_gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained on the p covered positives when (p0, n0) narrows to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def bin_of(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x))


def learn_rules(labelled: DataFrame, features: list[str] = FEATURES, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.95, least: int = 3, seed: int = 1) -> list[Rule]:
    """Rules for ``bad`` rows. ``labelled``: doc_id, bad (boolean) and the features.

    ``precision``: what a pruned rule must reach on the held-back third of rows
    and on the growing rows; a rule below it ends the list.
    """
    cuts_of = labelled.agg(*[F.expr(f"percentile_approx({f}, array({', '.join(str((k + 1) / (bins + 1)) for k in range(bins))}), 10000)").alias(f) for f in features]).first()
    cuts = {f: sorted(set(cuts_of[f] or [])) for f in features}
    if not any(cuts.values()):
        return []
    binned = labelled.select(
        (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(3)) == 0).alias("held"),
        F.col("bad").cast("int").alias("bad"),
        F.array(*[F.col(f).cast("double") for f in features]).alias("x"),
        F.array(*[bin_of(F.col(f), cuts[f]) for f in features]).alias("b"),
    )
    binned = checkpointed(binned)
    inside = lambda cs: [F.col("b")[i] > k if above else F.col("b")[i] <= k for i, above, k in cs]

    def narrowed(frame: DataFrame, cs) -> DataFrame:
        for c in inside(cs):
            frame = frame.where(c)
        return frame

    def counts(frame: DataFrame) -> tuple[int, int]:
        r = frame.agg(F.sum("bad").alias("p"), F.count("*").alias("t")).first()
        return (r["p"] or 0), r["t"] - (r["p"] or 0)

    def margins(frame: DataFrame, cs) -> list[float]:
        """For each condition the middle of the gap around its cut, among the rows that meet the others."""
        asked = []
        for at, (i, _, k) in enumerate(cs):
            others, x, over = _all(inside(cs[:at] + cs[at + 1 :])), F.col("x")[i], F.col("b")[i] > k
            asked += [F.max(F.when(others & ~over, x)).alias(f"lo{at}"), F.min(F.when(others & over, x)).alias(f"hi{at}")]
        r = frame.agg(*asked).first()
        ends = [(r[f"lo{at}"], r[f"hi{at}"], cuts[features[i]][k]) for at, (i, _, k) in enumerate(cs)]
        return [float(cut) if lo is None or hi is None else (float(lo) + float(hi)) / 2 for lo, hi, cut in ends]

    left, rules = binned, []
    while len(rules) < max_rules:
        grow, held = left.where(~F.col("held")), left.where(F.col("held"))
        p0, n0 = counts(grow)
        chosen: list[tuple[int, bool, int]] = []
        while p0 >= least and n0 and len(chosen) < max_conditions:
            rows = narrowed(grow, chosen).select("bad", F.posexplode("b")).groupBy("pos", "col").agg(F.sum("bad").alias("p"), F.count("*").alias("t")).collect()
            best = (0.0, None, 0, 0)
            for i, f in enumerate(features):
                own = {r["col"]: (r["p"], r["t"] - r["p"]) for r in rows if r["pos"] == i}
                p = n = 0
                for k in range(len(cuts[f])):
                    p, n = p + own.get(k, (0, 0))[0], n + own.get(k, (0, 0))[1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        used = any((i, above) == c[:2] for c in chosen)
                        if not used and pp >= least and (g := entropy_gain(pp, nn, p0, n0)) > best[0] + 1e-9:
                            best = (g, (i, above, k), pp, nn)
            if best[1] is None:
                break
            chosen.append(best[1])
            p0, n0 = best[2], best[3]
        if not chosen:
            break
        prefixes = [(m, _all(inside(chosen[:m]))) for m in range(1, len(chosen) + 1)]
        tried = held.agg(*[F.sum(F.when(hold, F.col("bad"))).alias(f"p{m}") for m, hold in prefixes], *[F.count(F.when(hold, 1)).alias(f"t{m}") for m, hold in prefixes]).first()
        worth = lambda m: (2 * (tried[f"p{m}"] or 0) - tried[f"t{m}"]) / max(tried[f"t{m}"], 1)
        keep = max(range(1, len(chosen) + 1), key=lambda m: (worth(m), -m))
        p, n = counts(narrowed(left, chosen[:keep]))
        if p < least or p < precision * (p + n) or (tried[f"p{keep}"] or 0) < precision * tried[f"t{keep}"]:
            break
        rules.append(Rule(tuple(Condition(features[i], above, t) for (i, above, _), t in zip(chosen[:keep], margins(left, chosen[:keep]), strict=True))))
        left = left.where(~_all(inside(chosen[:keep])))
    return rules


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as its position from 0; null where none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.holds(), F.lit(k)).otherwise(out)
    return out


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, bad and the statistics of at most ``max_labelled`` labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # bounded by max_labelled
    return statistics(found, FEATURES)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics with base_failed, rule (the rule that rejects, by position) and kept."""
    used = {c.feature for rule in rules for c in rule.conditions}
    x = statistics(docs.drop("base_failed", "rule", "kept"), [r for r in RATIOS if r in used])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return x.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    return judged(docs, learn_rules(labelled_statistics(docs, labels, max_labelled)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
