"""Hard negatives against a search over all pairs."""

import math
import random

import numpy as np
import pytest

from axisfold.llm import negatives

SCHEMA = "id long, label int, vector array<double>"


def plain(rows, is_anchor, positives=5, most=10, low=30, high=90):
    rows = [(i, lab, np.array(v)) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rank = lambda pairs: sorted(pairs, key=lambda p: (-p[0], math.inf if p[1] is None else p[1]))
    out = []
    for a, label, v in {(i, lab, tuple(v)): (i, lab, v) for i, lab, v in rows if i is not None and is_anchor(i)}.values():
        near = rank([(float(v @ x), i) for i, lab, x in rows if lab == label and i != a])[:positives]
        far = rank([(float(v @ x), i) for i, lab, x in rows if lab != label])
        for s, p in near:
            out += [(a, p, k + 1, i, s, t) for k, (t, i) in enumerate([x for x in far if low * s <= 100 * x[0] <= high * s][:most])]
    return sorted(out, key=str)


def mined(df, **more):
    return sorted([tuple(r) for r in negatives.hard_negatives(df, negatives.F.pmod("id", negatives.F.lit(10)) == 0, **more).collect()], key=str)


def made(seed, n, clustered):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, 8)) * 60
    rows = []
    for i in range(n):
        v = middle[draw.integers(6)] + draw.normal(size=8) * 8 if clustered else draw.normal(size=8) * 40
        rows.append((i, int(draw.integers(4)), np.floor(v).tolist()))
    return rows


@pytest.mark.parametrize("clustered", [False, True])
def test_equal_to_all_pairs(spark, clustered):
    rows = made(3, 700, clustered)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == plain(rows, lambda i: i % 10 == 0)


def test_ties_repeats_nulls_and_hot_vectors(spark):
    draw = random.Random(5)
    rows = [(i, draw.randrange(3), [float(draw.randrange(-2, 3)) for _ in range(3)]) for i in range(200)]
    rows += [(1000 + i, 1, [1.0, 1.0, 0.0]) for i in range(120)] + [(2000 + i, 2, [1.0, 0.0, 0.0]) for i in range(120)]
    rows += [(7, 1, [2.0, 2.0, 2.0])] * 30 + [(20, 0, [1.0, 2.0, 0.0])] * 2
    rows += [(None, 1, [2.0, 1.0, 0.0]), (30, None, [1.0, 1.0, 1.0]), (40, 1, None), (50, 1, [1.0, None, 0.0]), (60, 1, [1.0, math.nan, 0.0]), (70, 1, [math.inf, 0.0, 0.0]), (80, 2, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS shard", "1 AS key", "2 AS need")
    assert mined(df) == plain(rows, lambda i: i % 10 == 0)


def test_short_vectors_few_rows_and_empty_tables(spark):
    rows = [(10, 1, [1.0]), (1, 1, [2.0, 5.0]), (2, 2, [1.0]), (3, 2, [])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == [(10, 1, 1, 2, 2.0, 1.0)]
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, 1, [1.0])], SCHEMA)) == []


def test_walks_end_early_where_bounds_tell_them_to():
    rows = made(9, 4000, True)
    vectors = np.array([v for _, _, v in rows])
    shard = negatives.Shard(np.arange(4000), np.array([lab for _, lab, _ in rows]), vectors)
    own = vectors[:3] / np.linalg.norm(vectors[:3], axis=1)[:, None]
    shard.listed(0, own[0], 0.0)
    far = np.argsort(-(vectors @ own[0]))
    assert shard.bound[0] >= vectors[far[0]] @ own[0] and (np.diff(shard.bound) <= 0).all()
    seen = []
    shard.vectors = type("Counted", (), {"__getitem__": lambda _, part: seen.append(len(part)) or vectors[part]})()
    one = lambda x: np.full((1, 1), x)
    shard.walk(np.array([0]), shard.labels[:1], vectors[:1], one(-math.inf), one(math.inf), one(-math.inf), True, 5)
    assert sum(seen) < 4000
