"""SimHash of many bits with vantage-point trees, for pairs far apart by their bits.

A fingerprint holds the majority bits of a set of shingle hashes, drawn eight times
over.  Sets of Jaccard similarity 0.8 differ in at most 0.188 of the bits on average (sets
of 4 and 5 shingles; 0.162 where both are larger).  With ``RADIUS`` over all 512 bits and
``HEAD_RADIUS`` over the first 128 such a pair is missed, by calculation, once in a
million times, where both sets are larger not twice in a thousand million.

Two distances bound a search, both metrics: the differing bits, and the logarithm of
the ratio of sizes, which no pair of that similarity exceeds by more than 5 / 4.  A
vantage point splits by the distance that leaves the fewest points near the border.
Bits part groups of near copies from the rest, but unrelated texts differ in about half
of the bits and none is nearer to a vantage point than others: among them only sizes
rule out, and the work grows with the square of the number of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash import Union

WORDS = 8
RADIUS = 140
#: The first words are compared first, within a radius of their own.
HEAD, HEAD_RADIUS = 2, 48
#: The largest ratio of sizes of linked sets, as a fraction.
RATIO = (5, 4)
SHARD_SIZE = 16_384
#: The tree of shards grows from so many sets a shard, ...
SAMPLE_A_SHARD = 32
#: ... and from at most about so many; this changes the size of shards, not the links.
MAX_SAMPLE = 1 << 17
LEAF = 512
#: Where more than this part of the points is near the border, a vantage point rules out too little.
NEAR = 0.9
_PAIRS = 1 << 17  # pairs compared at a time
_DRAW = np.random.default_rng(6).integers(0, 1 << 64, WORDS, dtype=np.uint64)

POINT = np.dtype([("node", np.int64), ("size", np.int64), ("bits", np.uint64, WORDS)])
#: How far apart linked sets are at most, by each distance.
REACH = {"bits": RADIUS, "size": math.log(RATIO[0] / RATIO[1]) + 1e-9}


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the hashes, for each of the draws; none of an empty set."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        z = hashes[at : at + 255, None] ^ _DRAW
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def distances(points: np.ndarray, kind: str, at) -> np.ndarray:
    """How far each point is from a vantage point of a kind: its bits, or the logarithm of its size."""
    if kind == "size":
        return np.abs(np.log(points["size"]) - at)
    return np.bitwise_count(points["bits"] ^ np.array(at, dtype=np.uint64)).sum(axis=1, dtype=np.int64)


def _vantage(points: np.ndarray):
    """(part near the border, kind, vantage, radius) that splits evenly with the fewest near; None where nothing splits."""
    best = None
    tried = [("size", float(np.log(points["size"].min())))]
    tried += [("bits", p.tolist()) for p in points["bits"][:: max(1, len(points) // 12)][:12]]
    for kind, at in tried:
        d = distances(points, kind, at)
        mu = np.partition(d, len(d) // 2)[len(d) // 2]
        if mu == d.max():
            mu = d[d < mu].max(initial=-1)
        if mu < 0 or not 0.05 <= (d <= mu).mean() <= 0.95:
            continue
        near = float((np.abs(d - mu) <= REACH[kind]).mean())
        if best is None or near < best[0]:
            best = (near, kind, at, mu.item())
    return best


def grow_tree(points: np.ndarray, shards: int):
    """Nested (kind, vantage, radius, inside, outside); a leaf is its shard's number."""
    count = [0]

    def grow(p: np.ndarray, want: int):
        found = _vantage(p) if want > 1 and len(p) >= 16 else None
        if found is None:
            count[0] += 1
            return count[0] - 1
        _, kind, at, mu = found
        near = distances(p, kind, at) <= mu
        return (kind, at, mu, grow(p[near], (want + 1) // 2), grow(p[~near], want // 2))

    return grow(points, max(1, shards))


def route(tree, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions of its home points, of those of earlier shards that may have links there)."""

    def down(node, home: np.ndarray, guest: np.ndarray):
        if not len(home) and not len(guest):
            return
        if isinstance(node, int):
            yield node, home, guest
            return
        kind, at, mu, inside, outside = node
        reach = REACH[kind]
        h, g = distances(points[home], kind, at), distances(points[guest], kind, at)
        yield from down(inside, home[h <= mu], guest[g <= mu + reach])
        # shards inside come first, so homes inside visit those outside
        yield from down(outside, home[h > mu], np.concatenate((home[(h <= mu) & (h > mu - reach)], guest[g > mu - reach])))

    everything = np.arange(len(points))
    yield from down(tree, everything, everything[:0])


def link_shard(points: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as positions, among points of which one end is among the first ``home``."""
    sets = Union(len(points))
    sizes, bits = points["size"], points["bits"]
    heads = [np.ascontiguousarray(bits[:, w]) for w in range(HEAD)]
    num, den = RATIO

    def brute(a: np.ndarray, q: np.ndarray) -> None:
        a, q = a[np.argsort(sizes[a])], q[np.argsort(sizes[q])]
        low = np.searchsorted(sizes[q], -(-den * sizes[a] // num))
        high = np.searchsorted(sizes[q], num * sizes[a] // den, side="right")
        queried = [h[q] for h in heads]
        at = 0
        while at < len(a):
            end = min(len(a), at + max(1, _PAIRS // max(1, high[at] - low[at])))
            cut = slice(low[at], high[end - 1])
            apart = sum(np.bitwise_count(h[a[at:end], None] ^ x[None, cut]) for h, x in zip(heads, queried, strict=True))
            # positions in a row: numpy finds pairs of them three times as slowly
            i, j = np.divmod(np.flatnonzero(apart <= HEAD_RADIUS), apart.shape[1])
            i, j = a[at + i], q[cut][j]
            fit = (i != j) & (num * np.minimum(sizes[i], sizes[j]) >= den * np.maximum(sizes[i], sizes[j]))
            i, j = i[fit], j[fit]
            fit = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= RADIUS
            sets.join(i[fit], j[fit])
            at = end

    todo = [(np.arange(home), np.arange(len(points)))]
    while todo:
        a, q = todo.pop()
        if not len(a) or not len(q):
            continue
        found = _vantage(points[a]) if len(a) > LEAF else None
        if found is None or found[0] > NEAR:
            brute(a, q)
            continue
        _, kind, at, mu = found
        da, dq = distances(points[a], kind, at), distances(points[q], kind, at)
        todo.append((a[da <= mu], q[dq <= mu + REACH[kind]]))
        todo.append((a[da > mu], q[dq > mu - REACH[kind]]))
    roots = sets.roots()
    moved = np.nonzero(roots != np.arange(len(points)))[0]
    return moved, roots[moved]


def _points(node, size, bits) -> np.ndarray:
    points = np.zeros(len(node), dtype=POINT)
    points["node"], points["size"] = node.to_numpy(), size.to_numpy()
    points["bits"] = np.frombuffer(b"".join(bits.to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
    return points


def links(nodes: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Spanning links (a, b) between sets that may be similar.

    ``nodes``: node, size, bits of sets that are not empty, each once.  Points travel in
    packed arrays, one row for each shard and batch.
    """
    n = nodes.count()
    shards = -(-n // shard_size)
    every = max(1, n // min(max(SAMPLE_A_SHARD * shards, 8_192), MAX_SAMPLE))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("node", "size", "bits").toArrow()
    tree = grow_tree(np.sort(_points(*sample.columns), order="node"), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _points(*b.columns)
            out = list(route(tree, points))
            packed = [pa.array([points[at[i]].tobytes() for _, *at in out], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in out], pa.int32()), *packed], names=["shard", "home", "guest"])

    def join(shard: pa.Table) -> pa.Table:
        home, guest = (np.concatenate([np.frombuffer(x.as_py(), dtype=POINT) for x in shard.column(c)]) for c in ("home", "guest"))
        points = np.concatenate((home, guest))
        a, b = link_shard(points, len(home))
        return pa.table({"a": points["node"][a], "b": points["node"][b]})

    return nodes.select("node", "size", "bits").mapInArrow(deal, "shard int, home binary, guest binary").groupBy("shard").applyInArrow(join, "a long, b long")
