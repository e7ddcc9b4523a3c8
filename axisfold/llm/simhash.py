"""SimHash near-duplicates found exactly with vantage-point trees.

Documents get 64-bit fingerprints; equal fingerprints fall together first.  A
vantage-point tree grown from a bounded sample cuts the space of fingerprints
into shards: at each node the fingerprints within the median Hamming distance of
the vantage point go one way, the rest the other.  Each fingerprint has one home
shard, and visits every later shard whose region its search ball reaches, by the
triangle inequality.  A shard then grows a vantage-point tree over its own
fingerprints and passes homes and visitors down it together, leaving a branch
where the bounds rule it out.

Shards report spanning links, never all pairs of a group: a home joins the first
linked neighbour of its group.  Components of the links are found by star
contractions over the cluster.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and
is linked like any other; rows with equal text share a component; rows that share a
doc_id but not the text are documents of their own; a null doc_id keeps its row, comes
after all others, and leaves a component of such rows without a name; extra columns
are ignored or, where rows are kept, pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, document_key, one_row_each, table
from .components import components

SEED = 42
SHARD_SIZE = 16_384
#: The tree of shards grows from so many fingerprints a shard, ...
SAMPLE_A_SHARD = 32
#: ... and from at most about so many; this changes the size of shards, not the links.
MAX_SAMPLE = 1 << 20
LEAF = 128
_BITS = 4_000_000  # bytes of unpacked bits at a time


def fingerprint(text: str | None, k: int = 3) -> int:
    """The contract in plain words: A-Z lower-cased, k-word shingles, majority bits."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), SEED) for i in range(max(1, len(w) - k + 1))], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    step = _BITS // 64
    for at in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _text_hashes(text: str | None, k: int) -> np.ndarray:
    """Hashes of the shingles, cut out of the text with single spaces between words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    m = max(1, len(w) - k + 1)
    last = ends[min(k, len(w)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:m].tolist(), last.tolist(), strict=True)), dtype=np.uint64, count=m)


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc, body, fp): what tells documents apart, and the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.zeros(b.num_rows, dtype=np.uint64)
            for i, text in enumerate(b.column(2)):
                h = _text_hashes(text.as_py(), k)
                fps[i] = majority(h) if len(h) else 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc", "body", "fp"])

    return docs.select(*document_key(F.col("text")), F.col("text").cast("string")).mapInArrow(run, "doc long, body long, fp long")


def distance(a: np.ndarray, b: np.uint64 | np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _vantage(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage point and radius that split the points evenly with least overlap; None where nothing splits."""
    best = None
    for v in points[:: max(1, len(points) // 12)][:12]:
        d = distance(points, v)
        mu = int(np.median(d))
        if mu == d.max():
            mu -= 1
        inside = float((d <= mu).mean())
        if mu < 0 or not 0.05 <= inside <= 0.95:
            continue
        near = float((np.abs(d.astype(np.int64) - mu) <= 3).mean())
        if best is None or near < best[0]:
            best = (near, np.uint64(v), mu)
    return best and best[1:]


def grow_tree(points: np.ndarray, shards: int):
    """Nested (vantage, radius, inside, outside); a leaf is its shard's number."""
    count = [0]

    def grow(p: np.ndarray, want: int):
        found = _vantage(p) if want > 1 and len(p) >= 16 else None
        if found is None:
            count[0] += 1
            return count[0] - 1
        v, mu = found
        near = distance(p, v) <= mu
        return (int(v), mu, grow(p[near], (want + 1) // 2), grow(p[~near], want // 2))

    return grow(points, max(1, shards)), count[0]


def route(tree, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, positions of its home points, of those of earlier shards whose balls reach it)."""

    def down(node, home: np.ndarray, guest: np.ndarray):
        if not len(home) and not len(guest):
            return
        if isinstance(node, int):
            yield node, home, guest
            return
        v, mu, inside, outside = node
        h, g = distance(points[home], np.uint64(v)), distance(points[guest], np.uint64(v))
        yield from down(inside, home[h <= mu], guest[g <= mu + radius])
        # shards inside come first, so homes inside visit those outside
        yield from down(outside, home[h > mu], np.concatenate((home[(h <= mu) & (h > mu - radius)], guest[g > mu - radius])))

    everything = np.arange(len(points))
    yield from down(tree, everything, everything[:0])


class Union:
    """Disjoint sets over 0..n-1 with whole-array joins."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(p, q := p[p]):
            p = q
        self.parent = p
        return p

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p = self.roots()
            ra, rb = p[a], p[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def link_shard(points: np.ndarray, home: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links, as positions, among points of which one end is among the first ``home``."""
    sets = Union(len(points))

    def brute(a: np.ndarray, q: np.ndarray) -> None:
        step = max(1, 2_000_000 // max(1, len(q)))
        for at in range(0, len(a), step):
            i, j = np.nonzero(distance(points[a[at : at + step], None], points[None, q]) <= radius)
            sets.join(a[at + i], q[j])

    todo = [(np.arange(home), np.arange(len(points)))]
    while todo:
        a, q = todo.pop()
        if not len(a) or not len(q):
            continue
        found = _vantage(points[a]) if len(a) > LEAF else None
        if found is None:
            brute(a, q)
            continue
        v, mu = found
        da, dq = distance(points[a], v), distance(points[q], v)
        todo.append((a[da <= mu], q[dq <= mu + radius]))
        todo.append((a[da > mu], q[dq > mu - radius]))
    roots = sets.roots()
    moved = np.nonzero(roots != np.arange(len(points)))[0]
    return moved, roots[moved]


def links(classes: DataFrame, radius: int = 3, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Spanning links (a, b) between fingerprints within ``radius`` bits.

    ``classes``: fp, each once.  Points travel in packed arrays, one row for each
    shard and batch.
    """
    n = classes.count()
    shards = -(-n // shard_size)
    every = max(1, n // min(max(SAMPLE_A_SHARD * shards, 8_192), MAX_SAMPLE))
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").orderBy("fp").toPandas()["fp"]
    tree, _ = grow_tree(sample.to_numpy(dtype=np.int64).view(np.uint64), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out = list(route(tree, points, radius))
            packed = [pa.array([points[at[i]].tobytes() for _, *at in out], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in out], pa.int32()), *packed], names=["shard", "home", "guest"])

    def join(shard: pa.Table) -> pa.Table:
        home, guest = (np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in shard.column(c)]) for c in ("home", "guest"))
        points = np.concatenate((home, guest))
        a, b = link_shard(points, len(home), radius)
        return pa.table({"a": points[a].view(np.int64), "b": points[b].view(np.int64)})

    return classes.select("fp").mapInArrow(deal, "shard int, home binary, guest binary").groupBy("shard").applyInArrow(join, "a long, b long")


def linked(docs: DataFrame, k: int = 3, radius: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc, body, fp) of all documents, and (fp, root, least): what is linked has one root and one least doc."""
    fps = checkpointed(fingerprints(docs, k))
    classes = checkpointed(fps.groupBy("fp").agg(F.min("doc").alias("own")))
    roots = components(links(classes, radius))
    rooted = checkpointed(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root")))
    least = checkpointed(rooted.groupBy("root").agg(F.min("own").alias("least")))
    # a table of its own, so that a large class can be split when documents join it
    return fps, checkpointed(rooted.join(least, "root").select("fp", "root", "least"))


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id among all linked documents."""
    fps, named = linked(docs, k, radius)
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return fps.join(named, "fp").select(known("doc").alias("doc_id"), "fp", known("least").alias("component_id"))


def without_copies(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """One row of each linked group: that of least doc_id and, there, of the least hash of the text."""
    fps, named = linked(docs, k, radius)
    keepers = fps.join(named, "fp").groupBy("root").agg(F.min(F.struct("doc", "body")).alias("kept")).select("kept.*")
    return one_row_each(docs, checkpointed(keepers))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
