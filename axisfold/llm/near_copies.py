"""Near copies by SimHash and vantage-point trees, every link verified by Jaccard similarity.

Texts become sets of hashed shingles; equal sets fall together first.  Each set gets a
SimHash fingerprint, and vantage-point trees find fingerprints near each other
(``wide_simhash``).  What they link is a bucket.  In each bucket all sets are first
held against one of them, which joins the large groups; what is still apart is then
compared pairwise, in blocks of bounded size.  A link stands only where the exact
similarity of the two sets reaches the threshold.  Components of the links are the
groups of near copies.

A pair of similarity 0.8 is missed, by calculation, once in a million times at most.

Defined cases: texts without words are copies of each other; a text shorter than a
shingle is one shingle; rows that share a doc_id but not the text are documents of
their own; rows without doc_id come after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, document_key, one_row_each
from .components import components
from .simhash import Union, _text_hashes
from .wide_simhash import fingerprint, links

K = 5
#: The least similarity of near copies, as a fraction.
SIMILARITY = (4, 5)
#: So many sets of a bucket, about, are compared at a time with as many others.
BLOCK = 512


def shingle_set(text: str | None, k: int = K) -> np.ndarray:
    return np.unique(_text_hashes(text, k))


def set_key(s: np.ndarray) -> int:
    """64 bits, as a signed long, that stand for the set."""
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def similar(shared, a, b):
    """Whether sets of sizes a and b with so many shared shingles reach the similarity."""
    num, den = SIMILARITY
    return den * shared >= num * (a + b - shared)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc, body, node, size, bits) of each row; node stands for its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "body", "node", "size", "bits"])

    return docs.select(*document_key(F.col("text")), F.col("text").cast("string")).mapInArrow(run, "doc long, body long, node long, size long, bits binary")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, body): the sorted shingles of each set in packed form, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "body"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "node long, body binary").groupBy("node").agg(F.first("body").alias("body"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                good.append(bool(similar(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, other = sets.select(F.col("node").alias("a"), F.col("body").alias("x")), sets.select(F.col("node").alias("b"), F.col("body").alias("y"))
    # a table of its own, so that a set with many partners can be split when it meets them
    half = checkpointed(pairs.join(one, "a"))
    return half.join(other, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def link_block(bodies: list[bytes], roots: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, between similar sets that are in different groups.  The pivots are held against all."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in bodies]
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    known, terms = np.unique(np.concatenate(sets), return_inverse=True)
    _, first, group = np.unique(roots, return_index=True, return_inverse=True)
    union = Union(len(sets))
    union.join(np.arange(len(sets)), first[group])
    a, b = [], []
    for i in np.nonzero(pivots)[0].tolist():
        now = union.roots()
        apart = now != now[i]
        if not apart.any():
            if (now == now[0]).all():
                break
            continue
        own = np.zeros(len(known), dtype=np.int64)
        own[terms[starts[i] : starts[i] + sizes[i]]] = 1
        found = np.nonzero(apart & similar(np.add.reduceat(own[terms], starts), sizes[i], sizes))[0]
        a += [i] * len(found)
        b += found.tolist()
        union.join(np.full(len(found), i), found)
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _apart(members: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links, by their roots, between similar sets of one bucket that are not in one group yet."""
    named = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    named = checkpointed(named)
    mixed = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    mixed = checkpointed(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = named.join(mixed, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("bucket", "node", "root", "own", other)
    rows = rows.select("bucket", "node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("pivot"))

    def link(t: pa.Table) -> pa.Table:
        roots = t.column("root").to_numpy()
        a, b = link_block(t.column("body").to_pylist(), roots, t.column("pivot").to_numpy())
        return pa.table({"a": roots[a], "b": roots[b]})

    return rows.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long")


def keepers(docs: DataFrame) -> DataFrame:
    """(doc, body) of the first document of each group of near copies."""
    nodes = checkpointed(_signed(docs).groupBy("node").agg(F.min(F.struct("doc", "body")).alias("first"), F.first("size").alias("size"), F.first("bits").alias("bits")))
    members = checkpointed(components(links(nodes.where("size > 0"))).select("node", F.col("root").alias("bucket")))
    wanted = nodes.join(members, "node", "left_semi").select("first.doc", "first.body")
    sets = checkpointed(_sets(docs.select("*").join(wanted, [k == wanted[n] for k, n in zip(document_key(F.col("text")), ("doc", "body"), strict=True)], "left_semi")))
    pairs = members.where("node <> bucket").select(F.col("node").alias("a"), F.col("bucket").alias("b"))
    # a set is in one bucket only, so those that are similar to its leader have that for a root
    stars = checkpointed(_verified(pairs, sets).select(F.col("a").alias("node"), F.col("b").alias("root")))
    rest = checkpointed(_apart(members, stars, sets))
    groups = nodes.join(stars, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    if not rest.isEmpty():
        tops = components(rest).select(F.col("node").alias("root"), F.col("root").alias("top"))
        groups = groups.join(tops, "root", "left").groupBy(F.coalesce("top", "root").alias("root")).agg(F.min("first").alias("first"))
    return checkpointed(groups.select("first.doc", "first.body"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of least doc_id and, there, of the least hash of the text."""
    return one_row_each(docs, keepers(docs))
