"""Hard negatives by lists that the anchors of a cluster share (MAXIMUS-style), exact.

Anchors are clustered by angle.  For each cluster and each shard of candidates one list
is sorted, once, by an upper bound of the score that any member can give: the
candidate's length times the cosine of its angle to the cluster's centre less the
cluster's widest angle.  Every member walks that list, a block at a time, until no
later candidate can reach the last place that the member still has to fill; so what it
ends with is exact, whatever the clusters are.

Positives are searched first, among the anchor's own label; each of them opens a band
of scores, and the negatives are the best of other labels inside it.  A few shards are
walked before the others: the places that they fill are lower bounds with which the
walks of all other shards begin.

Candidates lie in shards of about ``SHARD_ROWS`` rows by hash, one in memory at a time;
anchors stream past them.  Every anchor meets every shard, so anchors are copied once
for each shard: rows times queries is what an exact search of a set of queries against
all rows costs where no bound holds, as with random vectors.  The driver sees the
centres (at most ``CLUSTERS``), learned from ``SAMPLE`` anchors, and counts.

Defined cases: rows with a null label, a null vector or a null or non-finite component
take no part; shorter vectors are as if filled up with zeros; a row without id is no
anchor, and comes last among ties; rows that repeat count as often as they stand, and
anchors that are equal in everything are mined once; an anchor's positives have other
ids than its own; an empty table, or one without anchors, gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, table

SHARD_ROWS = 65_536
MIN_SHARDS = 64
#: This share of the shards, one at least, is walked first.
FIRST = 1 / 32
#: At most so many clusters, learned from so many anchors (those of least hash).
CLUSTERS, SAMPLE = 512, 4_096
#: So many candidates of a list, and so many members of a cluster, are met at a time.
LIST_BLOCK, MEMBERS = 1_024, 512


def centres_of(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to k unit vectors around which the vectors lie, by angle."""
    length = np.linalg.norm(vectors, axis=1)
    unit = np.unique(vectors[length > 0] / length[length > 0, None], axis=0)
    if len(unit) <= k:
        return unit
    centres = unit[np.random.default_rng(13).choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def angles(unit_dot: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_dot, -1.0, 1.0))


class Shard:
    """Candidates, with their list for one cluster at a time."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.length = np.linalg.norm(vectors, axis=1)
        self.cluster: int | None = None

    def listed(self, cluster: int, centre: np.ndarray, widest: float) -> None:
        """Sort the candidates by what they can give to members within ``widest`` of the centre."""
        if self.cluster != cluster:
            away = angles(self.vectors @ centre / np.where(self.length > 0, self.length, 1.0))
            bound = self.length * np.cos(np.maximum(away - widest - 1e-7, 0.0))
            self.order = np.argsort(-bound, kind="stable")
            self.bound, self.cluster = bound[self.order], cluster

    def walk(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, id, score): for each member and band the k best candidates of the same label, or of others, that reach ``need``."""
        members, bands = low.shape
        need = np.where(low <= high, np.maximum(low, need), np.inf)
        slot, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        length = np.linalg.norm(vectors, axis=1)
        for at in range(0, len(self.order), LIST_BLOCK):
            can = self.bound[at] * length
            on = np.nonzero(can + 1e-9 * np.abs(can) + 1e-6 >= need.min(axis=1))[0]
            if not len(on):
                break
            part = self.order[at : at + LIST_BLOCK]
            got = vectors[on] @ self.vectors[part].T
            equal = labels[on, None] == self.labels[None, part]
            fit = equal & (ids[on, None] != self.ids[None, part]) if same else ~equal
            new = [np.nonzero(fit & (got >= need[on, b, None]) & (got <= high[on, b, None])) for b in range(bands)]
            if not any(len(r) for r, _ in new):
                continue
            slot = np.concatenate([slot, *[on[r] * bands + b for b, (r, _) in enumerate(new)]])
            found = np.concatenate([found, *[self.ids[part[c]] for _, c in new]])
            score = np.concatenate([score, *[got[r, c] for r, c in new]])
            best = np.lexsort((found, -score, slot))
            slot, found, score = slot[best], found[best], score[best]
            first = np.searchsorted(slot, slot)
            kept = np.arange(len(slot)) - first < k
            slot, found, score = slot[kept], found[kept], score[kept]
            full, last = np.nonzero(np.bincount(slot, minlength=members * bands) == k)[0], np.searchsorted(slot, np.arange(members * bands), side="right") - 1
            need.reshape(-1)[full] = score[last[full]]
        return slot, found, score


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _search(rows: DataFrame, anchors: DataFrame, centres: np.ndarray, widest: dict[int, float], width: int, shards: tuple[int, int], same: bool, k: int) -> DataFrame:
    """(key, band, id, score): each anchor's best candidates in some of the shards."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((centres, widest))  # bounded by CLUSTERS
    empty = F.array().cast("array<double>")
    nothing = [F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("key")]
    mine = rows.where(F.col("shard").between(shards[0], shards[1] - 1)).select("shard", F.lit(0).alias("kind"), *nothing, "id", "label", "vector", *[empty.alias(c) for c in ("low", "high", "need")])
    copies = F.explode(F.sequence(F.lit(shards[0]), F.lit(shards[1] - 1))).alias("shard")
    theirs = anchors.select(copies, F.lit(1).alias("kind"), "cluster", "key", "id", "label", "vector", "low", "high", "need")
    met = mine.unionByName(theirs).repartition("shard").sortWithinPartitions("shard", "kind", "cluster", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, widest = sent.value
        now, parts, shard = None, [], None
        for b in batches:
            at, kinds, clusters = (b.column(i).to_numpy() for i in range(3))
            # stretches of one shard, kind and cluster
            cut = np.nonzero(np.diff(at) | np.diff(kinds) | np.diff(clusters))[0] + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                if at[lo] != now:
                    now, parts, shard = at[lo], [], None
                if kinds[lo] == 0:
                    t = b.slice(lo, hi - lo)
                    parts.append((t.column(4).to_numpy(), t.column(5).to_numpy(), _matrix(t.column(6), width)))
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard, parts = Shard(*[np.concatenate(x) for x in zip(*parts, strict=True)]), [()]
                cluster = int(clusters[lo])
                shard.listed(cluster, centres[cluster], widest[cluster])
                for one in range(lo, hi, MEMBERS):
                    t = b.slice(one, min(MEMBERS, hi - one))
                    bands = len(t.column(7)[0])
                    low, high, need = (_matrix(t.column(i), bands) for i in (7, 8, 9))
                    slot, found, score = shard.walk(t.column(4).to_numpy(), t.column(5).to_numpy(), _matrix(t.column(6), width), low, high, need, same, k)
                    keys = t.column(3).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[slot // bands], (slot % bands).astype(np.int32), found, score)], names=["key", "band", "id", "score"])

    return met.mapInArrow(run, "key long, band int, id long, score double")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and band, with their place from 1 on."""
    order = Window.partitionBy("key", "band").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _searched(rows: DataFrame, anchors: DataFrame, centres: np.ndarray, widest: dict[int, float], width: int, shards: int, same: bool, k: int) -> DataFrame:
    """(key, band, id, score, place): each anchor's k best candidates of each band, by two rounds of walks."""
    head = max(1, math.ceil(shards * FIRST))
    early = checkpointed(_first(_search(rows, anchors, centres, widest, width, (0, head), same, k), k))
    if head == shards:
        return early
    # a band whose places are all filled needs no less than its last one
    reached = early.where(F.col("place") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("reached"))
    need = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("reached", i), F.lit(-math.inf))))
    seeded = anchors.join(reached, "key", "left").withColumn("need", need).drop("reached")
    late = _search(rows, seeded, centres, widest, width, (head, shards), same, k)
    return _first(early.drop("place").unionByName(late), k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: float = 30, high: float = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (id, label, vector).

    For each anchor and each of its best ``positives`` of the same label: the best ``negatives``
    of other labels whose scores lie between ``low`` and ``high`` hundredths of the positive's.
    """
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(math.inf))
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>")).where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    # of rows that repeat no more can be wanted than there are places
    counted = rows.groupBy("id", "label", "vector").agg(F.count("*").alias("n"))
    hashed = counted.select("*", F.xxhash64("id", "label", "vector").alias("hash"), (is_anchor & F.col("id").isNotNull()).alias("anchor"))
    hashed = checkpointed(hashed.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "vector", "hash", "anchor", F.least("n", F.lit(max(positives, negatives))).cast("int").alias("n")))
    total, width = hashed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    shards = max(MIN_SHARDS, math.ceil(total / SHARD_ROWS))
    dealt = hashed.select(F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), "id", "label", "vector", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
    anchors = hashed.where("anchor").select(F.col("hash").alias("key"), "id", "label", "vector")
    sample = anchors.orderBy("key").limit(SAMPLE).select("vector").toArrow()  # bounded by SAMPLE
    vectors = _matrix(sample.column(0).combine_chunks(), width) if sample.num_rows else np.zeros((0, width))
    centres = centres_of(vectors, min(CLUSTERS, max(1, math.isqrt(len(vectors)))))
    if not len(centres):
        centres = np.zeros((1, width))
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(3), width)
            length = np.linalg.norm(v, axis=1)
            dots = v @ sent.value.T / np.where(length > 0, length, 1.0)[:, None]
            own = dots.argmax(axis=1)
            away = np.where(length > 0, angles(dots[np.arange(len(own)), own]), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32)), pa.array(away)], names=[*b.schema.names, "cluster", "away"])

    anchors = checkpointed(anchors.mapInArrow(clustered, "key long, id long, label long, vector array<double>, cluster int, away double"))
    widest = {r["cluster"]: r["w"] for r in anchors.groupBy("cluster").agg(F.max("away").alias("w")).collect()}  # bounded by CLUSTERS
    open_ = lambda x: F.array(F.lit(x))
    whole = anchors.drop("away").select("*", open_(-math.inf).alias("low"), open_(math.inf).alias("high"), open_(-math.inf).alias("need"))
    near = checkpointed(_searched(dealt, whole, centres, widest, width, shards, True, positives))
    listed = F.sort_array(F.collect_list(F.struct("place", "id", "score")))  # at most ``positives``
    bands = near.groupBy("key").agg(listed.alias("near"))
    bounded = anchors.drop("away").join(bands, "key")
    scaled = lambda x: F.transform("near", lambda p: p["score"] * x / 100)
    bounded = checkpointed(bounded.select("*", scaled(low).alias("low"), scaled(high).alias("high"), scaled(low).alias("need")))
    got = _searched(dealt, bounded.drop("near"), centres, widest, width, shards, False, negatives)
    named = got.join(bounded.select("key", F.col("id").alias("anchor_id"), "near"), "key").withColumn("p", F.get("near", F.col("band")))
    own = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return named.select("anchor_id", own("p.id").alias("positive_id"), F.col("place").cast("int").alias("rank"), own("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(math.inf))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = own.where(F.col("embedding").isNotNull() & finite).select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("vector"))
    got = hard_negatives(rows, F.pmod("id", F.lit(100)) == 0)
    return got.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long"), F.col("negative_score").cast("long"))
