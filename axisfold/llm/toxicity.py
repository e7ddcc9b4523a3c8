"""Toxicity by nearest labelled examples with exact TF-IDF cosine.

A bounded sample of labelled documents is dealt into three folds by a hash of the text,
and there is one model for each fold, which scores the texts of that fold and never
saw their labels: the next fold tells how much words weigh, that and the one after it
are the examples, and the votes among the last one's texts fit the curve.  So a text's
own label is no part of its score in any way, and the curve is fitted to texts whose
labels are no part of the weights either.

The examples of a model are TF-IDF vectors over all words that at least
``MIN_EXAMPLES`` of them hold; a word's IDF is multiplied by how many standard
deviations its toxic examples in the fold of weights are away from those that chance
would give it, so that what tells the labels apart weighs more.  The vectors form an inverted
index whose postings lie in blocks of examples; for every word and block it keeps
the largest weight.  A document sums these maxima into a bound for each block, looks
into the blocks of the highest bounds, and then into every other block whose bound
reaches the k-th best cosine so far, so the neighbours are exact.  Neighbours vote by
their cosine; a logistic curve turns the vote into a probability.  The neighbours'
ids are the evidence.

Words are runs of letters, digits and non-ASCII characters; A-Z count as a-z.
Words that no two examples hold are left out of all vectors and their lengths.

Defined cases: a null, empty or wordless text has no neighbours and gets the
calibrated score of an undecided vote, the share of toxic examples; labels that
repeat, or stand with several documents of one text, count as toxic if any says so;
many texts under one doc_id are examples of their own, those of least hash up to the
bound; ties among neighbours go by a hash of the text; a model without examples gives
0; repeated rows are scored alike; a null doc_id is never an example and counts as not
held out; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: At most so many labelled documents become examples, those of lowest hash.
MAX_EXAMPLES = 4_000
FOLDS = 3
MIN_EXAMPLES = 2
NEIGHBOURS = 15
BLOCK = 32
#: So many blocks are looked into first.
FIRST_BLOCKS = 4
PRIOR_WEIGHT = 0.5
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def body_of(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(1))


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0]..end[0]-1, begin[1]..end[1]-1, and so on."""
    size = end - begin
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


@dataclass
class Models:
    """Examples, and for each word its entries, one a block, with the largest weight in each model and the postings of the block.

    The models share the postings, which hold how often a word stands in an example; a
    model has weights of words, and lengths of examples, of its own.
    """

    vocabulary: dict[bytes, int]
    weight: np.ndarray  # by model and word, 0 for words that it doesn't know
    ids: np.ndarray
    bodies: np.ndarray
    labels: np.ndarray
    of_word: np.ndarray  # where each word's entries begin
    block: np.ndarray
    of_entry: np.ndarray  # where each entry's postings begin
    example: np.ndarray
    tf: np.ndarray
    scale: np.ndarray  # by model and example, 1 over its length; 0 for examples of the model's own fold
    block_max: np.ndarray  # by model and entry
    slope: list[float]
    shift: list[float]

    def prior(self, k: int) -> float:
        own = self.labels[self.bodies % FOLDS != k]
        return float(own.mean()) if len(own) else 0.0

    def vector(self, text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and unit-length TF-IDF weights of a text in a model."""
        at, counts = counted(text, self.vocabulary)
        w = (1 + np.log(counts)) * self.weight[k][at]
        at, w = at[w > 0], w[w > 0]
        return at, w / math.sqrt(float(w @ w)) if len(w) else w

    def neighbours(self, text: str | None, k: int | None = None) -> list[tuple[float, int]]:
        """The nearest examples of other texts as (cosine, position), nearest first; none of cosine 0.

        ``k`` is the model, by default that of the text's own fold.
        """
        body = body_of(text)
        k = body % FOLDS if k is None else k
        at, w = self.vector(text, k)
        if not len(at) or not len(self.ids):
            return []
        size = self.of_word[at + 1] - self.of_word[at]
        entries, words = ranges(self.of_word[at], self.of_word[at + 1]), np.repeat(w, size)
        blocks = self.block[entries]
        bounds = np.bincount(blocks, words * self.block_max[k][entries], minlength=-(-len(self.ids) // BLOCK))
        words = words * np.repeat(self.weight[k][at], size)
        scores, scale = np.zeros(len(self.ids)), np.where(self.bodies == body, 0.0, self.scale[k])

        def look(chosen: np.ndarray) -> None:
            inside = chosen[blocks]
            begin, end = self.of_entry[entries[inside]], self.of_entry[entries[inside] + 1]
            p = ranges(begin, end)
            scores[:] += np.bincount(self.example[p], self.tf[p] * np.repeat(words[inside], end - begin), minlength=len(scores)) * scale

        first = np.zeros(len(bounds), dtype=bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]] = True
        look(first)
        least = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if len(scores) > NEIGHBOURS else 0.0
        look(~first & (bounds >= max(least - 1e-9, 1e-9)))
        # a few more than needed, so that ties at the last place are told apart by text
        least = np.partition(scores, -NEIGHBOURS)[-NEIGHBOURS] if len(scores) > NEIGHBOURS else 0.0
        near = np.nonzero(scores >= max(least, 1e-9))[0]
        near = near[np.lexsort((self.bodies[near], -scores[near]))][:NEIGHBOURS]
        return list(zip(scores[near].tolist(), near.tolist(), strict=True))

    def vote(self, near: list[tuple[float, int]], k: int) -> float:
        """The log odds of toxicity by the neighbours, each as much as the square of its cosine."""
        weight = sum(c * c for c, _ in near)
        toxic = sum(c * c * self.labels[i] for c, i in near)
        p = min(max((toxic + PRIOR_WEIGHT * self.prior(k)) / (weight + PRIOR_WEIGHT), 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def calibrate(self, k: int, votes: np.ndarray, labels: np.ndarray) -> None:
        """Fit a model's logistic curve from votes to labels."""
        y, theta = labels.astype(float), np.array([1.0, 0.0])
        x = np.stack([votes, np.ones(len(votes))], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ theta))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * (theta - [1.0, 0.0]))
            theta = theta + step
            if np.abs(step).max() < 1e-8:
                break
        self.slope[k], self.shift[k] = float(theta[0]), float(theta[1])

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        k = body_of(text) % FOLDS
        if not self.scale[k].any():
            return 0.0, [], []
        near = self.neighbours(text)
        z = self.slope[k] * self.vote(near, k) + self.shift[k]
        return 1 / (1 + math.exp(-z)), [int(self.ids[i]) for _, i in near[:5]], [c for c, _ in near[:5]]


def counted(text: str | None, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's words, in order, and how often each stands in it."""
    find = vocabulary.get
    counts = Counter(t for t in map(find, terms(text)) if t is not None)
    at = np.array(sorted(counts), dtype=np.int64)
    return at, np.array([counts[t] for t in at.tolist()], dtype=np.float64)


def word_weights(n: int, df: np.ndarray, told: tuple[int, int], told_df: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """IDF in n examples, times the distance of the toxic ones from their expected number, in its standard deviations.

    ``told``, the number of examples and of toxic ones, ``told_df`` and ``hits`` are of the fold of weights.
    """
    idf = np.log(1 + n / df)
    if told[1] in (0, told[0]):
        return idf
    expected = told_df * (told[1] / told[0])
    return idf * np.maximum(np.abs(hits - expected) / np.sqrt(np.maximum(expected, 1e-9)), 1e-3)


def built(vocabulary: dict[bytes, int], weight: np.ndarray, examples: list[tuple[int, int, int, np.ndarray, np.ndarray]]) -> Models:
    """The models of examples (doc_id, body, label, words, counts)."""
    leading = weight.sum(axis=0)
    # folds lie apart, so that a model passes over the blocks of its own; examples with the
    # same label and leading word share blocks, which keeps the bounds tight
    examples = sorted(examples, key=lambda r: (r[1] % FOLDS, r[2], r[3][int(np.argmax((1 + np.log(r[4])) * leading[r[3]]))] if len(r[3]) else -1, r[1]))
    ids, bodies, labels = (np.array([r[i] for r in examples], dtype=np.int64) for i in range(3))
    words = np.concatenate([r[3] for r in examples] or [np.zeros(0, np.int64)])
    tf = 1 + np.log(np.concatenate([r[4] for r in examples] or [np.zeros(0)]))
    example = np.repeat(np.arange(len(examples)), [len(r[3]) for r in examples])
    scale = np.zeros((FOLDS, len(examples)))
    for k in range(FOLDS):
        length = np.sqrt(np.bincount(example, (tf * weight[k][words]) ** 2, minlength=len(examples)))
        np.divide(1.0, length, out=scale[k], where=(length > 0) & (bodies % FOLDS != k))
    order = np.argsort(words, kind="stable")  # within a word, examples stay in order
    words, tf, example = words[order], tf[order], example[order]
    block = example // BLOCK
    begins = np.nonzero(np.diff(words, prepend=-1) | np.diff(block, prepend=-1))[0]
    most = [np.maximum.reduceat(tf * scale[k][example], begins) * weight[k][words[begins]] if len(begins) else tf for k in range(FOLDS)]
    of_word = np.searchsorted(words[begins], np.arange(len(vocabulary) + 1))
    return Models(vocabulary, weight, ids, bodies, labels, of_word, block[begins], np.append(begins, len(words)), example.astype(np.int32), tf, scale, np.array(most), [1.0] * FOLDS, [0.0] * FOLDS)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Models:
    """The models of a bounded sample of labelled documents outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")  # bounded by max_examples
    found = checkpointed(found.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").cast("long").alias("doc_id")))
    least = found.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(max_examples)
    found = found.join(F.broadcast(least), F.xxhash64("text") == F.col("h"), "left_semi")  # bounded by max_examples
    spark = found.sparkSession

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(body_of(text.as_py()) % FOLDS, y, t) for y, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for t in set(terms(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["fold", "toxic", "term"])

    # by term, its examples and toxic examples in each fold
    counts = [F.count_if(F.col("fold") == k).alias(f"df{k}") for k in range(FOLDS)] + [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("toxic"))), F.lit(0)).alias(f"hits{k}") for k in range(FOLDS)]
    by_term = found.select("toxic", "text").mapInArrow(distinct, "fold int, toxic int, term binary").groupBy("term").agg(*counts)
    rows = by_term.where(" + ".join(f"df{k}" for k in range(FOLDS)) + f" >= {MIN_EXAMPLES}").orderBy("term").toPandas()  # bounded by the words of the examples

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([body_of(t.as_py()) % FOLDS for t in b.column(1)], pa.int32()), b.column(0)], names=["fold", "toxic"])

    sizes = {k: (0, 0) for k in range(FOLDS)} | {r["fold"]: (r["n"], r["p"]) for r in found.select("toxic", "text").mapInArrow(folds, "fold int, toxic int").groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).collect()}
    vocabulary, weight = {bytes(t): i for i, t in enumerate(rows["term"])}, np.zeros((FOLDS, len(rows)))
    for k in range(FOLDS):
        a, z = (k + 1) % FOLDS, (k + 2) % FOLDS
        df = (rows[f"df{a}"] + rows[f"df{z}"]).to_numpy(dtype=float)
        own = np.nonzero(df >= MIN_EXAMPLES)[0]
        weight[k][own] = word_weights(sizes[a][0] + sizes[z][0], df[own], sizes[a], rows[f"df{a}"].to_numpy(dtype=float)[own], rows[f"hits{a}"].to_numpy(dtype=float)[own])
    sent_words = spark.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [counted(t.as_py(), sent_words.value) for t in b.column(2)]
            cols = [b.column(0), pa.array([body_of(t.as_py()) for t in b.column(2)], pa.int64()), b.column(1), pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "body", "toxic", "at", "n"])

    packed = found.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, body long, toxic int, at binary, n binary").collect()  # bounded by max_examples
    sent_words.destroy()
    models = built(vocabulary, weight, [(r["doc_id"], r["body"], r["toxic"], np.frombuffer(r["at"], dtype=np.int32).astype(np.int64), np.frombuffer(r["n"], dtype=np.int32).astype(np.float64)) for r in packed])
    if packed:
        sent = spark.sparkContext.broadcast(models)

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for b in batches:
                models_of = [(body_of(t.as_py()) - 2) % FOLDS for t in b.column(1)]
                made = [own.vote(own.neighbours(t.as_py(), k), k) for k, t in zip(models_of, b.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(models_of, pa.int32()), b.column(0), pa.array(made, pa.float64())], names=["model", "toxic", "vote"])

        got = found.select("toxic", "text").mapInArrow(votes, "model int, toxic int, vote double").orderBy("model", "vote", "toxic").toPandas()
        sent.destroy()
        for k, own in got.groupby("model"):
            models.calibrate(int(k), own["vote"].to_numpy(), own["toxic"].to_numpy())
    return models


def scored(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, score, evidence (ids of the nearest examples) and their cosines."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the texts of max_examples examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for b in batches:
            out = [own.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _, _ in out], pa.float64()), pa.array([e for _, e, _ in out], pa.list_(pa.int64())), pa.array([c for _, _, c in out], pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "cosines"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, evidence array<long>, cosines array<double>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
