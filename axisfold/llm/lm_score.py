"""Stupid-backoff language-model scores from n-gram counts over the whole corpus.

Documents fall into blocks by hash.  Each block explodes its documents into
n-grams and sends every different one once, with its count in the block, to the
count table's partition that the n-gram's hash names.  There the counts of all
blocks are summed and joined back: each block learns how often its n-grams occur
elsewhere.  It then scores its documents and sums per document.

A document is scored by the counts of all other documents, so text that occurs
once in the corpus doesn't vouch for itself.  The longest n-gram (of at most
``order`` words) that others have gives count / count of its first words, times
``BACKOFF`` for each order given up; a word that no other document has counts as
one more backoff from 1 / the other documents' words.

N-grams travel as sorted hashes in packed arrays, so a very common n-gram is one
entry for each block.  They are told apart by their partition and KEY_BYTES more
bytes of a 64-bit hash.

Defined cases: a null, empty or blank text has 0 words, score 0 and no mean; where
no other document has words, others count as one word; repeated rows are documents
of their own, so they vouch for each other; rows that repeat more than MANY times are
counted where they lie, scored once, and made again over tasks; ids may be null; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, table

ORDER = 3
BACKOFF = 0.4
BLOCK_CHARS = 6_000_000
#: About so many n-grams meet in one partition of the count table.
PARTITION_GRAMS = 2_000_000
KEY_BYTES = 6
#: Rows equal in doc_id and text that are more than so many are one row with a number.
MANY = 1_000
#: The keys of so many such rows, 16 bytes each, are sent to every task; beyond, they are joined.
MOST_SENT = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: The n-gram of no words, whose count is the number of words.
NOTHING = _mixed(np.array([1], dtype=np.uint64))


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words of each text."""
    words, sizes = [], []
    for t in texts:
        w = (t or "").encode("utf-8", "surrogatepass").split()
        sizes.append(len(w))
        words += w
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), np.array(sizes, dtype=np.int64)


def grams(words: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of its n-grams and the places of their last words."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, chain, out = np.arange(len(words)), words, []
    for n in range(1, order + 1):
        if n > 1:
            keep = place[at] >= n - 1
            at = at[keep]
            chain = full[at - 1] * _MIX + words[at]  # noqa: F821  full is the chain of the order below, by place
        full = np.zeros(len(words), dtype=np.uint64)
        full[at] = chain
        out.append((_mixed(chain + np.uint64(n)), at))
    return out


def squeeze(x: np.ndarray) -> bytes:
    """Small whole numbers, one byte each before compression; those from 255 on follow in full."""
    large = x >= 255
    body = np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype(np.int64).tobytes()
    return np.int64(len(x)).tobytes() + zlib.compress(body, 1)


def unsqueeze(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    body = zlib.decompress(data[8:])
    out = np.frombuffer(body, dtype=np.uint8, count=n).astype(np.int64)
    out[out == 255] = np.frombuffer(body[n:], dtype=np.int64)
    return out


def pack(keys: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Sorted keys, cut to the KEY_BYTES after their partition's bits: the steps of
    the high bytes, and the low four bytes."""
    keys = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)
    return squeeze(np.diff((keys >> np.uint64(32)).astype(np.int64), prepend=0)), keys.astype(np.uint32).tobytes()


def unpack(steps: bytes, low: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(steps)).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, dtype=np.uint32)


def _slices(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    part = (keys >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
    cuts = np.nonzero(np.diff(part))[0] + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
    return [(int(part[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


def summed(which: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by position."""
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, which, weights)
    return out


def block_counts(texts, copies: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    words, sizes = word_hashes(texts)
    made = grams(words, sizes, order)
    keys, which, counts = np.unique(np.concatenate([h for h, _ in made]), return_inverse=True, return_counts=True)
    if (copies > 1).any():
        often = np.repeat(copies, sizes)
        counts = summed(which, np.concatenate([often[at] for _, at in made]), len(keys))
    at = np.searchsorted(keys, NOTHING)
    return np.insert(keys, at, NOTHING), np.insert(counts, at, int((sizes * copies).sum()))


def score_block(texts, copies: np.ndarray, elsewhere: np.ndarray, order: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Words and log scores of each text; ``elsewhere`` holds the other blocks' counts in key order."""
    words, sizes = word_hashes(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    made = grams(words, sizes, order)
    keys = np.concatenate([h for h, _ in made])
    by_key = np.argsort(keys, kind="stable")  # within a key, documents stay in order
    sorted_keys, owner = keys[by_key], np.concatenate([doc[at] for _, at in made])[by_key]
    fresh = np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    pair = fresh | np.concatenate(([True], owner[1:] != owner[:-1])) if len(keys) else fresh
    unique, own = np.cumsum(fresh) - 1, np.cumsum(pair) - 1
    distinct = sorted_keys[fresh]
    at = int(np.searchsorted(distinct, NOTHING[0]))
    total = int(elsewhere[at]) + int((sizes * copies).sum())
    elsewhere = np.delete(elsewhere, at)
    counts = np.empty(len(keys), dtype=np.int64)
    here = np.bincount(unique, minlength=len(distinct)) if (copies == 1).all() else summed(unique, copies[owner], len(distinct))
    counts[by_key] = (elsewhere + here)[unique] - np.bincount(own)[own] if len(keys) else 0
    others = np.maximum(total - sizes, 1)[doc].astype(float)
    by_order, begin = [others], 0
    for h, where in made:
        c = np.zeros(len(words), dtype=np.int64)
        c[where] = counts[begin : begin + len(h)]
        by_order.append(c)
        begin += len(h)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = np.minimum(place + 1, order)
    score = np.log(1.0 / others) + depth * np.log(backoff)
    for n in range(1, order + 1):
        seen = by_order[n] > 0
        first = by_order[0][seen] if n == 1 else by_order[n - 1][np.nonzero(seen)[0] - 1]
        score[seen] = np.log(by_order[n][seen] / first) + (depth[seen] - n) * np.log(backoff)
    return sizes, np.bincount(doc, weights=score, minlength=len(sizes))


def counted(rows: DataFrame, many: int) -> tuple[DataFrame, bool]:
    """doc_id, text, copies, and whether any copies are: rows equal more than ``many`` times are one, others stay as they are."""
    once = F.lit(1).cast("long").alias("copies")
    key = [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("body")]
    often = checkpointed(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > many).select("doc", "body"))
    found = often.count()
    if not found:
        return rows.select("doc_id", "text", once), False
    if found <= MOST_SENT:
        often = F.broadcast(often)
    met = [k == often[n] for k, n in zip(key, ("doc", "body"), strict=True)]
    one = rows.join(often, met, "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return rows.join(often, met, "left_anti").select("doc_id", "text", once).unionByName(one), True


def made_again(scored: DataFrame, many: int) -> DataFrame:
    """Each row as often as ``copies`` says, in pieces of at most ``many`` that are dealt over tasks."""
    plain, zero = ["doc_id", "n_words", "score"], F.lit(0).cast("long")
    pieces = scored.withColumn("piece", F.explode(F.sequence(zero, F.floor((F.col("copies") - 1) / many)))).repartition(*plain, "piece")
    last = F.least(F.lit(many).cast("long"), F.col("copies") - F.col("piece") * many) - 1
    return pieces.select(*plain, F.explode(F.sequence(zero, last)).alias("copy")).select(*plain)


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_chars: int = BLOCK_CHARS, partition_grams: int = PARTITION_GRAMS, many: int = MANY) -> DataFrame:
    """doc_id, n_words, score (sum of natural logs) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    bits = max(0, int(np.ceil(np.log2(max(1, chars * 0.1 * order / partition_grams)))))
    rows, repeated = counted(rows, many)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(blocks)).cast("int"))

    def send(block: pa.Table) -> pa.Table:
        keys, counts = block_counts(block.column("text").to_pylist(), block.column("copies").to_numpy(), order)
        cut = _slices(keys, bits)
        packed = [pack(keys[a:b], bits) for _, a, b in cut]
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in cut], pa.int32()),
                "block": pa.array([block.column("block")[0].as_py()] * len(cut), pa.int32()),
                "steps": pa.array([x for x, _ in packed], pa.binary()),
                "low": pa.array([x for _, x in packed], pa.binary()),
                "counts": pa.array([squeeze(counts[a:b]) for _, a, b in cut], pa.binary()),
            }
        )

    def count(part: pa.Table) -> pa.Table:
        keys = [unpack(x.as_py(), y.as_py()) for x, y in zip(part.column("steps"), part.column("low"), strict=True)]
        counts = [unsqueeze(x.as_py()) for x in part.column("counts")]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        flat = np.concatenate(counts)
        others = np.bincount(which, weights=flat).astype(np.int64)[which] - flat
        ends = np.cumsum([len(k) for k in keys])
        sent = [squeeze(o) for o in np.split(others, ends[:-1])]
        return pa.table({"block": part.column("block"), "part": part.column("part"), "elsewhere": pa.array(sent, pa.binary())})

    def score(block: pa.Table, heard: pa.Table) -> pa.Table:
        parts = heard.column("part").to_numpy()
        told = heard.column("elsewhere").to_pylist()
        elsewhere = np.concatenate([unsqueeze(told[i]) for i in np.argsort(parts)])
        sizes, scores = score_block(block.column("text").to_pylist(), block.column("copies").to_numpy(), elsewhere, order, backoff)
        return pa.table({"doc_id": block.column("doc_id"), "copies": block.column("copies"), "n_words": pa.array(sizes), "score": pa.array(scores)})

    sent = rows.groupBy("block").applyInArrow(send, "part int, block int, steps binary, low binary, counts binary")
    heard = sent.groupBy("part").applyInArrow(count, "block int, part int, elsewhere binary")
    scored = rows.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(score, "doc_id long, copies long, n_words long, score double")
    return made_again(scored, many) if repeated else scored.drop("copies")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round(F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")), 6).alias("mean_score"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)),
g AS (
  SELECT doc_id, i, w AS a,
         CASE WHEN i > 1 THEN lag(w) OVER o || ' ' || w END AS b,
         CASE WHEN i > 2 THEN lag(w, 2) OVER o || ' ' || lag(w) OVER o || ' ' || w END AS c
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT *, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY a, doc_id) AS ca,
         CASE WHEN b IS NOT NULL THEN count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY b, doc_id) ELSE 0 END AS cb,
         CASE WHEN c IS NOT NULL THEN count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) ELSE 0 END AS cc,
         greatest(count(*) OVER () - count(*) OVER (PARTITION BY doc_id), 1) AS n
  FROM g),
s AS (
  SELECT doc_id, least(i, 3) AS d, ca, cb, cc, n, lag(ca) OVER o AS pa, lag(cb) OVER o AS pb
  FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (
  SELECT doc_id, count(*) AS n_words,
         sum(CASE WHEN cc > 0 THEN ln(cc / pb) WHEN cb > 0 THEN ln(cb / pa) + (d - 2) * ln(0.4)
                  WHEN ca > 0 THEN ln(ca / n) + (d - 1) * ln(0.4) ELSE ln(1 / n) + d * ln(0.4) END) AS score
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_words, 0) AS n_words, round(coalesce(t.score, 0), 4) AS score, round(t.score / t.n_words, 6) AS mean_score
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
