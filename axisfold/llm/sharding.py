"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows fall into blocks by a hash of their content.  How many rows each block sends
to each shard is drawn once, exactly from the multivariate hypergeometric law that a
uniform permutation of all rows would follow, so shard sizes are exact (at most one
row apart).  Rows are permuted inside their block, dealt by the drawn counts,
exchanged, and permuted again inside their shard.

The driver draws the matrix, one count for each block and shard: 40 shards and 10**11
rows in blocks of a million make 4 million counts.

Defined cases: an empty table gives no rows; null and empty texts are rows like
any other; rows equal in every column get different slots, and where they are more
than ``MANY`` they are dealt over all blocks by copy, in ranges of ``RANGE`` copies
that are tasks' work apart; input columns named like an output column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Tables of up to so many numbers are broadcast; larger ones are joined by key.
BROADCAST_CELLS = 4_000_000
#: More equal rows than this don't share a block.
MANY = 1_000
#: Copies are made in ranges of so many.
RANGE = 1_000_000


def hypergeometric(draw: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` things taken from good + bad are good, for pools of any size.

    The law is inverted around its mode: the probabilities of neighbouring counts
    have a simple ratio, so they are known up to a factor, which their sum gives.
    Counts over 12 standard deviations (and 60) from the mode have less than 1e-30.
    """
    least, most, pool = max(0, sample - bad), min(sample, good), good + bad
    if least == most:
        return least
    mode = min(max((sample + 1) * (good + 1) // (pool + 2), least), most)
    reach = 60 + math.ceil(12 * math.sqrt(sample / pool * good * (bad / pool) * ((pool - sample) / max(pool - 1, 1))))
    lo, hi = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    ratio = (good - k) / (k + 1) * ((sample - k) / (bad - sample + k + 1))  # p(k + 1) / p(k)
    up, down = np.cumprod(ratio[mode - lo :]), np.cumprod(1 / ratio[: mode - lo][::-1])[::-1]
    upto = np.cumsum(np.concatenate((down, [1.0], up)))
    return lo + int(np.searchsorted(upto, draw.random() * upto[-1], side="right"))


def communication_matrix(block_sizes: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Row and column sums are exact; the counts follow a uniform permutation."""
    total = sum(block_sizes)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    draw = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(block_sizes), n_shards), dtype=np.int64)
    for b, size in enumerate(block_sizes):
        todo, pool = size, sum(left)
        for s in range(n_shards):
            pool -= left[s]
            k = hypergeometric(draw, left[s], pool, todo)
            out[b, s] = k
            todo, left[s] = todo - k, left[s] - k
    return out


def _numbered(keyed: DataFrame) -> DataFrame:
    """The rows with ``copy``: 0, or a number of its own for each of many equal rows."""
    hashes = ["first", "second"]
    many = checkpointed(keyed.groupBy(*hashes).count().where(F.col("count") > MANY))
    n, ranges = many.agg(F.count("*"), F.sum(F.ceil(F.col("count") / RANGE))).first()
    if not n:
        return keyed.withColumn("copy", F.lit(0).cast("long"))
    hint = F.broadcast if 2 * n <= BROADCAST_CELLS else lambda x: x
    once = keyed.join(hint(many), hashes, "left_semi").dropDuplicates(hashes)
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(RANGE).cast("long"))).alias("start")
    tasks = min(ranges, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = once.join(hint(many), hashes).select("row", *hashes, "count", start).repartition(tasks, *hashes, "start")  # by number, so that ranges stay apart
    copies = F.explode(F.sequence("start", F.least(F.col("start") + RANGE, F.col("count")) - 1)).alias("copy")
    dealt = pieces.select("row", *hashes, copies)
    return keyed.join(hint(many), hashes, "left_anti").select("row", *hashes, F.lit(0).cast("long").alias("copy")).unionByName(dealt)


def shard_rows(df: DataFrame, n_shards: int, seed: int = 0, rows_per_block: int = 1_000_000, min_blocks: int = 64) -> DataFrame:
    """Every row with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    No task holds more than about ``rows_per_block`` rows.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    df = df.drop("shard", "slot")
    spark, cols = df.sparkSession, [F.col(f"`{c}`") for c in df.columns]
    total = df.count()
    blocks = max(1, min_blocks, math.ceil(total / rows_per_block))
    keyed = df.select(F.struct(*cols).alias("row"), *[F.xxhash64(F.lit(f"{seed}/{k}"), *cols).alias(k) for k in ("first", "second")])
    keyed = _numbered(keyed).select("row", *[F.when(F.col("copy") > 0, F.xxhash64("copy", k)).otherwise(F.col(k)).alias(k) for k in ("first", "second")])
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64(F.lit(f"{seed}/block"), "first"), F.lit(blocks)).cast("int"))
    counted = {r["block"]: r["count"] for r in keyed.groupBy("block").count().collect()}
    sizes = [counted.get(b, 0) for b in range(blocks)]
    ends = communication_matrix(sizes, n_shards, seed).cumsum(axis=1)
    deal = spark.createDataFrame([(b, e.tolist()) for b, e in enumerate(ends)], "block int, ends array<long>")
    rank = F.row_number().over(Window.partitionBy("block").orderBy("first", "second")) - 1
    dealt = (
        keyed.withColumn("rank", rank)
        .join(F.broadcast(deal) if blocks * n_shards <= BROADCAST_CELLS else deal, "block")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    )
    parts = max(8, math.ceil(total / n_shards / rows_per_block))
    dealt = dealt.select("row", "shard", "first", "second", F.pmod(F.xxhash64("second"), F.lit(parts)).cast("int").alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    placed = dealt.join(F.broadcast(starts) if n_shards * parts <= BROADCAST_CELLS else starts, ["shard", "part"])
    slot = F.col("start") + F.row_number().over(Window.partitionBy("shard", "part").orderBy("second", "first")) - 1
    return placed.select("row.*", "shard", slot.cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(sized, 40, seed=8).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
