"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a token target.  Whole copies are taken as often as the target
holds the source; what remains is a budget for which documents are chosen by a
hash threshold.  Tokens are summed by source and hash bucket; the threshold lies
in the bucket in which the running sum passes the budget, and only that bucket is
split again, until the threshold falls on one hash value.  Nothing is sorted.

Defined cases: an empty table gives no rows; null and empty texts have size 0 and
are taken with 0 tokens; a null source is a source of its own, the last one;
documents that share a hash (equal id and text) are chosen together; a source
without tokens has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, n_words, table

HASH_BITS = 60
LEVEL_BITS = 12
#: Source tables up to this many rows are broadcast; larger ones are joined by key.
BROADCAST_SOURCES = 20_000


def hash60(*cols: Column) -> Column:
    """The first 60 bits of the MD5 of the values, joined by '|'; null counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_levels(sources: DataFrame, cap: float) -> DataFrame:
    """Targets that share the whole by weight, none above ``cap`` times its size.

    ``sources``: source, source_size, weight, one row each.  The excess of capped
    sources is shared again by weight: the common level per unit of weight is
    found by taking the sources in the order in which they would reach their cap.
    """
    everyone = Window.partitionBy()
    ordered = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    x = sources.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    x = x.withColumn("capped", F.coalesce(F.sum("limit").over(ordered), F.lit(0.0))).withColumn("used", F.coalesce(F.sum("weight").over(ordered), F.lit(0.0)))
    x = x.withColumn("level", (F.sum("source_size").over(everyone) - F.col("capped")) / (F.sum("weight").over(everyone) - F.col("used")))
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everyone)["level"])
    return x.select("source", "source_size", "weight", F.least("limit", F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def hinted(sources: DataFrame):
    """Broadcast for tables of one row a source, where there are few enough sources."""
    return F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda x: x)


def mix_plan(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, full (copies of every document) and threshold.

    A document is taken once more if its hash is at most the threshold.
    ``docs``: source, size, hash (60 bits).  ``targets``: source, source_size, target.
    """
    targets = checkpointed(targets)
    hint = hinted(targets)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("full", full).withColumn("need", F.col("target") - F.col("full") * F.col("source_size"))
    state = plan.select("source", "need", F.lit(0).cast("long").alias("prefix"), F.lit(-1).cast("long").alias("threshold"), F.lit(False).alias("done"))
    for level in range(HASH_BITS // LEVEL_BITS):
        rest = HASH_BITS - LEVEL_BITS * (level + 1)
        open_ = state.where(~F.col("done")).select(F.col("source").alias("s"), F.col("prefix").alias("p"))
        bucket = F.shiftright("hash", rest)
        inside = docs.join(hint(open_), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", rest + LEVEL_BITS) == F.col("p")))
        found = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        running = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
        cut = (
            found.withColumn("upto", running)
            .join(hint(state.select(F.col("source").alias("s"), "need")), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("upto") - F.col("sum") <= F.col("need")) & (F.col("need") < F.col("upto")))
            .select("s", "bucket", "sum", "lo", "hi", (F.col("upto") - F.col("sum")).alias("below"))
        )
        # no bucket passes the budget only where every document fits
        alone = (F.col("lo") == F.col("hi")) if rest else F.lit(True)
        nearer = F.col("below") + F.col("sum") - F.col("need") < F.col("need") - F.col("below")
        state = checkpointed(
            state.join(hint(cut), F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                F.when(F.col("done") | F.col("s").isNull() & F.col("bucket").isNull(), F.col("need")).otherwise(F.col("need") - F.col("below")).alias("need"),
                F.when(F.col("done") | F.col("bucket").isNull(), F.col("prefix")).otherwise(F.col("bucket")).alias("prefix"),
                F.when(F.col("done"), F.col("threshold"))
                .when(F.col("bucket").isNull(), F.lit((1 << HASH_BITS) - 1))
                .when(alone, F.when(nearer, F.col("hi")).otherwise(F.col("lo") - 1))
                .otherwise(F.col("threshold"))
                .alias("threshold"),
                (F.col("done") | F.col("bucket").isNull() | alone).alias("done"),
            )
        )
        if not state.where(~F.col("done")).take(1):
            break
    state = state.select(F.col("source").alias("s"), "threshold")
    return checkpointed(plan.join(hint(state), F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "full", "threshold"))


def planned(docs: DataFrame, plan: DataFrame, hash_: Column) -> DataFrame:
    """``docs`` with source_size, target and copies (long), by their source and hash."""
    own = plan.select(F.col("source").alias("_s"), "source_size", "target", F.col("full").alias("_full"), F.col("threshold").alias("_threshold"))
    joined = docs.join(hinted(plan)(own), F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("copies", F.col("_full") + (hash_ <= F.col("_threshold")).cast("long")).drop("_s", "_full", "_threshold")


def sources_by_rank(docs: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Sizes by source, weighted by a repeating cycle in code point order, null last."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sizes.withColumn("weight", F.element_at(weights, (rank % len(cycle) + 1).cast("int")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every document, kept for the passes to come."""
    return checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash")))


def mix_documents(docs: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """doc_id, source, size, hash, source_size, target and copies of every document."""
    own = sized(docs)
    return planned(own, mix_plan(own, water_levels(sources_by_rank(own, cycle), cap)), F.col("hash"))


def mixed_rows(docs: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    own = sized(docs)
    plan = mix_plan(own, water_levels(sources_by_rank(own, cycle), cap))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), hash60(F.col("doc_id"), F.col("text")).alias("hash"))
    taken = planned(rows, plan, F.col("hash")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER w, 0) AS capped, coalesce(sum(weight) OVER w, 0) AS used FROM l
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (
  SELECT *, (sum(source_size) OVER () - capped) / (sum(weight) OVER () - used) AS level FROM o),
t AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT arg_min(level, cap / weight) FROM v WHERE level <= cap / weight)) AS target FROM v),
f AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
r AS (
  SELECT d.*, f.source_size, f.target, f.copies, f.target - f.copies * f.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (copies + CASE WHEN upto <= need OR (upto - own <= need AND upto - need < need - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
