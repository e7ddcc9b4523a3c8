"""Scores of newly arrived epochs, with a state of the open epochs only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.resolve import Catalog
from ..plans.score import compute_scores
from ..plans.spec import ScoreFile

_STATE = "Epoch {}, types array<string>, batches array<long>, last timestamp"


def complete_epochs(present: DataFrame, required: Sequence[str]) -> DataFrame:
    """Epochs of (Epoch, type) that have every required type."""
    wanted = present.where(F.col("type").isin(*required)).groupBy("Epoch").agg(F.count_distinct("type").alias("n"))
    return wanted.where(F.col("n") == len(set(required))).select("Epoch")


def score_stream(
    rows: DataFrame,
    catalog_of: Callable[[DataFrame], Catalog],
    file: ScoreFile,
    out: str,
    checkpoint: str,
    required: Sequence[str],
    time: str | None = None,
    delay: timedelta = timedelta(0),
) -> StreamingQuery:
    """Score a stream of long measurement rows (Epoch, type, axes..., value) into ``out``.

    An epoch's tables may arrive in any order, and each over several batches.  Rows go to
    a store by batch and epoch; the state has one row for each open epoch: the types it
    has, the batches that hold its rows, its last time.  The epochs of a batch that have
    all required types are scored from their own rows, which are all that is read; a
    later batch with more of them scores them again, and ``current`` gives the last
    results.  So a batch costs what its own epochs do, however many went before.

    With a ``time`` column an epoch closes, and leaves the state, when its last time is
    more than ``delay`` before the latest of all: it fails if it lacks a type, and
    ``final`` gives its scores.  Rows that come for an epoch that isn't open, from before
    what the earlier batches reached less ``delay``, go to ``late`` and change no score.

    A batch that runs again starts from the state that its predecessor left and replaces
    its own results.
    """
    store, states, marks, scores, failed, closed, late = (f"{out}/{name}" for name in ("rows", "state", "marks", "scores", "failed", "closed", "late"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, batch_id - 1
        state_of = _STATE.format(dict(batch.dtypes)["Epoch"])
        if batch_id:
            known, reached = spark.read.schema(state_of).parquet(f"{states}/batch={before}"), spark.read.parquet(f"{marks}/batch={before}").first()["reached"]
        else:
            known, reached = spark.createDataFrame([], state_of), None
        at = F.col(time).cast("timestamp") if time else F.lit(None).cast("timestamp")
        is_late = F.lit(False) if reached is None else F.col("_open").isNull() & F.coalesce(at < F.lit(reached) - F.lit(delay), F.lit(False))
        marked = batch.join(known.select("Epoch", F.lit(True).alias("_open")), "Epoch", "left").withColumn("_late", is_late).drop("_open")
        marked.select(*batch.columns, "_late", F.col("Epoch").alias("_epoch")).write.mode("overwrite").partitionBy("_late", "_epoch").parquet(f"{store}/batch={batch_id}")
        written = spark.read.schema(_stored(batch)).parquet(f"{store}/batch={batch_id}")
        written.where("_late").groupBy("Epoch").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        new = written.where("NOT _late").groupBy("Epoch").agg(F.collect_set("type").alias("types"), F.array(F.lit(batch_id).cast("long")).alias("batches"), F.max(at).alias("last"))
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)  # noqa: E731  of two rows
        now = known.unionByName(new).groupBy("Epoch").agg(union("types"), union("batches"), F.max("last").alias("last"))
        latest = now.agg(F.max("last")).first()[0]
        reached = max((t for t in (latest, reached) if t is not None), default=None)
        ends = F.lit(False) if reached is None else F.coalesce(F.col("last") < F.lit(reached) - F.lit(delay), F.lit(False))
        lacking = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("types")))
        now.select("*", lacking.alias("lacking"), ends.alias("closes")).write.mode("overwrite").parquet(f"{states}/.all/batch={batch_id}")
        now = spark.read.parquet(f"{states}/.all/batch={batch_id}")
        ready = now.where((F.size("lacking") == 0) & F.array_contains("batches", batch_id))
        held = sorted(r["b"] for r in ready.select(F.explode("batches").alias("b")).distinct().collect())
        lost = now.where("closes AND size(lacking) > 0").select("Epoch", F.concat(F.lit("closed without "), F.array_join("lacking", ", ")).alias("reason"))
        if held:
            # by epoch and batch these are folders, of which only those of the ready epochs are read
            kept = spark.read.schema(_stored(batch)).option("basePath", store).parquet(*[f"{store}/batch={b}" for b in held]).where("NOT _late")
            own = kept.join(F.broadcast(ready.select(F.col("Epoch").alias("_epoch"))), "_epoch", "left_semi").select(*batch.columns)  # one row an epoch of this batch
            result = compute_scores(catalog_of(own), file, persist=True)
            result.scores.write.mode("overwrite").parquet(f"{scores}/batch={batch_id}")
            lost = lost.unionByName(result.failed)
            lost.write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
            result.release()
        else:
            lost.write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
        now.where("closes").select("Epoch").write.mode("overwrite").parquet(f"{closed}/batch={batch_id}")
        spark.createDataFrame([(reached,)], "reached timestamp").write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        now.where("NOT closes").select("Epoch", "types", "batches", "last").write.mode("overwrite").parquet(f"{states}/batch={batch_id}")

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(batch: DataFrame):
    """The schema of stored rows: the batch's own, and its folders."""
    return batch.select("*", F.lit(False).alias("_late"), F.col("Epoch").alias("_epoch")).schema


def current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(scores, failed) of a stream's results so far, each epoch as its last batch left it; epochs may still be open."""
    scores, failed = (spark.read.parquet(f"{out}/{name}") for name in ("scores", "failed"))
    last = scores.select("Epoch", "batch").unionByName(failed.select("Epoch", "batch")).groupBy("Epoch").agg(F.max("batch").alias("batch"))
    return tuple(x.join(last, ["Epoch", "batch"]).select(*[c for c in x.columns if c != "batch"]) for x in (scores, failed))


def closed_epochs(spark: SparkSession, out: str) -> DataFrame:
    """(Epoch) of the epochs that have closed."""
    return spark.read.parquet(f"{out}/closed").select("Epoch").distinct()


def final(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(scores, failed) of the epochs that have closed."""
    done = closed_epochs(spark, out)
    return tuple(x.join(done, "Epoch", "left_semi") for x in current(spark, out))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """(Epoch, rows): how many rows came too late, by epoch; the rows are in the store, under ``_late=true``."""
    return spark.read.parquet(f"{out}/late").groupBy("Epoch").agg(F.sum("rows").alias("rows"))
