"""Helpers shared by the text operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    body = trimmed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RUN))


def n_words(text: Column) -> Column:
    body = trimmed(text)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, SPACE_RUN))).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's own ``spark.checkpoint.dir``.  Where none is named, a
    temporary one stands in if everything runs in one process; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def settled(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the new columns, each computed once.

    The columns pass through a generator, which no later filter is pushed below, so
    what uses them never repeats what they cost.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("made")
    return df.select(*keep, made).select(*keep, "made.*")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Stands for a missing doc_id, after all others.
NO_ID = (1 << 63) - 1


def document_key(text: Column) -> list[Column]:
    """``doc`` and ``body``, which tell documents apart; a doc_id may stand with several texts."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text.cast("string")).alias("body")]


def one_row_each(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """One row of each document that ``keepers`` (doc, body) names.

    Of rows that are equal in doc_id and text the one with the least hash stays.
    """
    doc, body, order = (free_name(docs, n) for n in ("_doc", "_body", "_order"))
    keys = [k.alias(n) for k, n in zip(document_key(F.col("text")), (doc, body), strict=True)]
    rows = docs.select("*", *keys).join(keepers.select(F.col("doc").alias(doc), F.col("body").alias(body)), [doc, body], "left_semi")
    first = Window.partitionBy(doc, body).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return rows.withColumn(order, F.row_number().over(first)).where(F.col(order) == 1).drop(doc, body, order)
