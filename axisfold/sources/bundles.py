"""Bundles of one epoch rewritten: replicas of one board and chip, or the lowest board and chip alone.

python -m axisfold.sources.bundles --data-dir dummy --out replicas --chips 2,3
python -m axisfold.sources.bundles --data-dir result --out single --single

Every table becomes a folder of its name, which ``open_catalog`` reads like a file.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.synth import expand_boards_chips, pseudo_single
from . import tables
from .headers import header_index


def rewrite_bundle(spark: SparkSession, source: str, out: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """The files of a directory under ``out``, with ``change`` applied to the rows of every table that has boards.

    Cells other than Board and Chip stay as they are written, quotes aside.  Code maps,
    tables without boards and files of other kinds keep their lines and names; a table
    of temperatures may come without a header.
    """
    source, out = source.rstrip("/"), out.rstrip("/")
    entry = F.when(F.col("path").rlike("/part-[^/]*$"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.col("path"))  # a file, or a folder that Spark wrote
    files = spark.read.format("binaryFile").load(f"{source}/*").select("path", entry.alias("entry")).collect()  # of one directory
    named = [r["path"] for r in files if r["entry"].endswith((".csv", ".csv.gz"))]
    cells_of = {r["path"]: r["cells"] for r in header_index(spark, named).collect()} if named else {}
    heads = {r["entry"]: cells_of[r["path"]] for r in files if r["path"] in cells_of}
    for path in sorted({r["entry"] for r in files}):
        name = path.rpartition("/")[2]
        cells = heads.get(path, [])
        table = name.removesuffix(".gz").removesuffix(".csv")
        plain = path not in heads or table.startswith("map_")
        bare = not plain and table in tables.RESERVED and "Board" not in cells
        if plain or not (bare or "Board" in cells):
            spark.read.text(path).coalesce(1).write.text(f"{out}/{name.removesuffix('.gz')}")
            continue
        columns = ["Board", *[f"_{i}" for i in range(1, len(cells))]] if bare else cells
        df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", not bare).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
        for axis in {"Board", "Chip"} & set(columns):
            df = df.withColumn(axis, F.col(axis).cast("double").cast("long"))
        change(df).write.option("header", not bare).option("emptyValue", "").csv(f"{out}/{table}.csv")


def replicate_bundle(spark: SparkSession, source: str, out: str, chips: Sequence[int]) -> None:
    """Board b of ``out`` has ``chips[b]`` chips, all with the rows of the one board and chip of ``source``; more than one is refused."""
    rewrite_bundle(spark, source, out, lambda df: expand_boards_chips(df, chips))


def single_bundle(spark: SparkSession, source: str, out: str) -> None:
    """Of each table the lowest board and its lowest chip, as number 0."""
    rewrite_bundle(spark, source, out, pseudo_single)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m axisfold.sources.bundles", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--data-dir", required=True, help="the directory of one epoch")
    parser.add_argument("--out", required=True, help="a new directory")
    how = parser.add_mutually_exclusive_group(required=True)
    how.add_argument("--chips", help="numbers of chips by board, such as 2,3")
    how.add_argument("--single", action="store_true", help="keep the lowest board and chip alone")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("bundles").getOrCreate()
    if args.single:
        single_bundle(spark, args.data_dir, args.out)
    else:
        replicate_bundle(spark, args.data_dir, args.out, [int(n) for n in args.chips.split(",")])


if __name__ == "__main__":
    main()
