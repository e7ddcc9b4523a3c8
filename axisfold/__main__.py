"""Scores from the command line: of one epoch as JSON, or of whole histories as a table.

python -m axisfold --config run.jsonc --data-dir result
python -m axisfold --config run.jsonc --history exp/Step1/Loop01/result_history --out scores
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .functions.custom import register
from .operators.quality import explained, failed_causes
from .plans.score import ScoreError, compute_scores
from .plans.spec import CALIBRATED_TYPE, file_from, json_with_comments
from .sources.history import open_catalog
from .sources.tables import replace_epochs, write_failed, write_scores

#: The axis counts that a generation file declares.
COUNT_KEYS = {"WL": "numWLs", "STR": "numStrings"}


def read_json(spark: SparkSession, path: str):
    """A small JSON file with comments, from any file system that Spark reads."""
    return json_with_comments(spark.read.text(path, wholetext=True).first()[0])


def generation_info(spark: SparkSession, data_dir: str | None, generation: str | None) -> dict:
    """What {generation}.json in the epoch's directory declares, if it is there."""
    if data_dir is None or not generation:
        return {}
    try:
        return read_json(spark, f"{data_dir.rstrip('/')}/{generation}.json")
    except AnalysisException:  # no such file
        return {}


def load_functions(path: str) -> None:
    """Register the public functions of a Python file: of (catalog, params), or of an epoch's context alone."""
    spec = importlib.util.spec_from_file_location("user_parts", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    for name, fn in vars(module).items():
        if callable(fn) and not name.startswith("_") and getattr(fn, "__module__", None) == module.__name__:
            register(name, fn)


def histories_of(given: list[str]) -> list[str] | dict[str, str]:
    """Paths, or label=path for each of them."""
    pairs = [g.split("=", 1) for g in given]
    labelled = [p for p in pairs if len(p) == 2]
    if labelled and len(labelled) < len(pairs):
        raise SystemExit("--history: give every history a label, or none")
    if len({p[0] for p in pairs}) < len(pairs):
        raise SystemExit("--history: a label repeats")
    return dict(labelled) if labelled else given


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m axisfold", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", required=True, help="run configuration, JSON with comments")
    where = parser.add_mutually_exclusive_group(required=True)
    where.add_argument("--data-dir", help="the directory of one epoch")
    where.add_argument("--history", action="append", help="a result_history directory, or label=path; may be repeated")
    parser.add_argument("--out", help="folder for the scores of histories; failed epochs go to {out}.failed, dummies to {out}.dummy")
    parser.add_argument("--format", default="csv", choices=["csv", "parquet", "json"])
    parser.add_argument("--by-epoch", action="store_true", help="write Parquet by epoch; a run again replaces its own epochs")
    parser.add_argument("--dvtbudget-coef", help="calibration coefficients, JSON")
    parser.add_argument("--initial-temperature", help="board temperatures for all epochs")
    parser.add_argument("--custom-parts", help="Python file of functions (catalog, params) -> DataFrame(Epoch, value), or (context of an epoch) -> number")
    parser.add_argument("--generation-info", help="JSON with the numbers of axis values")
    parser.add_argument("--explain", action="store_true", help="write the first step that went wrong to {out}.causes")
    parser.add_argument("--strict", action="store_true", help="stop if an epoch fails")
    args = parser.parse_args(argv)
    if args.history and not args.out:
        parser.error("--history needs --out")
    spark = spark or SparkSession.builder.appName("axisfold").getOrCreate()
    config = read_json(spark, args.config)
    file = file_from(config)
    if any(p.type == CALIBRATED_TYPE for p in file.parts) and not args.dvtbudget_coef:
        parser.error(f"parts of type {CALIBRATED_TYPE} need --dvtbudget-coef")
    if args.custom_parts:
        load_functions(args.custom_parts)
    info = read_json(spark, args.generation_info) if args.generation_info else generation_info(spark, args.data_dir, config.get("Generation"))
    counts = {a: int(info[k]) for a, k in COUNT_KEYS.items() if k in info}
    for key in sorted(set(file.thresholds) - {p.name for p in file.parts}):
        print(f"warning: the threshold {key} matches no part", file=sys.stderr)
    types = None if any(p.function for p in file.parts) else sorted({p.source_type for p in file.parts})
    catalog = open_catalog(
        spark,
        histories_of(args.history or []),
        args.data_dir,
        types,
        args.dvtbudget_coef,
        config.get("Generation"),
        counts,
        args.initial_temperature,
    )
    try:
        got = compute_scores(catalog, file, persist=True, stage=True)
        any_failed = not got.failed.isEmpty()
        if any_failed and (args.strict or args.data_dir is not None):
            first = explained(catalog, file, got.failed.orderBy("Epoch").limit(1)).first()
            raise ScoreError(f"{first['Epoch']}: {first['reason']}")
        if args.data_dir is not None:
            row = got.scores.drop("Epoch", "History", "EpochNo").first()
            print(json.dumps(row.asDict()))
            for r in got.dummy_used.orderBy("part").collect():  # of one epoch
                print(f"note: {r['part']} has a dummy value, no table was there", file=sys.stderr)
        else:
            if args.by_epoch:
                replace_epochs(got.scores, args.out)
            else:
                write_scores(got.scores, args.out, args.format)
            if not got.dummy_used.isEmpty():
                write_failed(got.dummy_used, f"{args.out}.dummy")
            if any_failed:
                write_failed(explained(catalog, file, got.failed), f"{args.out}.failed")
                if args.explain:
                    write_failed(failed_causes(catalog, file, got.failed), f"{args.out}.causes")
        got.release()
    except ScoreError as e:
        raise SystemExit(f"error: {e}") from e


if __name__ == "__main__":
    main()
