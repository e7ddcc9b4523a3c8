"""Sources and sinks: epoch directories of CSV tables, or Parquet made of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import VALUE
from ..operators.lookup import temperature_conflicts as temperature_conflicts
from ..operators.resolve import SIDE_KEYS
from .archives import lines_of
from .headers import header_index

#: exp/StepN/LoopNN/result_history/result.NNNN/file
EPOCH_PATH = r"([^/]+/Step[^/]+/Loop[^/]+)/result_history/result\.(\d+)/"
RESERVED = ("initial_temperature",)
TABLE_FILE = r"/([^/]+?)\.csv(?:\.gz)?$"


def label_of(path: Column) -> Column:
    """The history label exp/StepN/LoopNN of a path; null elsewhere."""
    got = F.regexp_extract(path, EPOCH_PATH, 1)
    return F.when(got != "", got)


def epoch_no_of(path: Column) -> Column:
    got = F.regexp_extract(path, EPOCH_PATH, 2)
    return F.when(got != "", got.cast("long"))


def epoch_id(label: Column, no: Column) -> Column:
    """label#0001."""
    return F.when(label.isNotNull() & no.isNotNull(), F.format_string("%s#%04d", label, no))


def epoch_of(path: Column) -> Column:
    return epoch_id(label_of(path), epoch_no_of(path))


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, Epoch, History, EpochNo, name) of all files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")
    p = F.col("path")
    return files.select("path", epoch_of(p).alias("Epoch"), label_of(p).alias("History"), epoch_no_of(p).alias("EpochNo"), F.regexp_extract(p, TABLE_FILE, 1).alias("name"))


def enumerate_epochs(files: DataFrame) -> DataFrame:
    """Epoch, History, EpochNo of a file listing, each once."""
    return files.where(F.col("Epoch").isNotNull()).select("Epoch", "History", "EpochNo").distinct()


def check_histories(epochs: DataFrame, wanted: Sequence[str]) -> None:
    """Every wanted history label once, and with an epoch."""
    if len(set(wanted)) < len(wanted):
        raise ValueError("history labels repeat")
    found = {r[0] for r in epochs.select("History").distinct().collect()}
    if empty := sorted(set(wanted) - found):
        raise ValueError(f"no epochs in {', '.join(empty)}")


def other_entries(files: DataFrame) -> DataFrame:
    """Paths that belong to no epoch."""
    return files.where(F.col("Epoch").isNull()).select("path")


def missing_files(epochs: DataFrame, files: DataFrame, required: Sequence[str], temperatures: bool = False) -> DataFrame:
    """(Epoch, reason) of epochs that lack a required table."""
    names = [*required, *(RESERVED if temperatures else ())]
    need = epochs.select("Epoch", F.explode(F.array(*map(F.lit, names))).alias("name"))
    lost = need.join(files.select("Epoch", "name"), ["Epoch", "name"], "left_anti")
    return lost.groupBy("Epoch").agg(F.concat(F.lit("missing: "), F.array_join(F.sort_array(F.collect_set("name")), ", ")).alias("reason"))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, "\r$", ""), ","), lambda x: F.btrim(x))


def headers(spark: SparkSession, paths: str | Sequence[str], column: str) -> DataFrame:
    """(path, cells) of the files whose header names ``column``."""
    return header_index(spark, paths).where(F.array_contains("cells", column))


def read_measurement(spark: SparkSession, paths: str | Sequence[str], type_: str, epoch: Callable[[Column], Column] = epoch_of, layouts: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(Epoch, axes..., value) of {type}.csv files, plain or gzipped.

    Every axis is a LONG, the value a DOUBLE.  Columns are found by name, and a file
    that lacks an axis of others has null there.  ``epoch`` makes the Epoch of a path;
    ``layouts`` are the files' headers, where they are known.
    """
    return _by_layout(spark, paths, type_, {type_: VALUE}, {type_: "double"}, epoch, layouts)


def _by_layout(spark: SparkSession, paths, column: str, rename: dict[str, str], kinds: dict[str, str], epoch: Callable[[Column], Column], layouts=None) -> DataFrame:
    """Files of one header are read as typed CSV; of several, all are read once by position, and each row by its own file's header.

    Only the first bytes of each file are read to learn its header.  What a header tells,
    and the epoch of a path, are worked out by file and not by row.
    """
    heads = header_index(spark, paths)
    if layouts is None:
        layouts = [r["cells"] for r in heads.select("cells").distinct().collect()]
    own = sorted(list(x) for x in layouts if column in x)
    if not own:
        raise ValueError(f"no table with a column {column}")
    named = list(dict.fromkeys(c for cells in own for c in cells))
    path = F.col("_metadata.file_path")
    if len(layouts) == 1:
        schema = ", ".join(f"`{c}` {kinds.get(c, 'long')}" for c in named)
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths)
        df = df.select(path.alias("_path"), *[F.col(f"`{c}`").alias(rename.get(c, c)) for c in named])
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(path.alias("_path")).distinct()
        files = files.select("_path", epoch(F.col("_path")).alias("Epoch"))
        return df.join(F.broadcast(files), "_path").select("Epoch", *[f"`{c}`" for c in df.columns[1:]])  # one row a file
    places = [F.nullif(F.array_position("cells", c), F.lit(0)).cast("int").alias(f"_at{i}") for i, c in enumerate(named)]
    files = heads.where(F.array_contains("cells", column)).select("path", epoch(F.col("path")).alias("Epoch"), F.col("cells").alias("head"), *places)
    cells = [f"_{i}" for i in range(max(map(len, own)))]
    lines = spark.read.schema(", ".join(f"{c} string" for c in cells)).csv(paths).select(path.alias("path"), *[F.btrim(c).alias(c) for c in cells])
    text = [F.coalesce(c, F.lit("")) for c in cells]
    differs = [F.coalesce(t != F.get("head", F.lit(i)), F.lit(False)) for i, t in enumerate(text)]
    rows = lines.where(reduce(or_, [t != "" for t in text])).join(F.broadcast(files), "path").where(reduce(or_, differs))  # one row a file
    values = [F.elt(f"_at{i}", *cells).try_cast(kinds.get(c, "long")).alias(rename.get(c, c)) for i, c in enumerate(named)]
    return rows.select("Epoch", *values)


def read_side(spark: SparkSession, paths: str | Sequence[str], epoch: Callable[[Column], Column] = epoch_of, layouts: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(Epoch, side keys, codes...) of label or name tables; rows without keys are left out."""
    df = _by_layout(spark, paths, SIDE_KEYS[0], {}, {}, epoch, layouts)
    return df.where(F.coalesce(*[F.col(k) for k in SIDE_KEYS if k in df.columns]).isNotNull())


def read_map(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(code, text) of header-less map files."""
    return spark.read.schema("code long, text string").csv(paths)


def read_maps(spark: SparkSession, paths: str | Sequence[str], epoch: Callable[[Column], Column] | None = None) -> DataFrame:
    """(map_name, code, text) of many map_*.csv files, each code once; with ``epoch`` by Epoch too."""
    df = spark.read.schema("code long, text string").csv(paths)
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(path, r"/map_([^/]+?)\.csv(?:\.gz)?$", 1)
    return df.select(*([epoch(path).alias("Epoch")] if epoch else []), name.alias("map_name"), "code", "text").distinct()


def read_temperatures(spark: SparkSession, paths: str | Sequence[str], epoch: Callable[[Column], Column] = epoch_of) -> DataFrame:
    """(Epoch, Board, temp) of temperature files with a header (any column order) or without."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), _cells(F.col("value")).alias("cells"))
    return _temperatures(lines).select(epoch(F.col("path")).alias("Epoch"), "Board", "temp").distinct()


def _temperatures(lines: DataFrame) -> DataFrame:
    """(path, Board, temp) of (path, cells)."""
    lines = lines.where(F.size(F.filter("cells", lambda c: c != "")) > 0)
    head = lines.where(F.array_contains("cells", "Board")).select("path", F.col("cells").alias("head"))
    rows = lines.where(~F.array_contains("cells", "Board")).join(head, "path", "left")
    at = lambda name: F.array_position("head", name)
    temp_at = F.when(at("Temp") > 0, at("Temp")).otherwise(at("Temperature"))
    cell = lambda i: F.get("cells", (i - 1).cast("int"))
    board = F.when(F.col("head").isNull(), F.get("cells", F.lit(0))).otherwise(cell(at("Board")))
    temp = F.when(F.col("head").isNull(), F.get("cells", F.lit(1))).otherwise(cell(temp_at))
    return rows.select("path", board.try_cast("double").cast("long").alias("Board"), temp.try_cast("double").alias("temp"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """generation -> temperature key -> state -> {a, b} JSON as rows in file order."""
    from ..operators.lookup import explode_calibration

    kind = "map<string,map<string,map<string,struct<a:double,b:double>>>>"
    text = spark.read.text(path, wholetext=True)
    # comments are left to the reader of JSON
    return explode_calibration(text.select(F.from_json("value", kind, {"allowComments": "true"}).alias("coef")))


#: The name of a table, which is a file or a folder that Spark wrote.
TABLE = r"/([^/]+?)\.csv(?:\.gz)?(?:/[^/]*)?$"


def detect_types(heads: DataFrame) -> DataFrame:
    """(type): suffixes of side tables, and tables that have a column of their own name.

    ``heads``: (path, cells), the header of each file.
    """
    named = heads.select(F.regexp_extract("path", TABLE, 1).alias("name"), "cells")
    side = F.regexp_extract("name", r"^(?:parameterLabel|dataName)_(.+)$", 1)
    own = F.array_contains("cells", F.col("name")) & ~F.col("name").startswith("map_") & ~F.col("name").isin(*RESERVED)
    return named.select(F.when(side != "", side).when(own, F.col("name")).alias("type")).where("type IS NOT NULL").distinct()


def archive_lines(spark: SparkSession, paths: str | Sequence[str], epoch: Callable[[Column], Column] = epoch_of) -> DataFrame:
    """(Epoch, file, pos, line) of the tables in tar and zip epoch archives.

    Members with unsafe names are left out; a single wrapping directory goes.
    """
    return lines_of(spark, paths, epoch)


def measurement_of_lines(lines: DataFrame, type_: str, axes: Sequence[str]) -> DataFrame:
    """(Epoch, axes..., value) of the {type}.csv members of archives, by header name."""
    own = lines.where(F.col("file").isin(f"{type_}.csv")).select("Epoch", "pos", _cells(F.col("line")).alias("cells"))
    head = own.where("pos = 0").select("Epoch", F.col("cells").alias("head"))
    rows = own.where("pos > 0").join(head, "Epoch")
    cell = lambda c: F.get("cells", (F.nullif(F.array_position("head", c), F.lit(0)) - 1).cast("int"))
    rows = rows.where(F.exists("cells", lambda c: c != ""))
    return rows.select("Epoch", *[cell(a).try_cast("long").alias(a) for a in axes], cell(type_).try_cast("double").alias(VALUE))


def columns_of_lines(lines: DataFrame, file: str) -> list[str]:
    """The columns that the headers of a member name, over all epochs."""
    heads = lines.where((F.col("file") == file) & (F.col("pos") == 0)).select(_cells(F.col("line")).alias("cells")).distinct().collect()
    return list(dict.fromkeys(c for r in sorted(heads, key=lambda r: r["cells"]) for c in r["cells"]))


def side_of_lines(lines: DataFrame, file: str) -> DataFrame:
    """(Epoch, side keys, codes...) of a label or name table among the members; rows without keys are left out."""
    named = columns_of_lines(lines, file)
    own = lines.where(F.col("file") == file).select("Epoch", "pos", _cells(F.col("line")).alias("cells"))
    rows = own.where("pos > 0").join(own.where("pos = 0").select("Epoch", F.col("cells").alias("head")), "Epoch")
    cell = lambda c: F.get("cells", (F.nullif(F.array_position("head", c), F.lit(0)) - 1).cast("int")).try_cast("long")
    rows = rows.select("Epoch", *[cell(c).alias(c) for c in named])
    return rows.where(F.coalesce(*[F.col(k) for k in SIDE_KEYS if k in named]).isNotNull())


def map_of_lines(lines: DataFrame, file: str) -> DataFrame:
    """(Epoch, code, text) of a header-less map among the members."""
    own = lines.where((F.col("file") == file) & (F.btrim("line") != "")).select("Epoch", F.split(F.regexp_replace("line", "\r$", ""), ",", 2).alias("cells"))
    return own.select("Epoch", F.get("cells", F.lit(0)).try_cast("long").alias("code"), F.get("cells", F.lit(1)).alias("text")).distinct()


def temperatures_of_lines(lines: DataFrame, file: str) -> DataFrame:
    """(Epoch, Board, temp) of a temperature table among the members."""
    own = lines.where(F.col("file") == file).select(F.col("Epoch").alias("path"), _cells(F.col("line")).alias("cells"))
    return _temperatures(own).withColumnRenamed("path", "Epoch").distinct()


def loose_lines(spark: SparkSession, paths: str | Sequence[str], epoch: Callable[[Column], Column] = epoch_of) -> DataFrame:
    """(Epoch, file, pos, line) of files that lie unpacked in an epoch's directory."""
    return lines_of(spark, paths, epoch)


def merged_lines(archived: DataFrame, loose: DataFrame) -> DataFrame:
    """The archives' members, and loose files of names that the epoch's archive lacks."""
    return archived.unionByName(loose.join(archived.select("Epoch", "file").distinct(), ["Epoch", "file"], "left_anti"))


def write_scores(scores: DataFrame, path: str, format_: str = "csv", mode: str = "errorifexists") -> None:
    """Scores in epoch order, as CSV with a header, Parquet or JSON lines."""
    ordered = scores.orderBy("History", "EpochNo", "Epoch")
    ordered.write.mode(mode).format(format_).option("header", True).save(path)


def replace_epochs(results: DataFrame, path: str) -> None:
    """Results by epoch, as Parquet; a run again replaces the epochs that it has, and no others.

    An epoch is replaced as a whole, so what is read back has each epoch once.
    """
    results.write.partitionBy("Epoch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_failed(failed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    failed.orderBy("Epoch").write.mode(mode).option("header", True).csv(path)


def json_results(scores: DataFrame) -> DataFrame:
    """One flat JSON object for each epoch."""
    return scores.select(F.to_json(F.struct(*scores.columns)).alias("json"))


def write_bundle(tables: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The tables of a rewritten bundle, each as CSV in a folder of its name."""
    for name, df in tables.items():
        out = df.withColumnRenamed(VALUE, name) if VALUE in df.columns else df
        out.drop("Epoch").write.mode(mode).option("header", True).csv(f"{path}/{name}.csv")
