"""Epoch directories as a catalog, in one call."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import Catalog
from . import tables
from .headers import header_index
from .shared import staged

_NO = r"result\.(\d+)/"
_ARCHIVE = r"\.(?:zip|tar|tgz|tar\.gz)$"


def _labelled(label: str) -> Callable[[Column], Column]:
    """The Epoch of a path below a history that was given a label."""

    def epoch(path: Column) -> Column:
        no = F.regexp_extract(path, _NO, 1)
        return tables.epoch_id(F.lit(label), F.when(no != "", no.cast("long")))

    return epoch


def _union(parts: Sequence[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def _label(path: str) -> str:
    got = re.search(tables.EPOCH_PATH.split("/result_history")[0] + r"/result_history/?$", path)
    if not got:
        raise ValueError(f"{path} is no exp/StepN/LoopNN/result_history; give it a label")
    return got.group(1)


def _type_names(names: Iterable[str]) -> list[str]:
    """The names of tables that may be measurements."""
    return sorted(n for n in names if n and not n.startswith(("map_", "parameterLabel_", "dataName_")) and n not in tables.RESERVED)


def _read_packed(spark, folder, loose, epoch, types, own_temperatures, read, temps) -> None:
    """The tables of a folder with archives, by the lines of their members and of loose files beside them."""
    lines = tables.archive_lines(spark, folder + "/*.{zip,tar,tgz,tar.gz}", epoch)
    if loose:
        lines = tables.merged_lines(lines, tables.loose_lines(spark, f"{folder}/*.csv*", epoch))
    lines = staged(lines)
    names = {r["file"].removesuffix(".csv") for r in lines.select("file").distinct().collect() if r["file"].endswith(".csv")}
    for t in _type_names(names) if types is None else [t for t in types if t in names]:
        columns = tables.columns_of_lines(lines, f"{t}.csv")
        if t not in columns:
            continue
        read["measure"].setdefault(t, []).append(tables.measurement_of_lines(lines, t, [c for c in columns if c != t]))
        for kind, n in (("label", f"parameterLabel_{t}"), ("name", f"dataName_{t}")):
            if n in names:
                read[kind].setdefault(t, []).append(tables.side_of_lines(lines, f"{n}.csv"))
    for m in sorted(n for n in names if n.startswith("map_")):
        read["map"].setdefault(m.removeprefix("map_"), []).append(tables.map_of_lines(lines, f"{m}.csv"))
    if own_temperatures and "initial_temperature" in names:
        temps.append(tables.temperatures_of_lines(lines, "initial_temperature.csv"))


def open_catalog(
    spark: SparkSession,
    histories: Sequence[str] | Mapping[str, str] = (),
    data_dir: str | None = None,
    types: Sequence[str] | None = None,
    calibration: str | None = None,
    generation: str | None = None,
    counts: Mapping[str, int] | None = None,
    temperatures: str | None = None,
) -> Catalog:
    """The catalog of all epochs of some result_history directories, or of one epoch's directory.

    A history is named by its path exp/StepN/LoopNN, or by the label it is given.
    ``types`` are the measurement types to read, all that are there by default; types
    without a file are left out.  An epoch may be an archive, with or without loose files
    beside it.  Code maps and temperatures hold for their own epoch;
    ``temperatures`` is one file for all epochs.  Two jobs tell which tables there are
    and how their columns stand, whatever the number of types and histories: one over
    the names of files, one over their first bytes.
    """
    if data_dir is not None:
        name = data_dir.rstrip("/").rpartition("/")[2]
        found = [(data_dir.rstrip("/"), lambda path: F.lit(name))]
    else:
        if not isinstance(histories, Mapping):
            if len(set(map(_label, histories))) < len(histories):
                raise ValueError("history labels repeat")
            histories = {_label(h): h for h in histories}
        found = [(h.rstrip("/") + "/result.*", _labelled(label)) for label, h in histories.items()]
    if not found:
        raise ValueError("no history and no epoch directory")
    read: dict[str, dict[str, list[DataFrame]]] = {k: {} for k in ("measure", "label", "name", "map")}
    temps, epochs, places, listed, heads = [], [], [], None, None
    for i, (folder, epoch) in enumerate(found):
        files = spark.read.format("binaryFile").load(f"{folder}/*").select("path")
        own = epoch(F.col("path"))
        history, no = F.lit(None).cast("string"), F.lit(None).cast("long")
        if data_dir is None:
            history, no = F.regexp_replace(own, "#[0-9]+$", ""), F.regexp_extract("path", _NO, 1).cast("long")
        epochs.append(files.select(own.alias("Epoch"), history.alias("History"), no.alias("EpochNo")).distinct())
        place = F.regexp_extract("path", f"^(.*/{_NO.rstrip('/')})/", 1) if data_dir is None else F.lit(folder)
        places.append(files.select(own.alias("Epoch"), F.regexp_replace(place, "^file:/+", "/").alias("path")).distinct())
        kind = F.when(F.col("path").rlike(_ARCHIVE), "archive").when(F.col("path").rlike(r"\.csv(\.gz)?$|\.csv/"), "table")
        part = files.select(F.lit(i).alias("i"), kind.alias("kind"))
        listed = part if listed is None else listed.unionByName(part)
    kinds = {(r["i"], r["kind"]) for r in listed.distinct().collect()}
    for i, (folder, _) in enumerate(found):
        if (i, "archive") not in kinds and (i, "table") in kinds:
            part = header_index(spark, f"{folder}/*.csv*").select(F.lit(i).alias("i"), F.regexp_extract("path", tables.TABLE, 1).alias("name"), "cells")
            heads = part if heads is None else heads.unionByName(part)
    layouts: dict[int, dict[str, list[list[str]]]] = {}
    for r in heads.distinct().collect() if heads is not None else ():
        layouts.setdefault(r["i"], {}).setdefault(r["name"], []).append(r["cells"])
    for i, (folder, epoch) in enumerate(found):
        if (i, "archive") in kinds:
            _read_packed(spark, folder, (i, "table") in kinds, epoch, types, temperatures is None, read, temps)
            continue
        names = layouts.get(i, {})
        at = lambda n, folder=folder: f"{folder}/{n}.csv*"
        # a table without a column of its own name is no measurement
        for t in [n for n in _type_names(names) if any(n in c for c in names[n])] if types is None else [t for t in types if t in names]:
            read["measure"].setdefault(t, []).append(tables.read_measurement(spark, at(t), t, epoch, names[t]))
            for kind, n in (("label", f"parameterLabel_{t}"), ("name", f"dataName_{t}")):
                if n in names:
                    read[kind].setdefault(t, []).append(tables.read_side(spark, at(n), epoch, names[n]))
        for m in sorted(n for n in names if n.startswith("map_")):
            read["map"].setdefault(m.removeprefix("map_"), []).append(tables.read_maps(spark, at(m), epoch).drop("map_name"))
        if "initial_temperature" in names and temperatures is None:
            temps.append(tables.read_temperatures(spark, at("initial_temperature"), epoch))
    if temperatures is not None:
        temps = [tables.read_temperatures(spark, temperatures).drop("Epoch")]
    got = {k: {n: _union(parts) for n, parts in v.items()} for k, v in read.items()}
    coefficients = tables.read_calibration(spark, calibration) if calibration else None
    return Catalog(got["measure"], got["label"], got["name"], got["map"], _union(temps), coefficients, _union(epochs), generation, counts or {}, _union(places))
