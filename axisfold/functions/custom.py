"""User-defined parts: functions that give one number for each epoch."""

from __future__ import annotations

import inspect
import math
import pickle
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .semantics import is_bad

REGISTRY: dict[str, Callable] = {}


def register(name: str, fn: Callable[..., DataFrame] | Aggregate) -> None:
    """Name a function (catalog, params) -> DataFrame(Epoch, value), one of an epoch's context -> number, or a mergeable aggregate."""
    if name.startswith("_"):
        raise ValueError("names that begin with _ are private")
    REGISTRY[name] = fn


def checked(scored: DataFrame) -> DataFrame:
    """(Epoch, value, reason): only one finite number for each epoch is good."""
    got = scored.groupBy("Epoch").agg(F.count("*").alias("_n"), F.first(F.col("value").cast("double")).alias("value"))
    bad = is_bad(F.col("value")) | F.col("value").isin(float("inf"), float("-inf"))
    reason = F.when(F.col("_n") > 1, "several values").when(bad, "the value is not a finite number")
    return got.select("Epoch", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


@dataclass(frozen=True)
class EpochContext:
    """What a function of one epoch gets: its directory, a ``Path`` if it is a local or mounted one, and the settings."""

    data_dir: Path | str
    generation: str | None = None
    group_defs: Mapping = field(default_factory=dict)
    params: Mapping = field(default_factory=dict)


def by_directory(catalog, fn: Callable[[EpochContext], float], params: Mapping, groups: Mapping | None = None) -> DataFrame:
    """(Epoch, value, reason) of a function that reads an epoch's directory itself; what it raises becomes the reason.

    Epochs are spread over the tasks, so executors must see the directories.
    """
    if catalog.directories is None:
        raise ValueError("a function of an epoch's context needs epochs that are read from directories")
    generation, groups = catalog.generation, dict(groups or {})

    def of_epoch(rows: pd.DataFrame, params: Mapping) -> float:
        path = rows["path"].iloc[0]
        return fn(EpochContext(Path(path) if path.startswith("/") else path, generation, groups, params))

    tasks = int(catalog.directories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return by_epoch(catalog.directories.repartition(tasks, "Epoch"), of_epoch, params)  # by number, so that tasks stay apart


def custom_part(name: str, catalog, params: Mapping, groups: Mapping | None = None) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"no registered function {name}")
    if isinstance(REGISTRY[name], Aggregate):
        return merged_by_epoch(REGISTRY[name].rows(catalog, params), REGISTRY[name], params)
    if len(inspect.signature(REGISTRY[name]).parameters) == 1:
        return by_directory(catalog, REGISTRY[name], params, groups)
    out = REGISTRY[name](catalog, params)
    if dict(out.dtypes).get("value") == "boolean":
        return out.groupBy("Epoch").agg(F.lit(None).cast("double").alias("value"), F.lit("the value is not a number").alias("reason"))
    return checked(out)


class Aggregate:
    """A user-defined aggregate of an epoch's rows, from states that merge.

    ``rows`` picks the rows (Epoch, ...), ``zero`` begins a state, ``update`` adds some
    rows of one epoch to it, ``merge`` puts two states together, ``finish`` makes the
    number.  States are small, whatever the number of rows; they travel pickled.
    """

    def rows(self, catalog, params: Mapping) -> DataFrame:
        raise NotImplementedError

    def zero(self, params: Mapping):
        raise NotImplementedError

    def update(self, state, rows: pd.DataFrame):
        raise NotImplementedError

    def merge(self, state, other):
        raise NotImplementedError

    def finish(self, state) -> float:
        raise NotImplementedError


#: So many states are held while rows are read, and so many tasks merge those of an epoch.
OPEN_STATES, MERGERS = 1_000, 32


def merged_by_epoch(df: DataFrame, aggregate: Aggregate, params: Mapping) -> DataFrame:
    """(Epoch, value, reason) by a mergeable aggregate; what it raises becomes the epoch's reason.

    Rows are added up where they lie, so only states are shuffled, and no task sees all
    rows of an epoch.  Its states are merged by ``MERGERS`` tasks, then by one.
    """
    kind = dict(df.dtypes)["Epoch"]
    state_of = f"Epoch {kind}, salt int, state binary, reason string"

    def tried(fn: Callable, *xs) -> tuple[object, str | None]:
        try:
            return fn(*xs), None
        except Exception as e:  # noqa: BLE001  any failure is this epoch's alone
            return None, f"{type(e).__name__}: {e}"

    def packed(held: Mapping, salt: int) -> pd.DataFrame:
        rows = [(k, salt, None if why else pickle.dumps(x), why) for k, (x, why) in held.items()]
        return pd.DataFrame(rows, columns=["Epoch", "salt", "state", "reason"])

    def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, salt = {}, TaskContext.get().partitionId() % MERGERS
        for part in parts:
            for key, rows in part.groupby("Epoch", dropna=False, sort=False):
                key = None if pd.isna(key) else key
                state, why = held[key] if key in held else tried(aggregate.zero, params)
                held[key] = (None, why) if why else tried(aggregate.update, state, rows)
            if len(held) > OPEN_STATES:
                yield packed(held, salt)
                held = {}
        yield packed(held, salt)

    def merged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, {}
        for part in parts:
            for key, salt, data, why in part.itertuples(index=False):
                key = None if pd.isna(key) else key
                if held and now != (key, salt):
                    yield packed(held, now[1])
                    held = {}
                new = (None, why) if isinstance(why, str) else (pickle.loads(data), None)
                old = held.get(key)
                held[key] = new if old is None or new[1] else old if old[1] else tried(aggregate.merge, old[0], new[0])
                now = key, salt
        if held:
            yield packed(held, now[1])

    def finished(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key, _, data, why in part.itertuples(index=False):
                got, why = (None, why) if isinstance(why, str) else tried(lambda data=data: aggregate.finish(pickle.loads(data)))
                if why is None and not (isinstance(got, int | float) and not isinstance(got, bool) and math.isfinite(got)):
                    got, why = None, f"not a finite number: {got!r}"
                out.append((None if pd.isna(key) else key, None if why else float(got), why))
            yield pd.DataFrame(out, columns=["Epoch", "value", "reason"])

    states = df.mapInPandas(add_up, state_of)
    for keys in (("Epoch", "salt"), ("Epoch",)):
        states = states.repartition(*keys).sortWithinPartitions(*keys).withColumn("salt", F.col("salt") if len(keys) > 1 else F.lit(0)).mapInPandas(merged, state_of)
    return states.mapInPandas(finished, f"Epoch {kind}, value double, reason string")


def by_epoch(df: DataFrame, fn: Callable[[pd.DataFrame, Mapping], float], params: Mapping) -> DataFrame:
    """A Python-only function of one epoch's rows; what it raises becomes the reason.

    All rows of an epoch meet in one task, so fold or count them first until an
    epoch is small, whatever the number of measurements.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        try:
            got = fn(rows, params)
            good = isinstance(got, int | float) and not isinstance(got, bool) and math.isfinite(got)
            reason = None if good else f"not a finite number: {got!r}"
        except Exception as e:  # noqa: BLE001  any failure is this epoch's alone
            got, good, reason = None, False, f"{type(e).__name__}: {e}"
        return pd.DataFrame({"Epoch": [key[0]], "value": [float(got) if good else None], "reason": [reason]})

    kind = dict(df.dtypes)["Epoch"]
    return df.groupBy("Epoch").applyInPandas(run, f"Epoch {kind}, value double, reason string")
