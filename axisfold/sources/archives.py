"""The tables of epoch archives (zip, tar, tgz) and loose files, as lines, in bounded pieces.

An index of members comes first: the central directory of a zip and the headers of a
plain tar are read without their contents, and each member is then a row of its own that
any task may read, by seeking to it.  A compressed tar has no such directory: it is run
through once for its names and once for its lines, both by one task, a piece at a time.
No archive, member or file is ever held whole, so their sizes don't matter.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .headers import opened

#: Lines go to Spark in pieces of about so many characters.
PIECE = 4_000_000
ARCHIVES = (".zip", ".tar", ".tgz", ".tar.gz")
#: A compressed tar is one row of the index; its members are told apart while it is read.
_ALL = "*"


def safe_names(names: Sequence[str]) -> dict[str, str]:
    """By member, its name without a directory that wraps all members; unsafe names and what is no table are left out."""
    plain = {n: n.removeprefix("./") for n in names}
    plain = {n: p for n, p in plain.items() if p and not p.startswith("/") and ".." not in p.split("/")}
    if len({p.split("/")[0] for p in plain.values()}) == 1 and all("/" in p for p in plain.values()):
        plain = {n: p.split("/", 1)[1] for n, p in plain.items()}
    return {n: p.removesuffix(".gz") for n, p in plain.items() if p.endswith((".csv", ".csv.gz"))}


def _index(path: str) -> Iterator[tuple[str, str, int, int]]:
    """(member, file, offset, size) of what a path holds; offset -1 where there is nothing to seek to."""
    if not path.endswith(ARCHIVES):
        name = path.rsplit("/", 1)[1]
        yield name, name.removesuffix(".gz"), -1, -1
    elif path.endswith((".tgz", ".tar.gz")):
        yield _ALL, "", -1, -1
    else:
        with opened(path) as f:
            if path.endswith(".zip"):
                found = {i.filename: (-1, i.file_size) for i in zipfile.ZipFile(f).infolist() if not i.is_dir()}
            else:
                with tarfile.open(fileobj=f, mode="r:") as t:
                    found = {m.name: (m.offset_data, m.size) for m in t if m.isfile()}
        for name, file in safe_names(list(found)).items():
            yield name, file, *found[name]


class _Part(io.RawIOBase):
    """The bytes of one member of a tar, read in one go."""

    def __init__(self, f, size: int, offset: int | None = None) -> None:
        self.f, self.left = f, size
        if offset is not None:
            f.seek(offset)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.f.read(min(len(buffer), self.left))
        buffer[: len(got)] = got
        self.left -= len(got)
        return len(got)


def _texts(f, name: str) -> Iterator[str]:
    raw = gzip.GzipFile(fileobj=f) if name.endswith(".gz") else f
    for line in io.TextIOWrapper(raw, encoding="utf-8", errors="replace"):
        yield line.rstrip("\n")


def _streams(path: str, member: str, file: str, offset: int, size: int) -> Iterator[tuple[str, Iterator[str]]]:
    """(file, lines) of one row of the index."""
    with opened(path) as f:
        if member == _ALL:
            with tarfile.open(fileobj=f, mode="r|gz") as t:
                names = safe_names([m.name for m in t if m.isfile()])
            f.seek(0)
            with tarfile.open(fileobj=f, mode="r|gz") as t:
                for m in t:
                    if m.isfile() and m.name in names:
                        yield names[m.name], _texts(io.BufferedReader(_Part(t.extractfile(m), m.size), 1 << 20), m.name)
        elif path.endswith(".zip"):
            with zipfile.ZipFile(f).open(member) as part:
                yield file, _texts(part, member)
        elif offset >= 0:
            yield file, _texts(io.BufferedReader(_Part(f, size, offset), 1 << 20), member)
        else:
            yield file, _texts(f, member)


def lines_of(spark: SparkSession, paths: str | Sequence[str], epoch: Callable[[Column], Column]) -> DataFrame:
    """(Epoch, file, pos, line) of the tables in archives and of loose tables."""
    path = F.col("path")
    listed = spark.read.format("binaryFile").load(paths).select(path, F.coalesce(epoch(path), path).alias("Epoch"))
    index_of = "Epoch string, path string, member string, file string, offset long, size long"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(e, p, *x) for p, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in _index(p)]
            kinds = [pa.string()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["Epoch", "path", "member", "file", "offset", "size"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(first: int) -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([row["Epoch"]] * n), pa.array([file] * n), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], names=["Epoch", "file", "pos", "line"])

        for b in batches:
            for row in b.to_pylist():
                for file, lines in _streams(*(row[k] for k in ("path", "member", "file", "offset", "size"))):
                    held, size, pos = [], 0, 0
                    for line in lines:
                        held.append(line)
                        size += len(line) + 1
                        if size > PIECE:
                            yield piece(pos)
                            held, size, pos = [], 0, pos + len(held)
                    if held:
                        yield piece(pos)

    # one row a task where there are as many tasks: members differ in size
    index = listed.repartition("path").mapInArrow(members, index_of).repartition("path", "member")
    return index.mapInArrow(read, "Epoch string, file string, pos long, line string")
