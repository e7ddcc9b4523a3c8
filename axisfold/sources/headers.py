"""The headers of CSV files as a data source that reads the first bytes of each file only.

``spark.read.format("csv_headers")`` gives (path, cells) of the files that its option
``files`` names; its partitions are planned by file.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: So many files are a partition.
FILES = 64
#: Headers are read in pieces of so many bytes, and are no longer than ``LONGEST``.
PIECE, LONGEST = 1 << 14, 1 << 22


def opened(path: str):
    """A file of any file system that pyarrow knows, as a seekable stream of bytes."""
    from pyarrow.fs import FileSystem

    system, inside = FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(inside)


def first_cells(pieces: Iterator[bytes]) -> list[str]:
    """The cells of the first line that isn't blank; quoted ones may hold commas."""
    text = b""
    for piece in pieces:
        text += piece
        body = text.lstrip(b"\xef\xbb\xbf\r\n \t")
        if b"\n" in body and body[: body.rindex(b"\n")].count(b'"') % 2 == 0 or len(text) > LONGEST:
            break
    rows = csv.reader(io.StringIO(text.decode("utf-8-sig", "replace"), newline=""))
    return next(([c.strip() for c in row] for row in rows if any(c.strip() for c in row)), [])


def _pieces(path: str) -> Iterator[bytes]:
    with opened(path) as f:
        unpack = zlib.decompressobj(31).decompress if path.endswith(".gz") else bytes
        while piece := f.read(PIECE):
            yield unpack(piece)


class _Files(InputPartition):
    def __init__(self, files: Sequence[str]) -> None:
        super().__init__(None)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, files: Sequence[str]) -> None:
        self.files = files

    def partitions(self) -> list[_Files]:
        return [_Files(self.files[i : i + FILES]) for i in range(0, len(self.files), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.files:
            yield re.sub("^file:/+", "file:/", path), first_cells(_pieces(path))


class HeaderSource(DataSource):
    """(path, cells) of the files in the option ``files``, a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "csv_headers"

    def schema(self) -> str:
        return "path string, cells array<string>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["files"]))


def header_index(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, cells): the header of each file; of the rest of a file nothing is read.

    The files are those that Spark lists for the paths, by the names that it gives in
    ``_metadata.file_path``.
    """
    spark.dataSource.register(HeaderSource)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).inputFiles()
    return spark.read.format("csv_headers").option("files", json.dumps(files)).load()
