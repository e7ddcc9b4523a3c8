"""Periodic runs of words, found by online dyadic square catching, and their collapse.

Words are appended in order.  For each power of two M every block of M words that is
complete starts a catcher: its pattern is the block and the next one, and it waits for
the pattern to come again at a distance q of M + 1 to 2 M.  When a word is appended,
the suffix of 2 M words is held against exactly one catcher of each M, the one whose
distance is due, by fingerprints of prefixes.  An equal suffix is a square of period
q; squares of one period that lie M apart are one run, which is extended word by word
as far as it goes, and further whenever words are appended.  A stretch that lies in a
run of a smaller level has a smaller period, since it is at least twice as long as its
own, and is left out; so every run is kept by its smallest period.

Every run of at least four periods is caught: it holds a catcher's pattern and the
pattern again.  Fingerprints only propose: every square is compared word by word.

The words of a text are appended in bounded pieces; memory is some 24 bytes a word of
the longest text.  There is no shuffle: a text is one row, and rows are independent.

Defined cases: words are what stands between white space (space, U+0009 to U+000D);
null, empty and blank texts have no words and no runs and collapse to the empty text;
repeated rows are treated alike; other columns stay, and columns named like an output
column are replaced; a null doc_id is a row like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, trimmed, words

#: A run is reported from so many words, and so many periods, on.
MIN_WORDS, MIN_PERIODS = 6, 4
#: So many words are appended at a time.
PIECE = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, modulo 2**64, and perhaps more."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


class SquareCatcher:
    """The runs of a growing sequence of word numbers."""

    def __init__(self) -> None:
        self.n = 0
        self.words = np.zeros(0, dtype=np.int64)
        self.prefix = np.zeros(1, dtype=np.uint64)
        self.due: list[int] = []  # by level, the first suffix that is not compared yet
        self.found: list[list[tuple[int, int, int]]] = []  # by level, the closed runs
        self.last: dict[int, tuple[int, int, int]] = {}  # by period, the last run (start, end, level)

    def append(self, ids: np.ndarray) -> None:
        """Append words and catch the squares that end in them."""
        before, self.n = self.n, self.n + len(ids)
        if len(self.words) < self.n:
            room = self.n if not before else max(self.n, 2 * before)
            self.words = np.concatenate((self.words[:before], np.zeros(room - before, dtype=np.int64)))
            self.prefix = np.concatenate((self.prefix[: before + 1], np.zeros(room - before, dtype=np.uint64)))
        self.words[before : self.n] = ids
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        np.cumsum(mixed * powers(self.n)[before : self.n], out=self.prefix[before + 1 : self.n + 1])
        self.prefix[before + 1 : self.n + 1] += self.prefix[before]
        for period, (start, end, level) in list(self.last.items()):
            if end == before:
                self.last[period] = (start, end + self._ahead(end - period, end), level)
        at = np.nonzero(self.words[max(before, 1) : self.n] == self.words[max(before, 1) - 1 : self.n - 1])[0] + max(before, 1) - 1 if self.n > 1 else ids[:0]
        self._merge(0, 1, at, np.ones(len(at), dtype=np.int64), at + 2)
        level, m = 1, 1
        while MIN_PERIODS * (m + 1) <= self.n:
            if len(self.due) < level:
                self.due.append(m + 1)
            i = np.arange(self.due[level - 1], self.n - 2 * m + 1)
            self.due[level - 1] = max(self.due[level - 1], self.n - 2 * m + 1)
            if len(i):
                q = ((i - 1) & (m - 1)) + (m + 1)
                c, p = i - q, self.prefix
                hit = np.nonzero(p[i[0] + 2 * m : i[-1] + 2 * m + 1] - p[i[0] : i[-1] + 1] == (p[c + 2 * m] - p[c]) * powers(2 * m + 1)[q])[0]
                if len(hit):
                    self._merge(level, m, c[hit], q[hit], i[hit] + 2 * m)
            level, m = level + 1, 2 * m

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs that are long enough, by start and period."""
        everything = [r for at in self.found for r in at] + [(s, e, q) for q, (s, e, _) in self.last.items()]
        return sorted((s, e - s, q) for s, e, q in everything if e - s >= max(MIN_WORDS, MIN_PERIODS * q))

    def _ahead(self, a: int, b: int) -> int:
        """How many words from ``a`` on equal those from ``b`` on, b later."""
        got, step, w = 0, 8, self.words
        while b + got < self.n:
            k = min(step, self.n - b - got)
            differ = w[a + got : a + got + k] != w[b + got : b + got + k]
            if differ.any():
                return got + int(differ.argmax())
            got, step = got + k, 2 * step
        return got

    def _back(self, a: int, b: int) -> int:
        """How many words before ``a`` equal those before ``b``, b later."""
        got, step, w = 0, 8, self.words
        while a > got:
            k = min(step, a - got)
            differ = (w[a - got - k : a - got] != w[b - got - k : b - got])[::-1]
            if differ.any():
                return got + int(differ.argmax())
            got, step = got + k, 2 * step
        return got

    def _merge(self, level: int, m: int, c: np.ndarray, q: np.ndarray, stop: np.ndarray) -> None:
        """New squares [c, stop) of period q, caught at a level of block size m, become runs."""
        while len(self.found) <= level:
            self.found.append([])
        if not len(c):
            return
        lower = [(s, e) for at in self.found[:level] for s, e, _ in at] + [(s, e) for s, e, at in self.last.values() if at < level]
        if lower:
            known = np.array(sorted(lower), dtype=np.int64)
            k = np.searchsorted(known[:, 0], c, side="right")
            reach = np.concatenate(([0], np.maximum.accumulate(known[:, 1])))
            new = reach[k] < stop
            c, q, stop = c[new], q[new], stop[new]
            if not len(c):
                return
        order = np.lexsort((c, q))
        c, q, stop = c[order], q[order], stop[order]
        begins = np.nonzero(np.concatenate(([True], (np.diff(q) != 0) | (np.diff(c) != m))))[0]
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(c)], strict=True):
            if not self._caught(level, int(q[a]), int(c[a]), int(stop[b - 1])):
                for i in range(a, b):  # a fingerprint was wrong somewhere
                    self._caught(level, int(q[i]), int(c[i]), int(stop[i]))

    def _caught(self, level: int, q: int, c: int, stop: int) -> bool:
        """Whether [c, stop) has period q; the run that it is part of is kept."""
        last = self.last.get(q)
        if last and last[0] <= c and stop <= last[1]:
            return True
        if not np.array_equal(self.words[c : stop - q], self.words[c + q : stop]):
            return False
        start, end = c - self._back(c, c + q), stop + self._ahead(stop - q, stop)
        if last and last[0] != start:
            self.found[level].append((last[0], last[1], q))
        self.last[q] = (start, end, level)
        return True


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of word numbers."""
    catcher = SquareCatcher()
    for at in range(0, len(ids), PIECE):
        catcher.append(ids[at : at + PIECE])
    return catcher.runs()


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, of which each run keeps its first period."""
    if runs:
        gone = np.zeros(len(found) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        found = [found[i] for i in np.nonzero(np.cumsum(gone[:-1]) == 0)[0].tolist()]
    return b" ".join(found)


def with_runs(docs: DataFrame) -> DataFrame:
    """The rows with ``runs``, an array of (start, length, period) by start and period, and ``collapsed``, the text without repeats."""
    docs = docs.drop("runs", "collapsed")
    text = free_name(docs, "_utf8")
    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    added = [F.lit(None).cast(t).alias(n) for n, t in (("text", "string"), ("runs", "array<struct<start:long,length:long,period:long>>"), ("collapsed", "string"))]
    schema = docs.select(*rest, *added).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            number = defaultdict(count().__next__)
            spans, short = [], []
            for t in b.column(at):
                found = (t.as_py() or b"").split()
                runs = find_runs(np.fromiter(map(number.__getitem__, found), dtype=np.int64, count=len(found)))
                spans.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                short.append(collapsed(found, runs))
            kept = [b.column(i) for i in range(b.num_columns) if i != at]
            # the bytes are a text's own, or whole words of it
            own = b.column(at).cast(pa.binary()).view(pa.string())
            yield pa.RecordBatch.from_arrays([*kept, own, pa.array(spans, kind), pa.array(short, pa.binary()).view(pa.string())], names=schema.names)

    return docs.select(*rest, F.col("text").cast("string").cast("binary").alias(text)).mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in [*docs.columns, "runs", "collapsed"]])


def looped(doc_id: Column, text: Column) -> Column:
    """Every tenth document by the hash of its id, made periodic from a word on; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, own = F.floor(h / 10), words(text)
    n = F.size(own).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    whole = F.flatten(F.array_repeat(F.slice(own, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(own, F.lit(1), a), F.slice(whole, F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & (trimmed(text) != ""), made).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = with_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return got.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
