"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may be found with up to ``rate * m`` word edits (the error
budget).  It is cut into one piece more than the budget, so a match must hold at
least one piece unchanged.  An Aho-Corasick automaton finds all pieces in one pass
over a document; around each hit Myers' bit-parallel distance, one bit for each
word of the item, tells whether the whole item is there.

Words are runs of letters, digits and underscores, lower-cased, so marks and line
breaks don't matter; each letter of a script without spaces is a word.

An item of fewer than ``min_words`` words is common speech inside a text, but not as a
line of its own.  It is found where a whole line equals it but for ``rate`` of its
characters, by the same method over characters in the words' place.

Defined cases: null and empty texts match nothing; items without words (null and empty
ones too) can't be found; equal items are all reported; repeated rows are reported each;
an empty table on either side gives no matches; an item's best match in a document is
the one of least distance (words, or characters for a short item), and of these the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html import UNSPACED

RATE = 0.15
MIN_WORDS = 5
#: Items are collected and sent out in blocks of about so many characters.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_WORD_OR_LETTER = re.compile(f"{UNSPACED}|(?:(?!{UNSPACED})\\w)+")
_HAS_UNSPACED = re.compile(UNSPACED)


def item_words(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_WORD if text.isascii() or not _HAS_UNSPACED.search(text) else _WORD_OR_LETTER).findall(text)


def cuts(size: int, budget: int) -> list[int]:
    """Where a pattern is cut into one piece more than the budget, both ends included."""
    return [size * j // (budget + 1) for j in range(budget + 2)]


def places(pattern) -> dict[str, int]:
    """For each word (or character) of a pattern, the bits of its places."""
    out: dict[str, int] = {}
    for i, x in enumerate(pattern):
        out[x] = out.get(x, 0) | 1 << i
    return out


def automaton_of(pieces: dict[str, list]) -> ahocorasick.Automaton | None:
    if not pieces:
        return None
    out = ahocorasick.Automaton()
    for piece, where in pieces.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


class Matcher:
    """The pieces of some items, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_words: int):
        self.items, self.short, self.longest = [], [], 0
        pieces: dict[str, list[tuple[int, int]]] = {}
        short_pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = item_words(text)
            if not w:
                continue
            if len(w) < min_words:
                line = " ".join(w)
                budget = int(rate * len(line))
                at = cuts(len(line), budget)
                for a, b in zip(at, at[1:], strict=False):
                    short_pieces.setdefault(line[a:b], []).append((len(self.short), a))
                self.short.append((item_id, len(line), budget, places(line)))
                self.longest = max(self.longest, len(line) + budget)
                continue
            budget = int(rate * len(w))
            at = cuts(len(w), budget)
            for a, b in zip(at, at[1:], strict=False):
                pieces.setdefault(f" {' '.join(w[a:b])} ", []).append((len(self.items), a))
            self.items.append((item_id, len(w), budget, places(w), places(reversed(w))))
        self.automaton, self.short_automaton = automaton_of(pieces), automaton_of(short_pieces)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, first word, words) for each item in the text."""
        if not text:
            return []
        return (self._inside(item_words(text)) if self.automaton else []) + (self._lines(text) if self.short_automaton else [])

    def _lines(self, text: str) -> list[tuple[int, int, int, int]]:
        """The short items that are lines of the text."""
        best: dict[int, tuple[int, int, int]] = {}
        first = 0
        for line in text.split("\n"):
            w = item_words(line)
            joined = " ".join(w)
            near: set[int] = set()
            if joined and len(joined) <= self.longest:
                for end, (size, where) in self.short_automaton.iter(joined):
                    near.update(i for i, offset in where if abs(end - size + 1 - offset) <= self.short[i][2])
            for i in near:
                _, m, budget, masks = self.short[i]
                if abs(len(joined) - m) <= budget and (d := edit_distance(masks, m, joined)) <= budget and (i not in best or d < best[i][0]):
                    best[i] = d, first, len(w)
            first += len(w)
        return [(self.short[i][0], *found) for i, found in best.items()]

    def _inside(self, w: list[str]) -> list[tuple[int, int, int, int]]:
        line = f" {' '.join(w)} "
        windows: dict[int, set[int]] = {}
        starts = None
        for end, (size, where) in self.automaton.iter(line):
            if starts is None:
                starts = np.cumsum([0, *[len(x) + 1 for x in w]])
            word = int(np.searchsorted(starts, end - size + 1))
            for item, offset in where:
                windows.setdefault(item, set()).add(word - offset)
        found = []
        for item, begins in windows.items():
            item_id, m, budget, masks, back = self.items[item]
            best = None
            for lo, hi in _merged(begins, m, budget, len(w)):
                d, stop = edit_match(masks, m, w[lo:hi])
                if d <= budget and (best is None or d < best[0]):
                    _, size = edit_match(back, m, w[max(lo, lo + stop - m - budget) : lo + stop][::-1], d)
                    best = (d, lo + stop - size, size)
            if best:
                found.append((item_id, *best))
        return found


def _merged(begins: set[int], m: int, budget: int, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b in sorted(begins):
        lo, hi = max(0, b - budget), min(n, b + m + budget)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def edit_match(masks: dict[str, int], m: int, words: list[str], stop_at: int = -1) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of ``words``, and where that stretch ends.

    Myers' recurrence with the stretch free to begin anywhere. With ``stop_at``
    the stretch must begin at the first word, and the first end with at most that
    distance counts.
    """
    best, at = m, 0
    for j, score in enumerate(_scores(masks, m, words, stop_at >= 0), 1):
        if score < best:
            best, at = score, j
            if best <= stop_at:
                break
    return best, at


def edit_distance(masks: dict[str, int], m: int, line: str) -> int:
    """Edit distance of the pattern to the whole of ``line``."""
    score = m
    for score in _scores(masks, m, line, True):  # noqa: B007
        pass
    return score


def _scores(masks: dict[str, int], m: int, words, from_first: bool) -> Iterator[int]:
    """After each word, the least distance of the pattern to a stretch that ends there."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for x in words:
        eq = masks.get(x, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp = minus | ~(d0 | plus) & full
        hm = plus & d0
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1) & full
        if from_first:
            hp |= 1
        hm = (hm << 1) & full
        plus = hm | ~(d0 | hp) & full
        minus = hp & d0
        yield score


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that are small enough to send to every task."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each item found in a document: doc_id, item_id, distance, first_word, n_words."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance int, first_word int, n_words int"
    out = None
    for block in item_blocks(items, block_chars):
        sent = spark.sparkContext.broadcast((block, rate, min_words))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for b in batches:
                rows = [(d, *hit) for d, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for hit in matcher.find(text.as_py())]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "first_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(text: Column, sent) -> Column:
    """Whether none of the items of a broadcast block is in the text."""

    @F.pandas_udf("boolean")
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(*sent.value)
        for texts in parts:
            yield pd.Series([not matcher.find(t) for t in texts], dtype=bool)

    return search(text.cast("string"))


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item is found, without moving them."""
    for block in item_blocks(items, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast((block, rate, min_words))
        docs = docs.where(clean(F.col(f"`{text}`"), sent))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
