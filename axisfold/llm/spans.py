"""Substring dedup over sliding sentence spans.

Texts are cut into sentences.  Every run of several consecutive sentences that
together hold enough words is hashed; equal hashes are joined over the whole
corpus; and sentences are removed that lie in a span whose first occurrence, by
doc_id, text and position, is elsewhere.

A run starts at each sentence and takes the fewest sentences, at least
``min_sentences``, that reach ``min_words`` words.  A sentence ends at a line break,
after a word that ends with a full stop, question or exclamation mark (closing
marks may follow), and also between two words of which the hash says so, one pair in
``CUT_ONE_IN``.  All of these depend on the words next to the place only, so a
passage is cut alike wherever it stands, also inside one long sentence.  Characters
of scripts without spaces count as words.  Words are compared as written, whatever
the white space between them.

Defined cases: null and empty texts have no sentences; a text too short for one
run keeps all it has; runs that repeat inside one document count as repeats of
their first occurrence there; rows that are equal in doc_id and text are one
document and keep the same sentences, rows that share a doc_id only are documents
of their own; rows without doc_id come after all others; a stretch of one word
repeated has no cuts of its own and is found as part of its neighbours only; extra
columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, checkpointed, document_key, free_name, table

MIN_SENTENCES = 2
MIN_WORDS = 20
CUT_ONE_IN = 6
ENDS = frozenset(".!?…。！？")
CLOSERS = frozenset("\"'”’»)]」』）")
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_STOPS = "。！？"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}{_STOPS}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}{_STOPS}]*[{_STOPS}]+[」』”’）]*|[^\\s{_UNSPACED}{_STOPS}]+")
_BASE = 0x9E3779B97F4A7C15


class Codes(dict):
    """The code of each word met so far: 63 bits of its hash, and whether a sentence ends with it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        ends = word[-1] in ENDS or word[-1] in CLOSERS and word[-2:-1] in ENDS
        code = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & ~1 | ends
        return code


_CODES = Codes()
_POWERS = np.ones((2, 1), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first powers of the base of run hashes, and of its inverse modulo 2**64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        steps = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=np.uint64).repeat(2 * n, axis=1)
        steps[:, 0] = 1
        _POWERS = steps.cumprod(axis=1, dtype=np.uint64)
    return _POWERS[:, :n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def is_unspaced(text: str) -> bool:
    return not text.isascii() and _ANY_UNSPACED.search(text) is not None


def sentence_starts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words, and the number of the first word of each sentence; then that of all words."""
    if not text or text.isspace():
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    lines = list(map(_WORD.findall if is_unspaced(text) else str.split, text.split("\n")))
    upto = np.cumsum([len(x) for x in lines])
    n = int(upto[-1])
    codes = np.fromiter(map(_CODES.__getitem__, chain.from_iterable(lines)), dtype=np.uint64, count=n)
    begins = np.ones(n + 1, dtype=bool)
    begins[1:n] = (codes[:-1] & np.uint64(1)).astype(bool) | (mixed(codes[:-1] * np.uint64(_BASE) + codes[1:]) % np.uint64(CUT_ONE_IN) == 0)
    begins[upto] = True
    return codes, np.nonzero(begins)[0]


def spans(text: str | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentences, signed 64-bit hash) of every run."""
    codes, at = sentence_starts(text)
    first = np.arange(len(at) - 1)
    end = np.maximum(first + min_sentences, np.searchsorted(at, at[:-1] + min_words))
    first, end = first[end < len(at)], end[end < len(at)]
    forth, back = powers(len(codes) + 1)
    upto = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * forth[:-1], out=upto[1:])
    a, b = at[first], at[end]
    return first, end - first, mixed((upto[b] - upto[a]) * back[a] + (b - a).astype(np.uint64)).view(np.int64)


def together(columns: Iterator[list[np.ndarray]], names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The columns of many documents in batches of about so many rows."""
    held: list[list[np.ndarray]] = []
    n = 0
    for cols in columns:
        held.append(cols)
        n += len(cols[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def span_hashes(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """``span`` of each run, and nothing else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together(([spans(t.as_py(), min_sentences, min_words)[2]] for b in batches for t in b.column(0)), ["span"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "span long")


def span_table(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """One row for each run: doc, body, first, n, span, again (not the first of its kind in the text)."""

    def one(doc: pa.Scalar, body: pa.Scalar, text: pa.Scalar) -> list[np.ndarray]:
        first, n, span = spans(text.as_py(), min_sentences, min_words)
        again = np.ones(len(span), dtype=bool)
        again[np.unique(span, return_index=True)[1]] = False
        return [np.full(len(span), doc.as_py()), np.full(len(span), body.as_py()), first.astype(np.int32), n.astype(np.int32), span, again]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from together((one(*row) for b in batches for row in zip(*b.columns, strict=True)), ["doc", "body", "first", "n", "span", "again"])

    text = F.col("text").cast("string")
    return docs.select(*document_key(text), text).mapInArrow(run, "doc long, body long, first int, n int, span long, again boolean")


def repeated(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with sentences to remove: doc_id, body, removed (their numbers from 0), first_docs.

    ``body`` is the hash of the text; ``first_docs`` are the documents that keep the
    first occurrences.
    """
    hashes = span_hashes(docs, min_sentences, min_words)
    # tables of their own, so that a very common span can be split when its runs meet it
    common = checkpointed(hashes.groupBy("span").count().where("count > 1").select("span"))
    runs = checkpointed(span_table(docs, min_sentences, min_words).join(common, "span"))
    firsts = checkpointed(runs.groupBy("span").agg(F.min(F.struct("doc", "body")).alias("kept")))
    later = runs.join(firsts, "span").where("doc <> kept.doc OR body <> kept.body OR again")
    # sets shrink before they are shuffled, also those of a document that stands there very often
    found = later.groupBy("doc", "body").agg(F.collect_set(F.struct("first", "n")).alias("runs"), F.collect_set("kept.doc").alias("first_docs"))
    covered = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))
    unmarked = F.when(F.col("doc") < NO_ID, F.col("doc"))
    return found.select(unmarked.alias("doc_id"), "body", F.sort_array(F.array_distinct(covered)).alias("removed"), F.sort_array(F.filter("first_docs", lambda d: d < NO_ID)).alias("first_docs"))


def left_over(text: str, removed: np.ndarray) -> str:
    """The text without these sentences and the white space after them."""
    at = sentence_starts(text)[1]
    words = [m.start() for m in (_WORD if is_unspaced(text) else re.compile(r"\S+")).finditer(text)]
    begin = np.array([*words, len(text)])[at]
    begin[0] = 0
    gone = np.zeros(len(at) - 1, dtype=bool)
    gone[removed] = True
    return "".join(text[a:b] for a, b, g in zip(begin, begin[1:], gone, strict=False) if not g).strip()


def without_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated sentences cut out of the texts; texts without any stay as they are."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series([t if r is None else left_over(t, r) for t, r in zip(texts, removed, strict=True)], dtype=object)

    doc, body, gone = (free_name(docs, n) for n in ("_doc", "_body", "_removed"))
    found = repeated(docs, min_sentences, min_words).select(F.coalesce("doc_id", F.lit(NO_ID)).alias(doc), F.col("body").alias(body), F.col("removed").alias(gone))
    own_doc, own_body = document_key(F.col("text"))
    joined = docs.join(checkpointed(found), (own_doc == F.col(doc)) & (own_body == F.col(body)), "left")
    return joined.withColumn("text", cut(F.col("text").cast("string"), gone)).select(*docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("removed").alias("n_removed"), "removed", "first_docs")
