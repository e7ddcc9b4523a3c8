"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in log space: the likelihood of the text under byte
trigram models, the language that the markup declares, the suffix of the address,
and a prior of the host that is smoothed towards its domain and that towards the
whole corpus.  The models are counted over all labelled documents; declared
languages, suffixes and hosts are weighed by grouped sums of the text's own
posteriors, from which each row's own share is taken out first.

Trigrams of one text depend on each other, so a text counts as at most
``EFFECTIVE`` independent ones.

Defined cases: a null, empty or letter-free text gives no text evidence; a missing
declaration, address or host gives none either; languages are those of the labelled
documents, a corpus without any gives null; ties go to the language that comes
first by code point; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

SLOTS = 1 << 14
EFFECTIVE = 60.0
SMOOTHING = 5.0
#: Trigrams are looked up for so many bytes of text at a time.
RUN_BYTES = 1 << 20
_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
_SKIP = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>|&#?\w+;", re.S | re.I)
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def visible(page: str) -> str:
    return _SKIP.sub(" ", page)


def folded(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "


def _slots(owners: list[int], parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    code = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(18)).astype(np.uint16)
    # trigrams across two parts fall out
    crossing = (ends[:-1, None] - [2, 1]).ravel()
    return np.array(owners), np.delete(code, crossing), np.concatenate(([0], ends[:-1])) - 2 * np.arange(len(parts))


def trigram_runs(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, slots of their trigrams, where each text's begin) for about RUN_BYTES at a time.

    A longer text comes in parts, which overlap so that each trigram is in one of
    them; texts without letters don't come at all.
    """
    owners: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        line = folded(text)
        for at in range(0, len(line) - 2, RUN_BYTES):
            owners.append(i)
            parts.append(line[at : at + RUN_BYTES + 2])
            size += len(parts[-1])
            if size >= RUN_BYTES:
                yield _slots(owners, parts)
                owners, parts, size = [], [], 0
    if parts:
        yield _slots(owners, parts)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and log P(slot | language), counted over all labelled documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_numpy(zero_copy_only=False)
            for owners, slots, begin in trigram_runs(t.as_py() for t in b.column(1)):
                lang_of = np.repeat(langs[owners], np.diff(begin, append=len(slots)))
                for lang in sorted(set(langs[owners])):
                    sums[lang] = sums.get(lang, 0) + np.bincount(slots[lang_of == lang], minlength=SLOTS)
        for lang, c in sums.items():
            where = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int64()), pa.array(c[where], pa.int64())], names=["lang", "slot", "n"])

    labelled = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = labelled.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()  # languages x SLOTS
    langs = sorted(rows["lang"].unique())
    counts = np.full((len(langs), SLOTS), 0.5)
    if not langs:
        return [], counts.astype(np.float32)
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[k, own["slot"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def posteriors(texts: Sequence[str | None], model: np.ndarray, markup: bool) -> np.ndarray:
    """One row for each text: the posteriors of the languages under an even prior."""
    size, sums = np.zeros(len(texts)), np.zeros((len(texts), len(model)))
    for owners, slots, begin in trigram_runs(visible(t or "") if markup else t for t in texts):
        np.add.at(size, owners, np.diff(begin, append=len(slots)))
        for k, row in enumerate(model):
            np.add.at(sums[:, k], owners, np.add.reduceat(row[slots], begin, dtype=np.float64))
    z = sums * np.minimum(1.0, EFFECTIVE / np.maximum(size, 1))[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
    return p / p.sum(axis=1, keepdims=True)


def text_evidence(content: Column, model: np.ndarray, markup: bool) -> Column:
    """Posteriors of the languages from the text alone, under an even prior."""

    @F.pandas_udf("array<double>")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(list(posteriors(texts, model, markup)), dtype=object)

    return judge(content.cast("string"))


def fuse(rows: DataFrame, langs: list[str], smoothing: float = SMOOTHING) -> DataFrame:
    """``rows`` with lang, probability and text_lang.

    ``rows``: text (posteriors), declared, suffix, domain, host, each of which may
    be null, and any other columns.
    """
    spread = [F.col("text")[k].alias(f"t{k}") for k in range(len(langs))]
    sums = [F.sum(f"t{k}").alias(f"s{k}") for k in range(len(langs))]
    base = checkpointed(rows.select("*", *spread))
    whole = F.broadcast(base.agg(*[F.coalesce(F.sum(f"t{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(len(langs))]))
    out = base.crossJoin(whole)  # one row
    for name in ("declared", "suffix", "domain", "host"):
        # tables of their own, so that a very large host can be split when its rows meet its sums
        found = checkpointed(base.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_key")).agg(*sums))
        found = found.select("_key", F.array(*[f"s{k}" for k in range(len(langs))]).alias(f"_{name}"))
        out = out.join(found, F.col(name) == F.col("_key"), "left").drop("_key")
    n = len(langs)
    total = sum((F.col(f"g{k}") for k in range(n)), F.lit(0.0))
    prior = [(F.col(f"g{k}") - F.col(f"t{k}") + 1.0) / (total - 1.0 + n) for k in range(n)]

    def others(name: str, k: int) -> Column:
        """What the other rows with this value say for a language."""
        return F.greatest(F.col(f"_{name}")[k] - F.col(f"t{k}"), F.lit(0.0))

    def size(name: str) -> Column:
        return sum((others(name, k) for k in range(n)), F.lit(0.0))

    for name in ("domain", "host"):
        prior = [F.when(F.col(f"_{name}").isNull(), p).otherwise((others(name, k) + smoothing * p) / (size(name) + smoothing)) for k, p in enumerate(prior)]
        out = out.select("*", *[p.alias(f"p_{name}{k}") for k, p in enumerate(prior)])
        prior = [F.col(f"p_{name}{k}") for k in range(n)]

    def likelihood(name: str, k: int) -> Column:
        """P(value | language), smoothed towards the value's share of all rows."""
        share = (size(name) + 0.5) / (total + 1.0)
        seen = (others(name, k) + smoothing * share) / (F.greatest(F.col(f"g{k}") - F.col(f"t{k}"), F.lit(0.0)) + smoothing)
        return F.when(F.col(f"_{name}").isNull(), 0.0).otherwise(F.log(seen))

    score = [F.log(F.greatest(F.col(f"t{k}"), F.lit(1e-300))) + F.log(prior[k]) + likelihood("declared", k) + likelihood("suffix", k) for k in range(n)]
    out = out.select(*rows.columns, F.array(*score).alias("_z"))
    top = F.array_max("_z")
    best = lambda a, m: F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position(a, m) - 1).cast("int"))
    return out.select(
        *rows.columns,
        best(F.col("_z"), top).alias("lang"),
        (1 / F.aggregate("_z", F.lit(0.0), lambda a, z: a + F.exp(z - top))).alias("probability"),
        best(F.col("text"), F.array_max("text")).alias("text_lang"),
    )


def identify(pages: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Languages of pages (by page_id) and documents (by doc_id).

    For documents the source stands for the host; they have no address and no
    markup.  The text models come from the documents' own labels.
    """
    langs, model = train(docs)
    none = F.lit(None).cast("string")
    columns = "page_id", "doc_id", "declared", "suffix", "domain", "host", "text"
    source = F.concat(F.lit("source:"), F.col("source").cast("string"))
    rows = docs.select(F.lit(None).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), none.alias("declared"), none.alias("suffix"), source.alias("domain"), source.alias("host"), text_evidence(F.col("text"), model, False).alias("text"))
    if pages is not None:
        host = F.lower(F.regexp_extract("url", _HOST, 1))
        labels = F.split(F.when(host != "", host), "\\.")
        declared = F.lower(F.regexp_extract("html", _DECLARED, 1))
        rows = rows.unionByName(
            pages.select(
                F.col("page_id").cast("long").alias("page_id"),
                F.lit(None).cast("long").alias("doc_id"),
                F.when(declared != "", declared).alias("declared"),
                F.element_at(labels, -1).alias("suffix"),
                F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".").alias("domain"),
                F.when(host != "", host).alias("host"),
                text_evidence(F.col("html"), model, True).alias("text"),
            )
        )
    rows = rows.select(*columns)
    return fuse(rows, langs) if langs else rows.select("*", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("doc_id", "page_id", "host", "declared", "text_lang", "lang", F.round("probability", 6).alias("probability"))
