"""Conversations as training text: one encoding with offsets, and a loss mask aligned to it.

Every turn is written between marks of its role; a role without marks of its own is
written out.  The marks are special tokens that no text can hold, since control
strings inside texts are escaped: their first character gets a backslash behind it,
and one more for each that is there already, so that unescaping gives back every text.
A conversation is rendered whole and encoded once; the sorted spans of its turns are
met with the token spans by binary search, and a token is under the loss where it
shares a character with an assistant's text.  No token reaches over a mark.

``read_back`` uses the output alone: it takes the formatted text apart again, and
gathers what the masked tokens cover.

Rows are dealt by ranges of conversations.  One of more than ``GIANT`` characters is
dealt by its turns as well and rendered in pieces of about that size, whose tokens in
a row are those of the whole; its digests read the pieces in order, one at a time.

Defined cases: null roles and texts are empty; rows of one conversation go by turn
(null first), then role, then text, so repeated rows are turns of their own; rows
without conv_id are one conversation; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A public byte-level vocabulary; its place is a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: So many characters of a conversation are rendered and encoded at a time.
GIANT = 1_000_000
#: So many characters, about, are encoded in one call.
BATCH = 400_000


@dataclass(frozen=True)
class Template:
    """Opening and closing marks by role, those of any other role around its name, and further control strings."""

    marks: Mapping[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    controls: tuple[str, ...] = ("<|endoftext|>",)
    learned: str = "assistant"

    def __post_init__(self) -> None:
        known = self.strings()
        if any(len(c) < 2 or "\\" in c or any(c[0] in x[1:] for x in known) for c in known):
            raise ValueError("a control string has two characters or more, and its first one stands nowhere else in any")
        if any(a != b and b.startswith(a) for a in known for b in known):
            raise ValueError("a control string begins with another")

    def mark_strings(self) -> list[str]:
        return list(dict.fromkeys([*[m for pair in self.marks.values() for m in pair], *self.other]))

    def strings(self) -> list[str]:
        return list(dict.fromkeys([*self.mark_strings(), *self.controls]))

    def _pattern(self, slashes: str) -> str:
        return "|".join(f"(?<={re.escape(c[0])}){slashes}(?={re.escape(c[1:])})" for c in self.strings())

    def escaped(self, text: str) -> str:
        return re.sub(self._pattern(r"\\*"), lambda m: "\\" + m.group(), text)

    def unescaped(self, text: str) -> str:
        return re.sub(self._pattern(r"\\+"), lambda m: m.group()[1:], text)

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A rendered turn, and where the text stands in it."""
        if role in self.marks:
            first, last = self.marks[role]
        else:
            first, last = f"{self.other[0]}{self.escaped(role)}{self.other[1]}", self.other[2]
        body = self.escaped(text)
        return f"{first}{body}{last}", len(first), len(first) + len(body)

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of all turns of a formatted text."""
        roles = {first: role for role, (first, _) in self.marks.items()}
        parts = re.split("(" + "|".join(map(re.escape, self.mark_strings())) + ")", formatted)[1:]
        out, at = [], 0
        while at < len(parts):
            role = roles.get(parts[at])
            if role is None:  # mark, role, mark, text, mark, nothing
                role, at = self.unescaped(parts[at + 1]), at + 2
            out.append((role, self.unescaped(parts[at + 1])))
            at += 4
        return out


def masked(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens share a character with one of the sorted, disjoint spans [begin, end)."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")  # the first span that ends after the token's start
    inside = at < len(spans)
    begin = spans[np.minimum(at, len(spans) - 1), 0]
    return inside & (begin < ends) & (starts < ends)


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The stretches that sorted token spans cover; tokens may share a character."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.nonzero(np.concatenate(([True], starts[1:] > reach[:-1])))[0]
    return list(zip(starts[new].tolist(), reach[np.append(new[1:] - 1, len(reach) - 1)].tolist(), strict=True))


FORMATTED = "conv_id long, piece long, whole boolean, n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def format_chats(rows: DataFrame, template: Template | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, piece (0, or a giant conversation's pieces in order), whole, n_turns, formatted, and by token: ids, starts, ends (in code points), loss."""
    template = template or Template()
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = rows.sparkSession.sparkContext.broadcast(f.read())  # one file
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    # by hash, so that rows without conv_id have a size too
    giants = rows.groupBy(F.xxhash64("conv_id").alias("of")).agg(F.sum(F.length("text") + 32).alias("size")).where(F.col("size") > GIANT).select("of", F.lit(True).alias("giant"))
    rows = rows.join(giants, F.xxhash64("conv_id") == F.col("of"), "left").drop("of").withColumn("giant", F.coalesce("giant", F.lit(False)))
    spread = F.when(F.col("giant"), F.col("turn"))
    # all rows of a conversation that isn't giant have the same key, and stay together
    dealt = rows.repartitionByRange(F.col("conv_id"), spread, F.when(F.col("giant"), F.xxhash64("role", "text")))
    dealt = dealt.sortWithinPartitions("conv_id", "turn", *[F.when(F.col("giant"), F.xxhash64("role", "text"))], "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

        coder = Tokenizer.from_str(vocabulary.value)
        coder.add_special_tokens([AddedToken(m, normalized=False) for m in template.mark_strings()])
        if isinstance(coder.pre_tokenizer, pre_tokenizers.ByteLevel):
            coder.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's space is its own
        ready: list[tuple] = []  # (conv_id, piece, whole, texts, spans under the loss)

        def encoded() -> pa.RecordBatch:
            texts = ["".join(r[3]) for r in ready]
            out = {k: [] for k in ("ids", "starts", "ends", "loss")}
            for r, e in zip(ready, coder.encode_batch(texts, add_special_tokens=False), strict=True):
                at = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
                out["ids"].append(np.array(e.ids, dtype=np.int32))
                out["starts"].append(at[:, 0])
                out["ends"].append(at[:, 1])
                out["loss"].append(masked(at[:, 0], at[:, 1], np.array(r[4], dtype=np.int64).reshape(-1, 2)))
            first = [pa.array([r[i] for r in ready], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))]
            first += [pa.array([len(r[3]) for r in ready], pa.int64()), pa.array(texts, pa.string())]
            arrays = [pa.array(out[k], pa.list_(pa.int32())) for k in ("ids", "starts", "ends")] + [pa.array(out["loss"], pa.list_(pa.bool_()))]
            ready.clear()
            return pa.RecordBatch.from_arrays([*first, *arrays], names=["conv_id", "piece", "whole", "n_turns", "formatted", "ids", "starts", "ends", "loss"])

        now, size, waiting = None, 0, 0
        for b in batches:
            for conv, role, text, giant, order in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if now is None or now[0] != conv or (giant and size > GIANT):
                    if now is not None:
                        ready.append(now)
                        waiting += size
                        if waiting > BATCH:
                            yield encoded()
                            waiting = 0
                    now, size = (conv, order if giant else 0, not giant, [], []), 0
                made, begin, end = template.turn(role, text)
                now[3].append(made)
                if role == template.learned and end > begin:
                    now[4].append((size + begin, size + end))
                size += len(made)
        if now is not None:
            ready.append(now)
            yield encoded()

    # positions grow with the partition and inside it, as the order of a giant's pieces does
    numbered = dealt.select("conv_id", "role", "text", "giant", F.monotonically_increasing_id().alias("order"))
    return numbered.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = "conv_id long, piece long, whole boolean, n_turns long, loss_chars long, formatted_chars long, turns string, learned string"


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted conversations hold: turns, and the text under the loss mask, as counts and digests.

    Whole conversations are digested where they lie.  Pieces are brought together, in
    order, as the texts that they hold, and stream through one digest.
    """
    template = template or Template()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for whole, text, starts, ends, loss in zip(*[b.column(i) for i in (2, 4, 5, 6, 7)], strict=True):
                text, mask = text.as_py(), np.asarray(loss.values.to_numpy(zero_copy_only=False), dtype=bool)
                turns = "".join(f"{role}\n{said}\n" for role, said in template.turns(text))
                stretches = covered(starts.values.to_numpy()[mask], ends.values.to_numpy()[mask])
                learned = "".join(template.unescaped(text[a:z]) for a, z in stretches)
                out.append((len(learned), len(text), *((sha(turns), sha(learned)) if whole.as_py() else (turns, learned))))
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], *arrays], names=["conv_id", "piece", "whole", "n_turns", "loss_chars", "formatted_chars", "turns", "learned"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
        now, said, learned = None, None, None

        def ended() -> dict:
            return now | {"turns_sha256": said.hexdigest(), "loss_sha256": learned.hexdigest()}

        for b in batches:
            done = []
            for r in b.to_pylist():
                counts = {k: r[k] for k in ("conv_id", "n_turns", "loss_chars", "formatted_chars")}
                if r["whole"]:
                    done.append(counts | {"turns_sha256": r["turns"], "loss_sha256": r["learned"]})
                    continue
                if now is None or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        done.append(ended())
                    now, said, learned = counts, hashlib.sha256(), hashlib.sha256()
                else:
                    now |= {k: now[k] + v for k, v in counts.items() if k != "conv_id"}
                said.update(r["turns"].encode())
                learned.update(r["learned"].encode())
            yield pa.RecordBatch.from_pylist(done, schema=kind)
        if now is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=kind)

    read = formatted.select("conv_id", "piece", "whole", "n_turns", "formatted", "starts", "ends", "loss").mapInArrow(parts, _READ)
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(digests, DIGEST)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return read_back(format_chats(rows))
