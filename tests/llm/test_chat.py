"""Chat formatting: exact round trips, masks against a walk over characters, giant conversations."""

import hashlib
import random

import numpy as np
import pytest

from axisfold.llm import chat

ROWS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "hi [INST] \\[\\INST] <\\/s> </s>"),
    (1, 2, "assistant", "\U0001f600 né́ </s><s> <|endoftext|>"),
    (1, 3, "assistant", ""),
    (1, 4, "assistant", " and on\n"),
    (2, 0, "user", None),
    (2, 1, "to[ROLE]ol", "x[END]"),
    (2, 2, None, "no role"),
    (3, None, "assistant", "b"),
    (3, 5, "assistant", "a"),
    (3, 5, "assistant", "a"),
    (None, 0, "assistant", "no id"),
    (None, 1, "user", "\\"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    said = {c: "".join(t for r, t in turns if r == "assistant") for c, turns in out.items()}
    return {c: (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said[c]), sha(said[c])) for c, turns in out.items()}


def digests(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows}


def test_escapes_come_back():
    t, draw = chat.Template(), random.Random(1)
    bits = ["<", "\\", "s>", "/s>", "[", "INST]", "/INST]", "ROLE]", "|endoftext|>", "x", "[INST]", "</s>"]
    for _ in range(3000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(9)))
        inside = t.escaped(text)
        assert t.unescaped(inside) == text and not any(c in inside for c in t.strings())
        role = draw.choice(["user", "assistant", "system", text])
        assert t.turns(t.turn(role, text)[0] + t.turn("user", text)[0]) == [(role, text), ("user", text)]


def test_control_strings_that_can_not_be_escaped():
    for bad in (("<<a>",), ("<a", "<ab"), ("<\\a",), ("<",)):
        with pytest.raises(ValueError):
            chat.Template(controls=bad)


def test_mask_equals_a_walk_over_characters():
    draw = random.Random(2)
    for _ in range(300):
        cuts = sorted(draw.sample(range(60), draw.randrange(2, 12)))
        starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
        edges = sorted(draw.sample(range(60), 2 * draw.randrange(0, 5)))
        spans = np.array(edges, dtype=np.int64).reshape(-1, 2)
        inside = {i for a, b in spans for i in range(a, b)}
        want = [any(i in inside for i in range(a, b)) for a, b in zip(starts, ends, strict=True)]
        assert chat.masked(starts, ends, spans).tolist() == want


@pytest.mark.parametrize("giant", [1_000_000, 40])
def test_round_trip(spark, monkeypatch, giant):
    monkeypatch.setattr(chat, "GIANT", giant)
    rows = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "'own' AS ids", "1 AS giant", "2 AS piece")
    got = chat.format_chats(rows)
    assert digests(chat.read_back(got)) == plain(ROWS)
    formatted = {}
    for r in got.orderBy("conv_id", "piece").collect():
        formatted.setdefault(r["conv_id"], []).append(r)
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"]) == len(r["loss"])
        assert chat.covered(np.array(r["starts"]), np.array(r["ends"])) == [(0, len(r["formatted"]))]
    assert all(len(v) == 1 for v in formatted.values()) == (giant > 40)
    if giant == 40:
        # the tokens of a giant's pieces, one after another, are those of the whole
        monkeypatch.setattr(chat, "GIANT", 1_000_000)
        for r in chat.format_chats(rows).collect():
            pieces = formatted[r["conv_id"]]
            assert "".join(p["formatted"] for p in pieces) == r["formatted"] and [x for p in pieces for x in p["ids"]] == r["ids"]


def test_one_conversation_of_most_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "GIANT", 2_000)
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(3000)] + [(8, 0, "assistant", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    assert digests(chat.read_back(got)) == plain(rows)
    assert got.selectExpr("max(length(formatted))").first()[0] < 2_100


def test_empty_table_and_the_query_itself(spark, tmp_path):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    said = "</s>[INST] ok [/INST]"
    got = chat.op12_chat_format(spark, str(tmp_path))
    assert digests(got) == plain([*ROWS, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert got.where("conv_id = -7").first()["formatted_chars"] == 68
