"""Repeated passages without sentence ends of their own."""

import random
import re

import pytest

from axisfold.llm import spans

DRAW = random.Random(4)


def some(n):
    return " ".join(f"w{DRAW.randrange(10**6)}" for _ in range(n))


def shared(a, b):
    return {*spans.spans(a)[2].tolist()} & {*spans.spans(b)[2].tolist()}


def number(text):
    """How many sentences the text has."""
    return len(spans.sentence_starts(text)[1]) - 1


def test_windows_of_50_words_of_a_long_sentence_are_found():
    passage = some(3000).split()
    windows = [" ".join(passage[i : i + 50]) for i in range(0, 2950, 5)]
    missed = [w for w in windows if not shared(f"{some(9)} {w} {some(30)}.", f"{some(40)} {w} {some(3)}.")]
    assert len(missed) < 0.04 * len(windows)
    assert all(shared(f"{some(9)} {' '.join(passage[i : i + 100])}", f"{some(40)} {' '.join(passage[i : i + 100])} {some(3)}") for i in range(0, 2900, 5))


def test_unspaced_text_is_split():
    text = "".join(chr(0x4E00 + DRAW.randrange(3000)) + ("。" if i % 15 == 14 else "") for i in range(75))
    assert number(text) >= 5
    assert shared(f"前{text}後", f"他{text}")


def test_one_long_sentence_is_cut_out(spark):
    passage = some(60)
    rows = [(1, f"Before it {passage} after it."), (2, f"Own words {passage} stay here.")]
    got = {r["doc_id"]: r["text"] for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[2].startswith("Own words") and got[2].endswith("stay here.")
    assert len(got[2].split()) < 36


def test_texts_under_one_id_are_documents_of_their_own(spark):
    passage, own = some(60), some(60)
    for ids in ((1, None, None), (9, 9, 9)):
        rows = list(zip(ids, (passage, passage + " more", own)))
        left = [r["text"] for r in spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert own in left and passage.split()[0] in " ".join(left) and len(left) == 3
    assert spans.repeated(spark.createDataFrame([(9, passage)] * 3 + [(None, own)] * 2, "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["", "a b c. d e f", some(13), some(80), "x。y！z", " \n a.\n\n b"])
def test_all_words_are_kept(text):
    assert number(text) == len(re.findall("x。|y！|z", text)) or "。" not in text
    assert spans.left_over(text, []).split() == text.split() if text.split() else number(text) == 0


def test_sentences_end_at_marks_and_lines(monkeypatch):
    monkeypatch.setattr(spans, "CUT_ONE_IN", 1 << 62)
    text = "One two. Three (four!) five\nsix seven\n\n \neight? nine"
    words, at = text.split(), spans.sentence_starts(text)[1].tolist()
    assert [" ".join(words[a:b]) for a, b in zip(at, at[1:])] == ["One two.", "Three (four!)", "five", "six seven", "eight?", "nine"]
