"""Runs of words against the definition, tried out period by period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from axisfold.llm import periodic


def plain_runs(w):
    """Every period from the smallest on; a stretch keeps the first one that it shows."""
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize("piece", [1, 3, 16, 1 << 16])
def test_runs_equal_their_definition(piece, monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", piece)
    draw = random.Random(piece)
    for _ in range(700):
        n, kinds = draw.randrange(0, 90), draw.choice([1, 2, 2, 3, 5])
        w = [draw.randrange(kinds) for _ in range(n)]
        if n > 8 and draw.random() < 0.6:
            a = draw.randrange(n)
            p = 1 + (n - a) // draw.randrange(3, 11)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            if draw.random() < 0.3:
                w[draw.randrange(n)] = 9
        assert periodic.find_runs(np.array(w, dtype=np.int64)) == plain_runs(w), w


def test_words_one_by_one_extend_an_open_run():
    catcher, seen = periodic.SquareCatcher(), []
    for i, x in enumerate([7, *[1, 2, 3] * 6, 8, 9]):
        catcher.append(np.array([x]))
        seen.append((i, catcher.runs()))
    assert seen[11][1] == [] and seen[12][1] == [(1, 12, 3)] and seen[-1][1] == [(1, 18, 3)]


def test_wrong_fingerprints_change_nothing(monkeypatch):
    """Every suffix seems to be a square; only squares become runs."""
    w = [1, 2, 3, 1, 2, 3, 1, 2, 3, 1, 2, 3, 5, 6, 5, 6, 5, 6, 5, 6, 5]
    monkeypatch.setattr(periodic, "_MIX", np.uint64(0))
    assert periodic.find_runs(np.array(w)) == plain_runs(w) == [(0, 12, 3), (12, 9, 2)]


def test_long_texts_of_one_word_and_of_one_long_period():
    assert periodic.find_runs(np.zeros(300_000, dtype=np.int64)) == [(0, 300_000, 1)]
    block = np.random.default_rng(1).integers(0, 1000, 20_011)
    assert periodic.find_runs(np.concatenate(([5000], np.tile(block, 5), [6000]))) == [(1, 5 * 20_011, 20_011)]


def test_collapse_keeps_the_first_period():
    found = b"x a b a b a b a b y".split()
    assert periodic.collapsed(found, plain_runs(found)) == b"x a b y"
    assert periodic.collapsed([], []) == b""


ROWS = [(1, "a b " * 5), (1, "a b " * 5), (2, None), (3, ""), (4, " \t\n "), (None, "z z z z z z z"), (5, "é é é é é é é é é é é é"), (6, "one two")]


def test_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'own' AS _utf8", "1 AS runs", "2 AS collapsed", "3 AS n_runs")
    got = periodic.with_runs(docs)
    assert got.columns == ["doc_id", "text", "_utf8", "n_runs", "runs", "collapsed"]
    rows = got.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((d or 0, t or "") for d, t in ROWS)
    assert all(r["_utf8"] == "own" and r["n_runs"] == 3 for r in rows)
    by_id = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows}
    assert by_id == {1: ([(0, 10, 2)], "a b"), 2: ([], ""), 3: ([], ""), 4: ([], ""), None: ([(0, 7, 1)], "z"), 5: ([(0, 6, 1)], "é é"), 6: ([], "one two")}
    assert periodic.with_runs(docs.limit(0)).count() == 0


def test_query_equals_plain_python(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()}
    looped = 0
    for doc, text in rows:
        w, h = (text or "").split(), zlib.crc32(str(doc).encode())
        n, g = len(w), zlib.crc32(str(doc).encode()) // 10
        if h % 10 == 0 and n:
            a = g % n
            w, looped = [w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] if i >= a else w[i] for i in range(n)], looped + 1
        runs = plain_runs(w)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[doc]
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2]) and r["n_runs"] == len(runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert r["runs_sha256"] == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert looped > 3
