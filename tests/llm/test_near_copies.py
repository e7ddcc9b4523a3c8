"""Near copies against brute force: exact Jaccard similarity over all pairs."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from axisfold.llm import common, components, near_copies, simhash, wide_simhash

SF = "/root/testdata/sf0.001"


def naive_keepers(rows):
    sets, root = {}, {d: d for d, _ in rows}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(d) for d in ids})


def edited(words, places):
    return " ".join("changed" if i in places else w for i, w in enumerate(words))


def test_stage_removes_all_near_copies_of_a_table(spark):
    docs = common.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = corpus_pipeline.near_duplicates_stage(spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == naive_keepers(rows)


def test_similarity_decides_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    draw, rows = random.Random(3), []
    for base in range(6):
        words = [f"w{base}x{i}" for i in range(204)]
        rows.append(" ".join(words))
        # n separate words changed: similarity (200 - 5 n) / (200 + 5 n), which is below 0.8 from 5 on
        for n in [1, 2, 3, 4, 5, 6, 8] * 4:
            rows.append(edited(words, set(draw.sample(range(10, 194, 6), n))))
    # 180 shared shingles of 225: similarity 0.8 to the digit
    rows += [" ".join(f"a{i}" for i in range(184 + 22)), " ".join([f"a{i}" for i in range(184)] + [f"b{i}" for i in range(23)])]
    rows = list(enumerate(rows))
    want = naive_keepers(rows)
    assert len(rows) - 1 not in want and len(want) > 12
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.without_near_copies(df).collect()) == want


def test_awkward_rows(spark):
    rows = [(1, "a b c"), (2, "A  b\nc"), (2, "other words"), (3, None), (4, ""), (None, "a b c"), (None, None), (5, "a b")]
    got = near_copies.without_near_copies(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [1, 2, 3, 5]
    assert [r["text"] for r in got.where("doc_id = 2").collect()] == ["other words"]
    assert near_copies.without_near_copies(got.where(F.lit(False))).count() == 0


def test_no_text_is_lost(spark):
    p, q = "one two three four five six", "another text of seven words in all"
    for rows in ([(3, q), (5, p), (5, q)], [(5, p), (5, q)], [(5, p), (None, q), (None, p)], [(1, p), (None, p), (None, q), (None, q)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for left in (near_copies.without_near_copies(df), simhash.without_copies(df)):
            assert sorted(r["text"] for r in left.collect()) == [q, p], rows


def plain_fingerprint(hashes):
    """Each bit counted by itself."""
    mask, words = (1 << 64) - 1, []
    for draw in wide_simhash._DRAW.tolist():
        mixed = []
        for h in hashes:
            z = h ^ draw
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
            mixed.append(z ^ (z >> 31))
        words.append(sum((2 * sum(m >> i & 1 for m in mixed) > len(mixed)) << i for i in range(64)))
    return words


def test_wide_fingerprints_bit_by_bit():
    for n in (0, 1, 2, 5, 255, 256, 700):
        s = near_copies.shingle_set(" ".join(f"v{i}" for i in range(n + 4))) if n else np.zeros(0, dtype=np.uint64)
        assert wide_simhash.fingerprint(s).tolist() == plain_fingerprint(s.tolist())


def sets_of_edited_texts():
    """Groups of nearer and farther copies, of all sizes, some of the same size."""
    draw, sets = random.Random(8), []
    for base in range(60):
        words = [f"w{base}x{i}" for i in range(draw.choice([8, 9, 60, 60, 60, draw.randrange(10, 900)]))]
        for n in range(8):
            sets.append(near_copies.shingle_set(edited(words, set(draw.sample(range(len(words)), min(len(words), n * len(words) // 60))))))
            sets.append(near_copies.shingle_set(" ".join(words[: len(words) - n * len(words) // 25])))
    return list({near_copies.set_key(s): s for s in sets}.values())


def test_vantage_point_search_equals_brute_force_and_misses_no_similar_pair(spark):
    sets = sets_of_edited_texts()
    bits = np.array([wide_simhash.fingerprint(s) for s in sets])
    want, missed, similar = simhash.Union(len(sets)), 0, 0
    for i, s in enumerate(sets):
        far = np.bitwise_count(bits ^ bits[i])
        near = (far.sum(axis=1, dtype=int) <= wide_simhash.RADIUS) & (far[:, : wide_simhash.HEAD].sum(axis=1, dtype=int) <= wide_simhash.HEAD_RADIUS)
        near &= np.array([5 * min(len(s), len(t)) >= 4 * max(len(s), len(t)) for t in sets])
        want.join(np.full(near.sum(), i), np.nonzero(near)[0])
        for j in range(i):
            alike = near_copies.similar(len(np.intersect1d(s, sets[j])), len(s), len(sets[j]))
            similar, missed = similar + alike, missed + (alike and not near[j])
    assert similar > 500 and missed == 0
    rows = [(i, len(s), bits[i].tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "node long, size long, bits binary").repartition(3)
    roots = want.roots().tolist()
    for shard_size in (50, 200, 10_000):
        got = {r["node"]: r["root"] for r in components.components(wide_simhash.links(df, shard_size)).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == roots


def test_a_shard_is_left_where_bounds_rule_it_out():
    rng = np.random.default_rng(4)
    points = np.zeros(4_000, dtype=wide_simhash.POINT)
    points["node"], points["bits"] = np.arange(4_000), rng.integers(0, 1 << 64, (4_000, wide_simhash.WORDS), dtype=np.uint64)
    points["size"] = np.exp(rng.uniform(3, 9, 4_000)).astype(int)
    routed = list(wide_simhash.route(wide_simhash.grow_tree(points, 32), points))
    assert sorted(np.concatenate([h for _, h, _ in routed]).tolist()) == list(range(4_000))
    assert len(routed) == 32 and sum(len(g) for _, _, g in routed) < 5 * 4_000


def test_stage_links_by_the_named_search(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, edited(words, {50})), (3, " ".join(words).upper())], "doc_id long, text string")
    asked = []
    monkeypatch.setattr(near_copies, "links", lambda nodes: asked.append(nodes.count()) or wide_simhash.links(nodes))
    assert [r["doc_id"] for r in near_copies.without_near_copies(df).collect()] == [1] and asked == [2]
