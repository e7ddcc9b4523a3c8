"""Every operator on awkward tables: nulls, empty and long texts, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from axisfold.llm import common, decontamination, html, language, lm_score, mixing, quality, sharding, simhash, spans, toxicity

LONG = " ".join(f"word{i % 977} and.\n" for i in range(40_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. And so on.", "en", "a"),
    (2, "One two three four five six seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. And so on.", "en", "a"),
    (2, "One two three four five six seven eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. And so on.", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (5, " \t\n\x0b\x0c\r ", "de", None),
    (None, "no id at all", "de", "b"),
    (None, None, None, None),
    (6, LONG, "en", "c"),
    (7, "ein kurzer Text \U0001f600 \x00 mit Zeichen", "de", "c"),
    (8, "word", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def clash(df):
    """Columns with the names that operators use inside or return."""
    names = ["row", "block", "shard", "slot", "size", "hash", "copies", "target", "kept", "rule", "n_words", "w", "body", "lines", "fp", "_order", "_id", "_removed", "component_id", "score", "n_chars", "count", "id"]
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="module")
def docs(spark):
    return clash(spark.createDataFrame(ROWS, SCHEMA)).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars long")


def labels(spark, rows=((1, 1, 0), (2, None, None), (None, 0, 1), (4, 0, 1), (4, 1, 0), (6, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "three four five SIX seven; eight"), (2, None), (3, ""), (None, "nineteen twenty and so on"), (4, "word"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_quality(spark, docs, empty):
    got = quality.judge_documents(docs, labels(spark)).collect()
    assert len(got) == len(ROWS) and {r["doc_id"]: r["n_words"] for r in got}[5] == 0
    assert all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert got[0]["row"] == "own row"
    assert quality.judge_documents(docs, labels(spark, [])).where("rule IS NOT NULL").count() == 0
    assert quality.judge_documents(empty, labels(spark)).count() == 0


def test_lm_score(spark, docs, empty):
    got = lm_score.lm_scores(docs).collect()
    assert len(got) == len(ROWS) and {r["doc_id"]: (r["n_words"], r["score"]) for r in got}[4] == (0, 0.0)
    assert lm_score.lm_scores(empty).count() == 0
    one = lm_score.lm_scores(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one["n_words"] == 2 and one["score"] < 0


def test_decontamination(spark, docs, empty):
    hits = decontamination.matches(docs, items(spark)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in hits if r["item_id"]) == [(1, 1), (2, 1), (2, 1), (8, 4)] and sum(r["item_id"] is None for r in hits) == 3
    left = decontamination.decontaminated(docs, items(spark))
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4
    assert decontamination.matches(empty, items(spark)).count() == 0
    assert decontamination.decontaminated(docs, items(spark, [])).count() == len(ROWS)


def test_mixing(spark, docs, empty):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r["copies"] <= 3 for r in got)
    assert {r["source"] for r in got} == {"a", "b", "c", None}
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix_documents(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    blank = mixing.mix_documents(spark.createDataFrame([(1, "", "en", "a"), (2, None, "en", None)], SCHEMA)).collect()
    assert [r["target"] for r in blank] == [0.0, 0.0]


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain < text &amp; more", "x"), (3, "u", "plain < text &amp; more", "x"), (4, "u", "<p>" + "long words " * 200_000, "x"), (5, "u", "<a " * 50_000, "x"), (6, "u", "<!-- never closed <p>x</p>", "x")], "page_id long, url string, html string, main_blocks string")
    got = {r["page_id"]: r["main_blocks"] for r in html.main_text(pages).collect()}
    assert got[1] == got[2] == got[5] == got[6] == [] and len(got[4][0]) == 200_000 * 11 - 1
    assert html.main_text(pages.limit(0)).count() == 0


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert by[1] == by[2] and next(iter(by[3]))[0] == 0 and {c for d in (3, 4, 5) for _, c in by[d]} == {3}
    assert {c for _, c in by[None]} == {3, None}
    left = simhash.without_copies(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 3, 6, 7, 8, None]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.without_copies(empty).count() == 0


def test_spans(spark, docs, empty):
    got = {r["doc_id"]: (r["removed"], r["first_docs"]) for r in spans.repeated(docs).collect()}
    assert got[2][0] == list(range(len(got[2][0]))) and got[2][1] == [1] and 1 not in got
    cut = spans.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    assert {len(r["text"].split()) < 6 for r in cut.where("doc_id = 2").collect()} == {True}
    assert cut.where("doc_id = 3").first()["text"] is None
    assert spans.repeated(empty).count() == 0


def test_sharding(spark, docs, empty):
    got = sharding.shard_rows(docs, 4, seed=1)
    assert set(got.columns) == set(docs.columns) and got.count() == len(ROWS)
    places = sorted((r["shard"], r["slot"]) for r in got.collect())
    assert places == [(s, k) for s in range(4) for k in range(3 if s < 3 else 2)]
    assert sharding.shard_rows(empty, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(docs, 0)


def test_toxicity(spark, docs, empty):
    index = toxicity.fit(docs, labels(spark))
    got = toxicity.scored(docs, index).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs, labels(spark, []))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(empty, index).count() == 0


def test_language(spark, docs, empty):
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.example.de/x", "<html lang=de><p>ein kurzer Text"), (2, "http://a.example.de/x", "<html lang=de><p>ein kurzer Text"), (3, "nonsense", "")], "page_id long, url string, html string")
    got = language.identify(pages, docs).collect()
    assert len(got) == len(ROWS) + 4 and {r["lang"] for r in got} <= {"de", "en"}
    assert {r["lang"] for r in got if r["page_id"] == 2} == {"de"}
    assert language.identify(pages.limit(0), docs).count() == len(ROWS)
    assert {r["lang"] for r in language.identify(pages, docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}
    assert language.identify(pages, empty).count() == 4


def test_stages_keep_the_columns(spark, docs, empty, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, empty):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == corpus_pipeline.COLUMNS
        last = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert last.columns == [*corpus_pipeline.COLUMNS, "shard", "slot"]


def test_words(spark):
    df = spark.createDataFrame([(None,), ("",), (" \x0b ",), ("a\x1cb c d",)], "t string")
    assert [r[0] for r in df.select(common.n_words(F.col("t"))).collect()] == [0, 0, 0, 2]
    assert [r[0] for r in df.select(F.size(common.words(F.col("t")))).collect()] == [0, 0, 0, 2]
