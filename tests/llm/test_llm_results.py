"""Operators against brute force, exact invariants, SQL or held-out labels, on whole small tables."""

import collections
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from test_near_copies import naive_keepers

import corpus_pipeline
from axisfold.llm import common, components, decontamination, html, language, lm_score, mixing, quality, queries, sharding, simhash, spans, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_quality_counts_and_list(spark, docs):
    def brute(text):
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)

    out = quality.op1_quality_rules(spark, SF)
    assert by_id(out, *quality.COUNTS) == {d: brute(t) for d, t in docs}
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_rules_find_planted_conjunctions(spark):
    rows = [(i, bool((i % 10 > 6 and i % 7 < 3) or i % 13 == 0), float(i % 10), float(i % 7), float(i % 13)) for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, bad boolean, a double, b double, c double")
    rules = quality.learn_rules(df, ["a", "b", "c"])
    got = df.withColumn("hit", quality.verdict(rules).isNotNull())
    assert got.where("hit <> bad").count() == 0 and 2 <= len(rules) <= 4
    first = df.withColumn("r", quality.verdict(rules)).where("r = 0").agg(F.min("bad")).first()[0]
    assert first is True


def test_learned_list_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.op1_quality_rules(spark, sf).join(common.table(spark, sf, "labels"), "doc_id")
    ok = judged.where("NOT base_failed").agg(F.avg(((F.col("quality") == 1) == F.col("kept")).cast("int"))).first()[0]
    assert ok > 0.97


def test_lm_scores_with_other_blocks(spark):
    docs = common.table(spark, SF, "documents")
    one = by_id(lm_score.lm_scores(docs), "n_words", "score")
    many = by_id(lm_score.lm_scores(docs, block_chars=20_000, partition_grams=5_000), "n_words", "score")
    assert one.keys() == many.keys() and all(one[d] == pytest.approx(many[d]) for d in one)


def test_rows_that_repeat_often_are_scored_once(spark):
    often = "the same short line of a page that is copied without end"
    rows = [(1, "a line of words that stands alone on the page")] + [(None, often)] * 57 + [(3, often)] * 9 + [(4, "the same short line")] * 2 + [(5, None)] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = lambda many: sorted((str(r[0]), r[1], round(r[2], 9)) for r in lm_scores_of(docs, many))
    plain = asked(1_000)
    assert len(plain) == len(rows) and plain == asked(8) == asked(1) == asked(10)


def lm_scores_of(docs, many):
    return lm_score.lm_scores(docs, many=many).select("doc_id", "n_words", "score").collect()


def test_squeeze_round_trip():
    x = np.array([0, 1, 254, 255, 256, 10**12, 0])
    assert (lm_score.unsqueeze(lm_score.squeeze(x)) == x).all()
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    for bits in (0, 3):
        for _, a, b in lm_score._slices(keys, bits):
            cut = (keys[a:b] << np.uint64(bits)) >> np.uint64(16)
            assert (lm_score.unpack(*lm_score.pack(keys[a:b], bits)) == cut).all()


def words(text):
    return re.findall(r"\w+", text.lower())


def least_edits(pattern, text):
    before = list(range(len(pattern) + 1))
    best = before[-1]
    for x in text:
        now = [0]
        for i, y in enumerate(pattern):
            now.append(min(before[i] + (x != y), before[i + 1] + 1, now[i] + 1))
        before, best = now, min(best, now[-1])
    return best


def test_decontamination_equals_brute_force(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    planted = [(10_000 + i, "before it " + " ".join(w for j, w in enumerate(words(t)) if j % 11 != 5) + " after it") for i, (_, t) in enumerate(items[:15])]
    planted += [(20_000 + i, "before it " + " ".join("changed" if j % 9 == 4 else w for j, w in enumerate(words(t))) + ".") for i, (_, t) in enumerate(items[:15])]
    some = [x for x in docs if len(words(x[1])) < 300][:40] + planted
    got = decontamination.matches(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {}
    for d, t in some:
        for i, item in items:
            p = words(item)
            e = least_edits(p, words(t))
            if len(p) >= 5 and e <= int(0.15 * len(p)):
                want[d, i] = e
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want
    texts, pats = dict(some), dict(items)
    for r in got:
        span = words(texts[r["doc_id"]])[r["first_word"] : r["first_word"] + r["n_words"]]
        assert least_edits(words(pats[r["item_id"]]), span) == r["distance"] and {*span} <= {*words(texts[r["doc_id"]])}
    assert len({d for d, _ in want} & {d for d, _ in planted}) == 30


SHORT_ITEMS = [(1, "Name the capital of France."), (2, "Who wrote Hamlet?"), (3, "Yes"), (4, "Boiling point of water"), (5, "..."), (6, "\u6cb3\u6c34\u6d41\u8fc7\u6751\u5e84\u7684\u65f6\u5019")]
SHORT_DOCS = [
    (1, "A quiz.\nWho  wrote hamlet\nThe answer comes later."),
    (2, "Those who know who wrote Hamlet say yes."),  # inside a line, as common speech
    (3, "boiling point of vater\nyes!"),  # one character of 22
    (4, "whom wrote Hamlet\nYess"),  # one of 17 characters; one of 3 is above the budget
    (5, "Boiling points of waters and oils"),
    (6, "\u4ece\u524d\u6cb3\u6c34\u6d41\u8fc7\u5c0f\u5e84\u7684\u65f6\u5019\uff0c\u5b69\u5b50\u4eec\u5728"),  # one letter of nine, inside a text
    (7, "Please name the capital of France. Now."),
    (8, ""),
]


def test_short_items_are_found_as_lines(spark):
    got = decontamination.matches(spark.createDataFrame(SHORT_DOCS, "doc_id long, text string"), spark.createDataFrame(SHORT_ITEMS, "item_id long, text string")).collect()
    want = {(1, 2): (0, 2, 3), (3, 4): (1, 0, 4), (3, 3): (0, 4, 1), (4, 2): (1, 0, 3), (6, 6): (1, 2, 9), (7, 1): (0, 1, 5)}
    assert {(r["doc_id"], r["item_id"]): (r["distance"], r["first_word"], r["n_words"]) for r in got} == want
    left = decontamination.decontaminated(spark.createDataFrame(SHORT_DOCS, "doc_id long, text string"), spark.createDataFrame(SHORT_ITEMS, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {2, 5, 8}


def whole_edits(a, b):
    before = list(range(len(a) + 1))
    for j, x in enumerate(b, 1):
        now = [j]
        for i, y in enumerate(a):
            now.append(min(before[i] + (x != y), before[i + 1] + 1, now[i] + 1))
        before = now
    return before[-1]


def test_short_items_equal_brute_force():
    draw = np.random.default_rng(4)
    some = ["alpha", "alfa", "beta", "betas", "gamma", "gama", "delta"]
    line = lambda: " ".join(draw.choice(some, draw.integers(1, 5)))
    items = [(i, line()) for i in range(60)]
    matcher = decontamination.Matcher(items, 0.15, 5)
    for _ in range(40):
        lines = [line() for _ in range(draw.integers(1, 6))]
        want = {}
        for i, item in items:
            d = min(whole_edits(item, x) for x in lines)
            if d <= int(0.15 * len(item)):
                want[i] = d
        assert {i: d for i, d, *_ in matcher.find("\n".join(lines))} == want


def test_item_blocks_change_nothing(spark):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    one = {tuple(r) for r in decontamination.matches(docs, items).collect()}
    many = {tuple(r) for r in decontamination.matches(docs, items, block_chars=2_000).collect()}
    assert one == many
    left = {r["doc_id"] for r in decontamination.decontaminated(docs, items, block_chars=2_000).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {d for d, *_ in one}


def test_mix_comes_near_its_targets(spark):
    got = mixing.op4_mixing(spark, SF).collect()
    docs = common.table(spark, SF, "documents").select("doc_id", "source").collect()
    source = {r["doc_id"]: r["source"] for r in docs}
    taken, target, largest, size = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 and target[s] <= 3 * size[s] + 1e-6


def test_main_text(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body class="article"><header>no</header><nav><a>no</a></nav><script>var t="</p>";</script>
    <div class="cookie-banner">no</div><div class="sidebar"><p>no no no no no no no no no no no no</p></div>
    <article class="post"><h1>Yes&nbsp;&amp; title</h1><p>First <b>bold<br>line</b>   of text.<p>Second.<div class="advert">no</div><p>Third</p></article>
    <section id="comments"><p>no, a long comment of a reader that goes on and on for a while</p></section><form>no<input></form><footer>no</footer>"""
    rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert html.main_text(rows).first()["main_blocks"] == ["Yes & title", "First bold line of text.", "Second.", "Third"]


#: Blocks of the main text begin with +, others with -.
LAYOUTS = [
'''<body><div id="header"><h1>-Site name</h1></div><div id="main"><h1>+Head</h1><p>+Some words here in the text.</p><p>+Ok.</p><div class="share-buttons">-Share this</div><table><tr><td>+Cell one</td><td>+Cell two</td></tr></table><pre>+code   line</pre></div><div id="footer">-foot note here with many words that go on and on for a while</div>''',
'''<div class="container"><div class="row"><div class="col-8"><h2>+Heading of it</h2><p>+A long paragraph with many words in it that clearly is the main text of this page and nothing else at all.</p><p>+Short one.</p><p>+Another long paragraph with many words in it that clearly is the main text of this page and nothing else.</p></div><div class="col-4 widget"><p>-Widget text with some words in it that should go away from here.</p></div></div></div>''',
'''<ul class="nav-menu"><li><a href="/">-Home</a></li></ul><p>+Paragraph one has quite a few words so that it can be seen as content by anyone.</p><p>+Paragraph two has quite a few words so that it can be seen as content by anyone.</p><p class="copyright">-© 2020 Someone</p>''',
'''<html><body><article class="post comments-open"><h1>+T</h1><p>+Text with <a href="x">link one</a>.</p></article><div class="comment-list"><article class="comment"><p>-Nice post, I liked it very much indeed.</p></article></div></body></html>''',
'''<html><body class="page nav-open"><main role="main"><section><h2>+A</h2><p>+b</p></section><aside>-side</aside><section class="related-posts">-rel</section></main><div role="complementary">-side too</div><noscript>-ns</noscript><template>-tpl</template></body></html>''',
'''<html><body><header class="site-header"><p>-Site</p></header><article><header><h1>+Title</h1></header><p>+x<sup>2</sup> &lt;tag&gt; &#8212; &eacute;</p><figure><img src=x><figcaption>+Caption</figcaption></figure><footer>-by author</footer></article><div class="ad-slot">-Buy now</div><div id="cookie-consent">-We use cookies</div></body></html>''',
'''<html><body><nav>-Menu</nav><div class="notice">-Notice: this site is moving soon.</div><article><h1>+Head line</h1><p>+First.<p>+Second.<div class="ad">-Buy</div><p>+Third</article><div class="sidebar">-Side words in a long list that goes on for quite some time, you see.</div><div class="comments"><h3>-Comments</h3><p>-I agree with it all, thanks for it.</p></div><form><label>-Name</label><input><button>-Send</button></form><footer>-foot</footer></body></html>''',
]

LAYOUTS += [
'''<body class="has-sidebar"><div id="page" class="content-sidebar-wrap"><form action="/"><article><h1>+Head</h1><p>+A text of some words.</p></article></form></div><div class="sidebar">-Side</div>''',
'''<article><h1>+Out to eat</h1><div class="menu"><p>+They served a soup of green peas with mint, then lamb with beans from the garden behind the house, and we ate all of it.</p></div></article>''',
'''<div class="post"><h1>+On walls</h1><p>+A wall of dry stone needs no mortar, only time and the patience to turn each stone until it lies as if it had grown there.</p><ul><li><a href="a">-Older posts</a></li><li><a href="b">-Newer posts by month</a></li></ul></div>''',
'''<div class="x1">-This site uses cookies to count its visitors. By reading on you agree.</div><div><a href="a">-Agree</a></div><div><a href="b">-Settings</a></div><div class="x2"><h1>+The well</h1><p>+The well had been dug by hand through forty feet of clay, and the water in it was so cold that it hurt to drink.</p><p>+Nobody has used it since the pipes came, but the lid is still lifted once a year to see whether the water is there.</p></div><div class="x3"><p>-2 comments</p><p>-Ole</p><p>-We had one just like it at home, with a bucket on a chain.</p><p><a href="r">-Reply</a></p><p>-Ann</p><p>-Thank you, that was a nice thing to read.</p><p><a href="r">-Reply</a></p></div>''',
]


LAYOUTS += [
"<ul><li><a>-\u9996\u9875</a></li><li><a>-\u5173\u4e8e\u6211\u4eec</a></li></ul><p>+" + "\u6cb3\u6c34\u6d41\u8fc7\u6751\u5e84\u7684\u65f6\u5019\u5b69\u5b50\u4eec\u90fd\u5728\u5cb8\u8fb9\uff0c" * 4 + "</p><p>+" + "\u51ac\u5929\u6765\u4e34\u4ee5\u540e\u6ca1\u6709\u4eba\u518d\u53bb\u90a3\u5ea7\u6865\u4e0a\u3002" * 5 + "</p>",
"<h1>+A short notice</h1><p>+Closed today.</p>",
'<div class="nav-menu"><a>-Home</a></div><h1>+Closed</h1><p>+Back soon.</p><div class="page-footer">-Imprint</div>',
'''<div class="notice-content"><p>-Our shop will be closed for the whole of next week because of works on the roof, we ask for your patience.</p></div><div class="entry"><div class="entry-header"><h1>+The long field</h1></div><p>+The field runs from the road down to the stream, and no one living remembers a year in which it was not under wheat.</p><p>+This spring it was sown with flax, which stood blue for a week in June and was the talk of three villages.</p></div><div class="footer-content"><p>-All that stands on these pages may be printed once by each reader for use at home and not otherwise.</p></div>''',
'''<nav><a>-Only</a> <a>-links</a></nav><footer>-Imprint</footer>''',
]


def test_words_of_any_script():
    assert [html.n_words(x) for x in ("", "one  two", "\u6cb3\u6c34\u6d41", "a \u6cb3\u6c34 b", "na\u00efve caf\u00e9")] == [0, 2, 2, 3, 2]


def test_clashing_columns_of_pages(spark):
    rows = spark.createDataFrame([(1, "<article><p>Text</p></article>", "own")], "page_id long, html string, words string")
    assert html.main_text(rows).select("words", "main_blocks").first() == ("own", ["Text"])


def test_layouts(spark):
    rows = spark.createDataFrame(list(enumerate(LAYOUTS)), "page_id long, html string")
    for r in html.main_text(rows).collect():
        cut = html.page_blocks(LAYOUTS[r["page_id"]])
        assert r["main_blocks"] == [b[0] for b in cut if b[0].startswith("+")] and all(b[0][0] in "+-" for b in cut)


def test_main_text_of_all_pages(spark):
    import html as entities

    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.op5_html_extraction(spark, SF).collect()}
    for i, h in pages:
        body = h.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", body)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[i] == (want, len(want))


def test_tree_fits_its_table(spark):
    tree = html.train_tree(spark)

    def walk(node, x):
        while isinstance(node, tuple):
            node = node[2] if x[html.FEATURES.index(node[0])] <= node[1] else node[3]
        return node

    table = html.labelled_table()
    assert np.mean([walk(tree, r[1:]) == r[0] for r in table]) > 0.97 and len(table) > 300
    used = re.findall(r"'(\w+)'", repr(tree))
    assert {"words", "beside", "article"} <= set(used) and any(f.startswith(("words_", "density_", "link_")) for f in used)


def naive_components(fps, radius=3):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash_equals_brute_force(spark, docs):
    def fingerprint(text):
        w = text.encode().lower().split()
        shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = {d: fingerprint(t) for d, t in docs}
    got = by_id(simhash.op6_simhash(spark, SF), "fingerprint", "component_id")
    want = naive_components(fps)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_links_with_many_shards(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**63, 400, dtype=np.int64)
    points = list(base)
    for p in base[:200]:
        q = int(p)
        for _ in range(4):
            for b in draw.choice(63, 3, replace=False):
                q ^= 1 << int(b)
            points.append(q)
    points = sorted(set(map(int, points)))
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(df, shard_size=60)).collect()}
    want = naive_components({i: p & (2**64 - 1) for i, p in enumerate(points)})
    assert {i: got.get(p, p) for i, p in enumerate(points)} == {i: points[r] for i, r in want.items()}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(7, 7), (300, 2), (2, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 260)} == {5} and got[300] == 2 and 7 not in got


def test_one_of_each_group_stays(spark):
    docs = common.table(spark, SF, "documents")
    comp = by_id(simhash.near_duplicates(docs), "component_id")
    assert sorted(r["doc_id"] for r in simhash.without_copies(docs).collect()) == sorted(set(comp.values()))


def test_spans_equal_brute_force(spark, docs):
    def pieces(text):
        """Sentences as lists of words, in plain words: ends of lines, marks, and pairs of words by their hash."""
        out, before = [], None
        for line in text.split("\n"):
            fresh = True
            for w in line.split():
                ends = bool(re.search(r"[.!?…。！？][\"'”’»)\]」』）]?$", w))
                code = xxhash.xxh64_intdigest(w.encode()) >> 1 << 1 | ends
                x = ((before or 0) * 0x9E3779B97F4A7C15 + code) % 2**64
                x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
                if fresh or before & 1 or (x ^ x >> 32) % 6 == 0:
                    out.append([])
                out[-1].append(w)
                fresh, before = False, code
        return out

    first, want = {}, {}
    for d, t in docs:
        own = pieces(t)
        for i in range(len(own)):
            for n in range(2, len(own) - i + 1):
                run = tuple(w for p in own[i : i + n] for w in p)
                if len(run) >= 20:
                    if run in first:
                        gone, origins = want.setdefault(d, (set(), set()))
                        gone.update(range(i, i + n))
                        origins.add(first[run])
                    else:
                        first[run] = d
                    break
    got = {r["doc_id"]: (set(r["removed"]), set(r["first_docs"])) for r in spans.op7_substring_dedup(spark, SF).collect()}
    assert got == want and len(want) > 5


def test_a_planted_passage_is_cut(spark):
    passage = "The mill stood by the river for two hundred years. Then it was sold, and the new owner took the wheel away. Nobody knew what for, since the wheel was of no use to anyone else. The walls are still there and so is the pond behind them. Children swim in it."
    other = ["Alpha beta gamma delta.", "Nothing of this is anywhere else."]
    rows = [(1, f"{other[0]} {passage} End one."), (2, f"Middle of a thought {passage}\n{other[1]}"), (3, " ".join(other))]
    got = {r["doc_id"]: r for r in spans.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert list(got) == [2] and got[2]["first_docs"] == [1] and len(got[2]["removed"]) >= 4 and len(spans.without_repeats(spark.createDataFrame(rows, 'doc_id long, text string')).where('doc_id = 2').first()['text'].split()) < 24


def test_shards(spark, docs):
    got = sharding.op8_sharding(spark, SF).collect()
    n = collections.Counter(r["shard"] for r in got)
    assert len(n) == 40 and max(n.values()) - min(n.values()) <= 1
    slots = collections.defaultdict(list)
    texts = dict(docs)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = sharding.op8_sharding(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_communication_matrix():
    sizes = [100, 0, 37, 250]
    m = sharding.communication_matrix(sizes, 6, 3)
    assert m.sum(axis=1).tolist() == sizes and sorted(set(m.sum(axis=0))) in ([64, 65], [65]) and (m >= 0).all()
    draws = np.array([sharding.communication_matrix([30, 70], 2, s)[0, 0] for s in range(4000)])
    assert draws.mean() == pytest.approx(15, abs=0.15) and draws.var() == pytest.approx(30 * 0.5 * 0.5 * 70 / 99, rel=0.1)


@pytest.mark.parametrize("good, bad, sample", [(3, 5, 4), (1, 30, 2), (40, 2, 39), (700, 300, 100), (5, 0, 3), (0, 5, 3)])
def test_hypergeometric_law(good, bad, sample):
    ways = [math.comb(good, k) * math.comb(bad, sample - k) for k in range(sample + 1)]
    upto = np.cumsum([w / sum(ways) for w in ways])

    class Fixed:
        def random(self):
            return u

    for u in np.random.default_rng(1).random(500):
        k = sharding.hypergeometric(Fixed(), good, bad, sample)
        assert ways[k] and u < upto[k] + 1e-9 and (k == 0 or u >= upto[k - 1] - 1e-9)


def test_matrix_of_very_many_rows():
    sizes = [10**10] * 200
    m = sharding.communication_matrix(sizes, 8, 2)
    assert m.sum(axis=1).tolist() == sizes and len(set(m.sum(axis=0).tolist())) == 1
    share = 10**10 / 8
    sd = math.sqrt(share * 7 / 8 * (1 - 1 / 200))
    z = (m - share) / sd
    assert abs(z.mean()) < 1e-6 and z.std() == pytest.approx(1, abs=0.07) and np.abs(z).max() < 5


def test_many_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 10)
    monkeypatch.setattr(sharding, "RANGE", 7)
    df = spark.range(500).select(F.when(F.col("id") < 300, -1).otherwise(F.col("id")).alias("x"))
    got = sharding.shard_rows(df, 5, seed=3).collect()
    assert sorted(r["x"] for r in got) == [-1] * 300 + list(range(300, 500))
    assert {(r["shard"], r["slot"]) for r in got} == {(s, k) for s in range(5) for k in range(100)}
    rows = sharding._numbered(df.select(F.struct("x").alias("row"), F.xxhash64("x").alias("first"), F.xxhash64(F.lit(1), "x").alias("second"))).collect()
    assert sorted(r["copy"] for r in rows if r["row"]["x"] == -1) == list(range(300))


def test_shuffle_is_uniform(spark):
    df = spark.range(4000).withColumn("x", F.col("id"))
    got = sharding.shard_rows(df, 5, seed=3, rows_per_block=300, min_blocks=4).collect()
    cells = collections.Counter((r["id"] // 1000, r["shard"]) for r in got)
    assert all(abs(c - 200) < 60 for c in cells.values())
    halves = collections.Counter((r["id"] < 2000, r["slot"] < 400) for r in got)
    assert all(abs(c - 1000) < 110 for c in halves.values())


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op9_toxicity(spark, sf)
    held = got.where("held_out").join(common.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").collect()
    y, s = np.array([r["toxic"] for r in held]), np.array([r["score"] for r in held])
    order = np.argsort(np.argsort(s))
    p = y.sum()
    assert (order[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p)) > 0.95
    assert ((s - y) ** 2).mean() < 0.04 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)


def test_block_max_search_is_exact(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    models = toxicity.fit(docs, labels)
    word = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower() if (t or "").isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {}
    for r in labels.where("toxic IS NOT NULL").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5:
            known[texts[r["doc_id"]]] = max(known.get(texts[r["doc_id"]], 0), r["toxic"])
    fold = lambda t: toxicity.body_of(t) % 3

    def model(k):
        """Vectors of a model's examples, and the way to make one."""
        told = {t: y for t, y in known.items() if fold(t) == (k + 1) % 3}
        mine = {t: y for t, y in known.items() if fold(t) != k}
        df, told_df = (collections.Counter(w for t in x for w in set(word(t))) for x in (mine, told))
        hits, share = collections.Counter(w for t, y in told.items() if y for w in set(word(t))), sum(told.values()) / len(told)

        def vector(text):
            counts, out = collections.Counter(word(text)), {}
            for w, c in counts.items():
                if df[w] >= 2:
                    e = told_df[w] * share
                    out[w] = (1 + math.log(c)) * math.log(1 + len(mine) / df[w]) * max(abs(hits[w] - e) / math.sqrt(max(e, 1e-9)), 1e-3)
            size = math.sqrt(sum(x * x for x in out.values()))
            return {w: x / size for w, x in out.items()}

        return vector, [(t, vector(t)) for t in mine]

    by_fold = [model(k) for k in range(3)]
    for d in sorted(texts)[:120]:
        vector, vectors = by_fold[fold(texts[d])]
        own = vector(texts[d])
        want = sorted((sum(x * v.get(w, 0.0) for w, x in own.items()) for t, v in vectors), reverse=True)[: toxicity.NEIGHBOURS]
        got = models.neighbours(texts[d])
        assert [c for c, _ in got] == pytest.approx([c for c in want if c > 1e-9], abs=1e-9)
        assert all(fold(texts[int(models.ids[i])]) != fold(texts[d]) and models.labels[i] == known[texts[int(models.ids[i])]] for _, i in got)


def _made_labels(spark):
    rows = [(i, f"word{i % 7} other{i % 3} thing{i % 5} {'bad' if i % 4 == 0 else 'fine'} end{i}") for i in range(1, 60)]
    docs = spark.createDataFrame(rows + [(100 + i, t) for i, t in rows[:20]], "doc_id long, text string")
    return rows, docs, {i: int(i % 4 == 0) for i, _ in rows}


def _scores(spark, docs, labels):
    return by_id(toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))), "score")


def test_labels_of_a_text_are_not_used_for_it(spark):
    """Its score stays exactly as it is when its own label, and nothing else, is turned; the scores of others move."""
    rows, docs, labels = _made_labels(spark)
    got = _scores(spark, docs, labels)
    assert all(got[i] == got[100 + i] for i, _ in rows[:20])
    for i in (4, 5, 8, 21):
        turned = _scores(spark, docs, labels | {i: 1 - labels[i]})
        assert turned[i] == got[i] and any(turned[k] != got[k] for k in got)


def test_many_texts_of_one_id_are_bounded(spark):
    docs = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("same words and "), (F.col("id") % 300).cast("string")).alias("text"))
    models = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), max_examples=50)
    assert len(models.ids) == 50 and (models.scale > 0).sum() <= 2 * 50


def test_language_of_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op10_language_id(spark, sf)
    truth = common.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("truth"))
    assert got.where("doc_id IS NOT NULL").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("truth")).cast("int"))).first()[0] > 0.99
    pages = got.where("page_id IS NOT NULL")
    assert pages.agg(F.avg((F.col("lang") == F.col("declared")).cast("int"))).first()[0] > 0.99


def test_language_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language, "RUN_BYTES", 64)
    docs = [(i, t, l, s) for i, (t, l, s) in enumerate([("the old man and the sea", "en", "a"), ("der alte Mann und das Meer", "de", "b"), ("the house, the hill", "en", "b"), ("das Haus und der Berg " * 9, "de", "a"), ("", "de", "a"), (None, None, "b"), ("42", "en", None)])]
    pages = [(1, "http://x.example.de/1", "<html lang=de><p>das Meer"), (2, "http://y.example.de/1", "<p>the hill"), (3, None, "<p>und"), (4, "http://x.example.de/2", None)]
    langs = ["de", "en"]

    def slots(text):
        line = " " + " ".join(re.sub("[^a-z]", " ", (text or "").lower()).split()) + " "
        return [(a << 16 | b << 8 | c) * 2654435761 % 2**32 >> 18 for a, b, c in zip(line.encode(), line.encode()[1:], line.encode()[2:])]

    model = {}
    for lang in langs:
        n = collections.Counter(x for _, t, l, _ in docs if l == lang for x in slots(t))
        total = sum(n.values()) + 0.5 * language.SLOTS
        model[lang] = lambda x, n=n, total=total: math.log((n[x] + 0.5) / total)

    def posterior(text):
        own = slots(text)
        z = [sum(map(model[l], own)) * min(1, language.EFFECTIVE / max(len(own), 1)) for l in langs]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    rows = [("d", i, posterior(t), None, None, s and f"source:{s}", s and f"source:{s}") for i, t, _, s in docs]
    for i, url, h in pages:
        host = url and url.split("/")[2]
        rows.append(("p", i, posterior(re.sub("<[^>]*>", " ", h or "")), "de" if "lang=de" in (h or "") else None, host and "de", host and "example.de", host))
    whole = [sum(r[2][k] for r in rows) for k in (0, 1)]
    want = {}
    for r in rows:
        others = lambda at, k: max(sum(q[2][k] for q in rows if q[at] == r[at]) - r[2][k], 0)  # noqa: B023, E731
        prior = [(whole[k] - r[2][k] + 1) / (sum(whole) - 1 + 2) for k in (0, 1)]
        for at in (5, 6):
            if r[at]:
                prior = [(others(at, k) + 5 * prior[k]) / (others(at, 0) + others(at, 1) + 5) for k in (0, 1)]
        z = [math.log(r[2][k]) + math.log(prior[k]) for k in (0, 1)]
        for at in (3, 4):
            if r[at]:
                share = (others(at, 0) + others(at, 1) + 0.5) / (sum(whole) + 1)
                z = [z[k] + math.log((others(at, k) + 5 * share) / (max(whole[k] - r[2][k], 0) + 5)) for k in (0, 1)]
        p = 1 / sum(math.exp(x - max(z)) for x in z)
        want[r[0], r[1]] = (langs[z.index(max(z))], pytest.approx(p, abs=1e-4))
    got = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    assert {("d", r["doc_id"]) if r["page_id"] is None else ("p", r["page_id"]): (r["lang"], r["probability"]) for r in got.collect()} == want


def test_host_prior_decides_short_pages(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    long_de = docs.where("lang = 'de'").limit(30).select(F.col("doc_id").alias("page_id"), F.lit("http://a.example.de/1").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    blank = spark.createDataFrame([(-1, "http://a.example.de/2", "<p>12"), (-2, None, "<p>12")], "page_id long, url string, html string")
    got = {r["page_id"]: r["lang"] for r in language.identify(long_de.unionByName(blank), docs).where("page_id < 0").collect()}
    assert got[-1] == "de"


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents")
    kept = {r["doc_id"] for r in quality.judge_documents(docs, common.table(spark, SF, "labels")).where("kept").collect()}
    first = naive_keepers([(r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isin(*kept)).collect()])
    hit = {r["doc_id"] for r in decontamination.matches(docs, common.table(spark, SF, "benchmark")).collect()}
    left = set(first) - hit
    copies = by_id(mixing.mix_documents(docs.where(F.col("doc_id").isin(*left))), "copies")
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter({d: c for d, c in copies.items() if c})
    n = collections.Counter(r["shard"] for r in got)
    assert max(n.values()) - min(n.get(s, 0) for s in range(40)) <= 1
