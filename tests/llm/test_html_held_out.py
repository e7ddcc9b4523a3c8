"""Extraction on pages that no training saw, and against a plain version of it."""

from html.parser import HTMLParser

from held_out_pages import PAGES

from axisfold.llm import html


def share(found, of):
    return sum(found) / max(1, sum(of))


def test_precision_and_recall_on_pages_not_trained_on(spark):
    rows = spark.createDataFrame(list(PAGES.items()), "name string, html string")
    good, kept = [], []
    for r in html.main_text(rows).collect():
        texts = [b[0] for b in html.page_blocks(PAGES[r["name"]])]
        assert len(set(texts)) == len(texts) and all(t[0] in "+-" for t in texts)
        good += [t[0] == "+" for t in texts]
        kept += [t in r["main_blocks"] for t in texts]
        assert r["main_blocks"] == [t for t in texts if t in r["main_blocks"]]
    both = [a and b for a, b in zip(good, kept, strict=True)]
    assert len(good) > 100 and share(both, kept) >= 0.9 and share(both, good) >= 0.9
    trained = "".join(html.PAGES)
    assert not any(t[1:] in trained for page in PAGES.values() for t, *_ in html.page_blocks(page) if len(t) > 30)


class Cutter(HTMLParser):
    """Blocks of a well-formed page, by the standard parser: text, words in links, and the elements around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.open = [], [], []

    def flush(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            n = len(text.split())
            self.out.append((text, n, min(n, sum(len(t.split()) for t, linked in self.parts if linked))))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in html.INLINE:
            self.flush()
        if tag not in html.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.flush()
        assert self.open.pop() == tag

    def handle_data(self, data):
        if not html.SKIPPED & {*self.open}:
            self.parts.append((data, "a" in self.open))


def test_blocks_and_tree_equal_a_plain_version(spark):
    tree = html.train_tree(spark)
    pages = {k: v.replace("<br>", " ") for k, v in PAGES.items() if v.isascii()}
    rows = spark.createDataFrame(list(pages.items()), "name string, html string")
    got = {r["name"]: r["main_blocks"] for r in html.main_text(rows, tree=tree).collect()}
    for name, page in pages.items():
        cutter = Cutter()
        cutter.feed(page)
        cutter.flush()
        cut = html.page_blocks(page)
        assert [b[:3] for b in cut] == cutter.out
        want = []
        for i, (text, *_, beside, article) in enumerate(cut):
            x = {"beside": beside, "article": article}
            for at, step in {"": 0, **{f"_{k}": v for k, v in html.NEIGHBOURS.items()}}.items():
                _, n, linked = cutter.out[i + step] if 0 <= i + step < len(cut) else ("", 0, 0)
                x["words" + at], x[("density" if at else "link_density") + at] = n, linked / n if n else 0.0
            node = tree
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            if node == 1.0:
                want.append(text)
        assert want and got[name] == want
