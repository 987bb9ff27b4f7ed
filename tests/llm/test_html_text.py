import html
import itertools
import os
import random
import re

import numpy as np
import pytest

from paneloom.llm import html_text as ht, queries

SF = "/root/testdata/sf0.001"


def test_blocks():
    page = ("<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><script>var t='</p>';</script><ul id=\"Top-menu\"><li>a<li>b</ul>"
            "<p>One &amp;amp; two<b>bold</b>\n  three<br>four&nbsp;<p class='x y'>A <a href='>'>li nk</a></div></p>5 < 6<!-- <p>no</p> --> z<p></p><table><tr><td>c<td>d</table><textarea>no")
    got = ht.blocks(page)
    assert [(b[0], b[2]) for b in got] == [("a", "li"), ("b", "li"), ("One &amp; twobold three four", "p"), ("A li nk", "p"), ("5 < 6 z", "body"), ("c", "td"), ("d", "td")]
    assert got[0][3] == {"html", "body", "ul", "top", "menu", "li"} and got[3][3] == {"html", "body", "p", "x", "y"}
    assert got[3][1] == pytest.approx(5 / 7) and got[4][1] == 0
    assert ht.blocks("") == ht.blocks("<p>") == ht.blocks("<!-- x") == ht.blocks("<script>p") == []


def random_field(seed=1, n=6):
    rng = np.random.default_rng(seed)
    pages = [([rng.integers(0, 12, 3) for _ in range(k)], list(map(bool, rng.integers(0, 2, k)))) for k in rng.integers(1, 8, n)]
    w = np.zeros((2, ht.SIZE))
    w[:, :12] = rng.normal(size=(2, 12))
    return pages, (w, rng.normal(size=(2, 2)), rng.normal(size=2))


def score(model, feats, y):
    w, t, s = model
    return s[y[0]] + sum(w[c][f].sum() for f, c in zip(feats, y)) + sum(t[a, b] for a, b in zip(y, y[1:]))


def test_likelihood_and_decoding_against_all_labellings():
    pages, model = random_field()
    value, _ = ht.likelihood(*model, ht.packed_pages(pages))
    want = 0
    for f, y in pages:
        every = {z: score(model, f, z) for z in itertools.product((0, 1), repeat=len(f))}
        want += score(model, f, [int(v) for v in y]) - np.logaddexp.reduce(list(every.values()))
        assert ht.decode(model, f) == list(max(every, key=every.get))
    assert value == pytest.approx(want)


def test_gradient():
    pages, model = random_field(3)
    data = ht.packed_pages(pages)
    _, grads = ht.likelihood(*model, data)
    for p, g, where in zip(model, grads, ([(0, 3), (1, 7)], [(0, 1), (1, 1)], [(0,), (1,)])):
        for at in where:
            old, ends = p[at], []
            for step in (1e-5, -1e-5):
                p[at] = old + step
                ends.append(ht.likelihood(*model, data)[0])
            p[at] = old
            assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def seed_model():
    pages = ht.seeds()
    held = pages[::4]
    learnt = [(ht.features(f, x), y) for i, (f, y) in enumerate(pages) if i % 4 for x in (frozenset(), ht.MARKS, ht.MARKS | ht.ASIDE)]
    return ht.fit(learnt), held


def test_held_out_accuracy(seed_model):
    model, held = seed_model
    right = [a == b for f, y in held for a, b in zip(ht.decode(model, ht.features(f)), y)]
    assert np.mean(right) > 0.97


def test_pages_of_other_shapes(seed_model):
    model, _ = seed_model
    assert ht.text_of(model, "<html><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie'>We use cookies here.</div>"
                      "<div class=content><h1>Title</h1><p>First paragraph of the text, with some words.</p><p>Second one.</p></div>"
                      "<div class=comments><p>I like this article very much, thanks.</p></div><footer>&copy; 2020 me</footer></body></html>") == \
        "Title\nFirst paragraph of the text, with some words.\nSecond one."
    assert ht.text_of(model, "<article><h1>Head</h1><p>Para one of the story here.<div class='ad'>Buy this now.</div><p>Para two.</p>"
                      "<section class=comments><p>A comment from a reader, which goes on.</p></section></article><form><p>Your mail</p></form>") == \
        "Head\nPara one of the story here.\nPara two."


def test_odd_rows(spark, tmp_path):
    long = "<article>" + "<p>Some words of the text here.</p>" * 4000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", "x"), (4, "u", long, None), (4, "u", long, None), (5, "u", "<nav>Home</nav>", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op12_html_extraction(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = "\n".join(["Some words of the text here."] * 4000)
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "u", "", 0), (4, "u", text, len(text)), (4, "u", text, len(text)), (5, "u", "", 0)]
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert ht.extract(none, ht.train(none)).count() == 0


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_pages_whose_text_is_marked(spark):
    got = {r["page_id"]: r["text"] for r in queries.op12_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S).group(1)
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(p for p in parts if p)
