"""Parsing of odd markup, gradients, and the text of whole tables and unseen forms."""

import html as entities
import random
import re

import numpy as np

from noticeflow.llm import html
from noticeflow.llm.queries import op9_html_extraction

D = "/root/testdata/sf0.01"


def article(page):
    s = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    s = re.sub(r"<(br|/?p|/?h\d)[^>]*>", " ", re.sub(r"<!--.*?-->", "", s, flags=re.S))
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", s)).split())


def test_blocks_of_odd_markup():
    page = "<p>a<b>b</b> &amp; c<br>d<p>e <script>x</p></script><ul><li><a href=/>l</a><li>m</ul><!-- <p>no --><div class='ad x'>n</b>o</div>p &lt;q> < r</z>"
    got = html.blocks(page)
    assert [b.text for b in got] == ["ab & c d", "e", "l", "m", "no", "p <q> < r"]
    assert got[2].path == ("ul", "li", "a") and got[2].linked == 1 and got[4].path == ("div", ".ad", ".x")
    assert html.blocks(None) == html.blocks("") == html.blocks("<p></p> \n") == []


def test_gradients():
    rng = np.random.RandomState(0)
    net = html.Labeller(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.randn(5, 3, html.PATH + html.WORDS + html.NUMBERS), np.ones((5, 3, 1), bool)
    mask[3:, 1] = False
    y = (rng.rand(5, 3) > 0.5).astype(float)
    loss, grad = net.gradients(x, mask, y)
    for k in net.p:
        at = tuple(rng.randint(n) for n in net.p[k].shape)
        net.p[k][at] += 1e-3
        up, _ = net.gradients(x, mask, y)
        net.p[k][at] -= 2e-3
        down, _ = net.gradients(x, mask, y)
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-3 * max(1, abs(grad[k][at])) + 2e-4, k


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    out = op9_html_extraction(spark, D).collect()
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in out)
    assert sum(r.text == article(pages[r.page_id].html) for r in out) >= 0.99 * len(out)


def test_unseen_pages_and_odd_rows(spark):
    rng = random.Random(2)
    pages = [r.html for r in spark.read.parquet(f"{D}/pages.parquet").collect()]
    net = html.train(pages[:120])
    ok = blocks = 0
    for page in pages[120:]:
        varied = html._varied(html.blocks(page), rng)
        want = [bool(html._teacher(b.path)) for b in varied]
        got = html.label(net, [varied])[0]
        ok, blocks = ok + sum(a == b for a, b in zip(want, got)), blocks + len(want)
    assert ok >= 0.97 * blocks
    df = spark.createDataFrame([(1, "u", None, "t"), (2, None, "", "t"), (None, "v", pages[0], "t"), (None, "v", pages[0], "t")], "page_id long, url string, html string, text string")
    rows = html.extract(df, net).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in rows) == [(0, True), (0, True), (1, False), (2, False)]
    assert html.extract(df.limit(0), html.fit(df.limit(0))).count() == 0
