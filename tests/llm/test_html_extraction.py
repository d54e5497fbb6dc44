"""Main texts: markup, differences between neighbouring pages, and alignments against a plain table."""

import random
import re

import numpy as np
import pytest

from linkscore.llm import html_extraction as H
from linkscore.llm.page_lines import AWAY, lines_and_roles, words_of

SCHEMA = "page_id long, url string, html string, text string, host string, lost string"


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("table", [1 << 24, 1])
def test_alignment_against_a_plain_table(monkeypatch, table):
    monkeypatch.setattr(H, "TABLE_BYTES", table)
    rng = random.Random(3)
    for _ in range(300):
        a, b = (rng.choices("abcdef"[: rng.randint(1, 6)], k=rng.randint(0, 25)) for _ in range(2))
        found = H.common_lines(a, b)
        assert len(found) == plain_lcs(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))
        sides = H.shared_lines(a, b)
        assert sides[0].sum() == sides[1].sum() == plain_lcs(a, b)


def text_of(html):
    lines, roles = lines_and_roles(html)
    return "\n".join(t for t, r in zip(lines, roles) if r != AWAY)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; all", "no markup & all"),
        ("<p>one<p>two <b>bold<br>three</p>tail", "one\ntwo bold three\ntail"),
        ("<nav>menu</nav><article><h1> A&nbsp;&lt;b&gt; </h1><p>x\n\t y</article><footer>f", "A <b>\nx y"),
        ("<article><header><h1>T</h1></header><p>a</p><aside>beside</aside><p>b<footer>f</footer></article>", "T\na\nb"),
        ('<article>a<section class="comments"><p>me too</section><div id="cookieNotice">c</div></article>', "a"),
        ('<article>a</article><article class="comment">b</article>', "a"),
        ('<body class="has-sidebar no-comments"><p>text</p><div class="post-related">x</div></body>', "text"),
        ('<header>site</header><main><p>a<form><p>send</form><p hidden>h</p><p>b</main>other', "a\nb"),
        ('<div id=content><p>a</div><div class="ad">b</div><p>c', "a"),
        ("<title>t</title><script>var a='</p>';</script><style>p{}</style><template><p>x</template><p>y", "y"),
        ("<!-- <p>c --><![CDATA[x]]><!DOCTYPE html><p>a</b></i></div>b</p>c", "a\nb\nc"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\nc\nd\n1\n2\n3"),
        ("<p>a <span class='share'>Share</span> b</p>", "a Share b"),
        ("<script>never ends <p>x", ""),
        ("<article>&amp &am &#x41;&#0;&copy; é日🙂", "& &am A�© é日🙂"),
    ],
)
def test_lines_of_markup(html, text):
    assert text_of(html) == text


def test_words_of_names():
    assert words_of("postNav adBox has-sidebar-left HTMLMenu") == ["post", "nav", "ad", "box", "has", "left", "html", "menu"]


def page(host, path, lines, article=False):
    body = "".join(f"<div>{x}</div>" for x in lines)
    return (f"http://{host}{path}", f"<html><body>{'<article>' * article}{body}{'</article>' * article}</body></html>")


def test_neighbours_lose_shared_lines(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_PAGES", 4)
    monkeypatch.setattr(H, "HOST_PAGES", 20)
    monkeypatch.setattr(H, "TASK_PAGES", 5)
    rows, wanted = [], []
    for h, n in (("a.com", 90), ("B.org", 7), ("solo.net", 1)):
        for i in range(n):
            own = [f"{h} story {i} line {k}" for k in range(3)]
            rows.append(page(h, f"/s/{i:03}", ["Home", "News", *own, "Imprint"]))
            wanted.append("\n".join(own if n > 1 else ["Home", "News", *own, "Imprint"]))
    # Copies tell nothing; articles stay as they are; pages without host are not paired.
    for i in range(3):
        rows.append(page("copy.com", f"/{i}", ["same", "text"]))
        wanted.append("same\ntext")
        rows.append(page("art.com", f"/{i}", ["quoted", f"own {i}"], article=True))
        wanted.append(f"quoted\nown {i}")
        rows.append((None, "<div>x</div><div>y</div>"))
        wanted.append("x\ny")
    rows = [(None if i % 9 == 0 else i, u, h, "clash", "clash", "clash") for i, (u, h) in enumerate(rows)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = H.main_texts(pages).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in out), key=key) == sorted(((r[0], r[1], t) for r, t in zip(rows, wanted)), key=key)


def test_query(spark, tmp_path):
    """The generated pages: their articles, against a plain pattern."""
    rng = random.Random(2)
    rows = []
    for i in range(40):
        blocks = "".join(f"<p>{rng.random()} &amp; &quot;x&quot;  y\n{i}{'</p>' if rng.random() < 0.6 else '<br>'}" for _ in range(i % 5))
        rows.append((i, f"https://h{i % 3}.com/{i}", f"<nav><ul><li><a href=x>m</a></ul></nav><div class=\"ad\">ad</div><article><h1>T{i}</h1>{blocks}</article><footer>f</footer>", "", "", ""))
    rows += [(40, None, None, "", "", ""), (41, "x", "", "", "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    out = H.op12_html_extraction(spark, str(tmp_path))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    for r in out.collect():
        html = rows[r["page_id"]][2] or ""
        inner = re.sub(r".*<article>|</article>.*", "", html, flags=re.S)
        lines = [" ".join(x.split()) for x in re.split(r"<[^>]*>", inner)]
        plain = "\n".join(x.replace("&amp;", "&").replace("&quot;", '"') for x in lines if x)
        assert (r["text"], r["n_chars"]) == (plain, len(plain))
    assert H.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_pages():
    lines = [str(i % 50) for i in range(20_000)]
    sides = H.shared_lines(lines, lines[::-1][:15_000])
    assert sides[0].sum() == sides[1].sum() > 250
    assert np.flatnonzero(sides[0])[0] >= 0
