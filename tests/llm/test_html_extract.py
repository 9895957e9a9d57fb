"""Blocks of awkward markup, and template removal per host."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_extract as hx

PAGES = {
    "<article><h1>T &amp; x</h1><p>a\n b<p>c<br>d</article><footer>f</footer>": "T & x\na b\nc d",
    "<nav>n</nav><main><div class='ad'>no</div><div>yes <b>b</b>old</div><form>f</form></main>": "yes bold",
    "<body><header>h</header><p>one</p><ul><li>x<li>y</ul><aside>s</aside><script>var a='</p>';</script></body>": "one\nx\ny",
    "<article><p>t &#233;&nbsp;&lt;p&gt; &am</p><section id=comments><p>reader</p></section></article>": "t é <p> &am",
    "<p>cut <b>off": "cut off",
    "<article></article><p>outside</p>": "outside",
    "<div hidden>no</div><p class='a\"b'>k</p><!-- c <p>x</p> --><p title='>'>z</p>": "k\nz",
    "<p>a<style>p{}</style>b</p><textarea>no</textarea>": "ab",
    "plain text\nonly": "plain text only",
    "<div role=navigation>x</div><table><tr><td>1<td>2<tr><td>3</table>": "1\n2\n3",
    "<article>one</article><p>between</p><article><p>two</article>": "one\ntwo",
    "<p title='a hidden gem'>k</p><p data-hidden=1>l</p><p hidden>no</p><p hidden=''>no</p>": "k\nl",
    "<article><p class='share price'>x</p><div class='related-work'>y</div><div class='box ad'>no</div></article>": "x\ny",
    "<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> and <svg><title>no</title><text>t</text></svg></p>": "E = mc2 and t",
    "<p don't>x</p><p>can't</p>": "x\ncan't", "<p a='1>x</p><p>y": "", "<p a = \"1>2\" b>x</p>": "x",
    "<": "<", "": "", "<p": "", "</p></div>": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_blocks(page):
    assert hx.main_text(page) == PAGES[page]


def test_deep_and_long_pages():
    assert hx.main_text("<div>" * 20_000 + "x") == "x"
    assert len(hx.main_text("<p>word</p>" * 20_000)) == 5 * 20_000 - 1


def site(n: int) -> list[tuple]:
    box = "<div><p>Join our letter</p></div>"
    return [(k, "http://a.com/x", f"<body><article><p>story {k}</p>{box}<p>shared sentence</p></article><div>left rail</div></body>") for k in range(n)]


@pytest.mark.parametrize("limit", [hx.BROADCAST_BYTES, -1])
def test_recurring_subtrees_go_and_shared_prose_stays(llm, limit):
    rows = [*site(8), (100, "http://b.com/x", site(1)[0][2]), (101, None, None), (102, "none", "<p>p</p>")]
    rows += [(200 + k, "http://copies.com/", "<article><div><p>one text</p></div></article>") for k in range(20)]
    df = llm.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in hx.extract(df, broadcast_bytes=limit).collect()}
    assert all(got[k] == f"story {k}\nshared sentence" for k in range(8))
    assert got[100] == "story 0\nJoin our letter\nshared sentence"
    assert (got[101], got[102]) == ("", "p")
    assert all(got[200 + k] == "one text" for k in range(20))  # copies of a page are no template
    assert len(got) == len(rows)


def test_template_outside_the_main_element(llm):
    rows = [(k, "http://a.com/", f"<body><div><p>rail</p></div><p>text {k}</p></body>") for k in range(6)]
    df = llm.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in hx.extract(df).collect()} == {k: f"text {k}" for k in range(6)}


def test_empty_table(llm):
    none = llm.createDataFrame([], "page_id bigint, url string, html string, host string, hashes int")
    assert hx.extract(none).count() == 0


@pytest.mark.parametrize("page", ["<a " * 300_000 + '"', "<a b='" * 100_000, "<div>" * 100_000 + "</b>" * 100_000, "<p a" + "x" * 500_000, "<!--" * 100_000, "<li>" * 100_000, "<script" * 100_000])
def test_damaged_pages_are_read_in_one_go(page):
    start = time.process_time()
    hx.main_text(page)
    assert time.process_time() - start < 20


def template_site(hosts: int, n: int) -> list[tuple]:
    """Containers that no list of words knows, on some pages of some hosts."""
    rows = []
    for host in range(hosts):
        boxes = [f"<div class='x{host}{k}'><p>box {host} {k}</p></div>" for k in range(4)]
        for k in range(n):
            held = [b for j, b in enumerate(boxes) if (k * 7 + j) % (j + 2) == 0]
            rows.append((host * 100 + k, f"https://h{host}.org/{k}", f"<article><p>story {host} {k % (n - 2)}</p>{''.join(held)}<section><p>own {k}</p></section></article>"))
    return rows


@pytest.mark.parametrize("limit", [hx.BROADCAST_BYTES, -1])
def test_counts_per_host_decide(llm, limit):
    rows = template_site(3, 14)
    pages = llm.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    pages = pages.select("*", *(F.lit(k).alias(name) for k, name in enumerate(("host", "row", "id", "hashes", "texts", "text", "gone", "a.b"))))
    seen: dict[tuple, set] = {}
    for _, url, page in rows:
        text = hx.main_text(page)
        for _, around in hx.page_blocks(page):
            for h in around:
                seen.setdefault((url.split("/")[2], h), set()).add(text)
    recurring = {key for key, texts in seen.items() if len(texts) >= hx.MIN_PAGES}
    parsed = hx.parsed_pages(pages)
    assert {(r.host, r.hash) for r in hx.recurring_subtrees(parsed).collect()} == recurring and recurring
    got = {r.page_id: r.text for r in hx.extract(pages, broadcast_bytes=limit).collect()}
    plain = {p: hx.main_text(page, {h for host, h in recurring if host == url.split("/")[2]}) for p, url, page in rows}
    assert got == plain
    ignored = {r.page_id: r.text for r in hx.extract(pages, min_pages=10**9).collect()}
    assert sum(got[p] != ignored[p] for p in got) > len(got) / 3
