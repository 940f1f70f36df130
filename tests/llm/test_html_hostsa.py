import html
import random
import re

import numpy as np
import pytest

from tidemark.llm import html_hostsa as H


def text_of(page):
    return " ".join(t for s, t in H.blocks(page) if s == H.CONTENT)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>A&amp;B</h1><p><b>one<br>two<p>three</article>", "A&B one two three"),
        ("<nav>menu</nav><article>x<aside>side</aside> y <form>f</form>z</article><footer>&copy; f</footer>", "x y z"),
        ("<script>var t='</p><article>no';</script><main><p>in<!-- <p>no</p> -->side</p></main>", "inside"),
        ("<article><header><h1>T</h1></header><p>a</p><div class='comments'><p>c</p></div></article>", "T a"),
        ("<header>top</header><article>a &quo; &am</article>", "a &quo; &am"),
        ("<article><p>a\n\t b</p>c<i>d</i>e<p style='display: none'>no</p></article", "a b cde"),
        ("<article><p class=ad>no<p>yes<ul><li>1<li>2</ul></article>", "yes 1 2"),
        ("<article>unclosed <b>bold <p>next", "unclosed bold next"),
        ("<div id=cookie-notice>n</div><div role=main>m<div hidden>h</div></div>", "m"),
        ("<div>top</div><div class='content has-sidebar'><p>a</p><div class='sidebar'>s</div><div class='post-comments'>c</div></div><div>end</div>", "a"),
        ("<div class='comment-content'>no</div><section id='post-12'>yes</section>", "yes"),
        ("<article><p>a</p><div class='alert'>n</div><section class='reader-comments'><p>c</p></section><div class='share-bar'>s</div>b</article>", "a b"),
        ("<article><p>one <span class='ad'>BUY</span> two</p></article>", "one two"),
        ("<article><p>one <button>Send</button> two <span hidden>no</span>three wo<b hidden>x</b>rd</p></article>", "one two three word"),
        ("<article>a<div class='ad'>" + "<i>" * 40 + "BUY</div><p>rest of it</p></article>", "a rest of it"),
        ("<article><div class='ad'>" + "<b><i>" * 30 + "BUY</b></div>" + "</i>" * 50 + "<p>rest</article>", "rest"),
        ("<article><p>x <math><mi>a</mi>=<mn>2</mn></math> y</article>", "x a=2 y"),
        ("", ""),
    ],
)
def test_structure(page, want):
    assert text_of(page) == want


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (7, 2), (60, 2), (200, 3), (300, 50)):
        tokens = rng.integers(0, top, n).astype(np.uint64)
        order, ranks = H.suffix_array(tokens)
        want = sorted(range(n), key=lambda k: tokens[k:].tolist())
        assert order.tolist() == want
        shared = H.common_prefixes(order, ranks)
        for k in range(1, n):
            a, b = tokens[want[k - 1] :].tolist(), tokens[want[k] :].tolist()
            least = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == least


def brute(pages):
    """Removal by the definition: tokens in a run that another page of the host has too."""
    from urllib.parse import urlsplit

    streams = {i: (urlsplit(u).netloc, [w for s, t in H.merged(H.blocks(h)) if s != H.CONTENT for w in t.split()]) for i, u, h in pages}
    owners = {}
    for i, (host, words) in streams.items():
        for k in range(len(words) - H.RUN + 1):
            owners.setdefault((host, *words[k : k + H.RUN]), set()).add(i)
    out = {}
    for i, _, h in pages:
        host, words = streams[i]
        spans = [(k, k + H.RUN) for k in range(len(words) - H.RUN + 1) if len(owners[(host, *words[k : k + H.RUN])]) > 1]
        out[i] = H.kept_text(H.merged(H.blocks(h)), spans)
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 1500])
def test_repeated_runs_of_a_host_are_removed(spark, monkeypatch, chunk):
    monkeypatch.setattr(H, "CHUNK_CHARS", chunk)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    menu = {h: " ".join(rng.choices(words, k=12)) for h in ("a.example", "b.example")}
    pages = []
    for i in range(80):
        host = rng.choice(list(menu))
        own = " ".join(f"{rng.choice(words)}{rng.randrange(9)}" for _ in range(30))
        pages.append((i, f"https://{host}/{i}", f"<div>{menu[host]}</div><div>{own}</div><div>{rng.choice(list(menu.values()))}</div>"))
    want = brute(pages)
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(menu[h] not in want[i] for i, u, _ in pages for h in menu if h in u)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_text_beside_a_card_named_like_an_article(spark):
    """A class name doesn't settle the rest of the page: what pages share goes, unique runs stay."""
    menu = "home about products contact and more links"
    pages = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div class='post'>card {i}</div><p>own words of the page number {i} follow here</p>") for i in range(3)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == brute(pages)
    assert all("home about" not in t and f"card {i}" in t and str(i) in t for i, t in got.items())
    report = H.boilerplate_report(spark.createDataFrame(pages, "page_id long, url string, html string")).first()
    assert report.host == "h.example" and report.pages == report.pages_with_shared == 3 and 0 < report.shared_tokens < report.outside_tokens


def test_articles_of_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == want and got[r.page_id].url == r.url


def test_every_page_comes_through_the_arrays(spark):
    """Pages with an article, too, tell what the arrays removed of them, as counted by the definition."""
    from urllib.parse import urlsplit

    folder = "/root/testdata/sf0.01/pages.parquet"
    pages = spark.read.parquet(folder)
    card = [(10_000 + i, f"http://h.example/{i}", f"<div>home about products contact and more links</div><p>{i} is its number") for i in range(2)]
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()] + card
    streams = {i: (urlsplit(u).netloc, [w for s, t in H.blocks(h) if s != H.CONTENT for w in t.split()]) for i, u, h in rows}
    owners = {}
    for i, (host, words) in streams.items():
        for k in range(len(words) - H.RUN + 1):
            owners.setdefault((host, *words[k : k + H.RUN]), set()).add(i)
    want = {i: len({j for k in range(len(words) - H.RUN + 1) if len(owners[(host, *words[k : k + H.RUN])]) > 1 for j in range(k, k + H.RUN)}) for i, (host, words) in streams.items()}
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: r.n_shared for i, r in got.items()} == want
    assert sum(n > 0 for n in want.values()) > 80
    assert got[10_000].text == "0 is its number" and got[10_000].n_shared == 7


def test_edge_rows(spark):
    long = "<article>" + "<p>word &lt; more</p>" * 50_000 + "</article>"
    rows = [(1, None, None, "x"), (None, "http://[bad", "<p>a b c d e f", "x"), (None, "http://[bad", "<p>a b c d e f", "x"), (3, "http://h.example/", long, "x"), (4, "", "<p>" * 2000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract(pages).collect()), key=lambda r: r[0])
    assert [r[0] for r in got] == [0, 0, 1, 3, 4]
    assert [r[1] for r in got] == ["a b c d e f", "a b c d e f", "", " ".join(["word < more"] * 50_000), "deep"]
    assert H.extract(pages.limit(0)).count() == 0
