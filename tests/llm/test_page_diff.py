import hashlib
import os
import random
import re

import numpy as np
import pytest

from barsmith.llm import page_diff as P
from barsmith.llm import queries

SF = "/root/testdata/sf0.001"


def text(html, around=()):
    return P.main_text(P.page_lines(html), list(around))[0]


def test_article_without_the_rest():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div>'
        '<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld &#233;&nbsp;x<br>two</p><div class="share-buttons">Share</div><form>Mail</form><aside>See</aside><p>Three</article><section id="comments"><p>Nice!</p></section><footer>&copy; x</footer></body></html>'
    )
    assert text(page) == "Head & line One bold é x two Three"


def test_faults_in_markup():
    assert text(None) == "" and text("") == "" and text("plain &lt;text&gt;") == "plain <text>"
    assert text("<p>a<p>b</div></p><b>c") == "a b c"
    assert text("<article><p>kept</article") == "kept"
    assert text("<script>never closed <p>x") == ""


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body class="single no-sidebar"><article><p>Text</article>', "Text"),
        ('<article class="post has-sidebar"><p>Text</p></article>', "Text"),
        ('<div class="comments-off"><article>Text</article></div>', "Text"),
        ('<article>One<section id="related-work"><p>Two</section>Three</article>', "One Two Three"),
        ('<div><p class="promo">ad<p>Real one</div>', "Real one"),
        ('<ul><li class="ad">x<li>y</ul>', "y"),
        ('<dl><dt class="ad">x<dd>y</dl><table><tr><td class="promo">a<td>b<tr><td>c</table>', "y b c"),
        ("<head><title>T<body></title><p>shown", "shown"),
        ("<head><meta charset=utf-8><p>shown", "shown"),
        ('<div class="sidebar"><article>The only article, inside a name</article></div><p>short', "The only article, inside a name"),
        ('<div class="related"><article>Card</article></div><article>The one outside of names</article>', "The one outside of names"),
        ('<article>Teaser</article><div><p>The main text of the page stands in a plain element.</div>', "Teaser The main text of the page stands in a plain element."),
        ('<div class="ad"><b>x</div><p>y</b>z', "yz"),
        ('<div>a<b><div class="ad">b</b>c</div>d</div>', "a d"),
        ('<p>before<table class="ad"><tr><td><p>x</table>after', "before after"),
    ],
)
def test_what_markup_tells(page, want):
    assert text(page) == want


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("seed", range(60))
def test_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
    for cells in (4_000_000, 12):
        at = sorted(P.shared_places(a, b, cells))
        picked, it = [a[i] for i in at], iter(b)
        assert len(at) == lcs(a, b) and all(x in it for x in picked)


def test_long_pages_are_aligned_in_bounded_memory():
    rng = random.Random(5)
    a, b = ([rng.randint(0, 3000) for _ in range(5000)] for _ in range(2))
    whole, parts = P.shared_places(a, b, 10**9), P.shared_places(a, b, 50_000)
    assert len(whole) == len(parts) > 0


def site(i, body):
    return f"<body><p>Site name</p><p>Menu one</p><p>{body}</p><p>All about us</p></body>"


PAGES = "page_id long, url string, html string"


def test_lines_that_near_pages_share_go(spark):
    rows = [(i, f"http://h.example/{d}/{i}", site(i, f"Story number {i} of {d}"), "x") for i, d in enumerate("aabbcc")]
    rows += [(90, "http://other.example/1", site(90, "alone"), "x"), (91, None, site(91, "no host"), "x"), (92, "http://h.example/a/0", None, "x"), (0, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = sorted((r.page_id, r.text, r.n_shared) for r in P.extract_main_text(df).collect())
    want = [(i, f"Story number {i} of {d}", 3) for i, d in enumerate("aabbcc")]
    assert got == sorted([*want, want[0], (90, "Site name Menu one alone All about us", 0), (91, "Site name Menu one no host All about us", 0), (92, "", 0)])


def test_template_inside_articles_goes_and_copied_passages_stay(spark):
    def page(body):
        return f"<body><nav>Menu</nav><article><p>Share this page</p><h1>{body} head</h1><p>A passage that all copy.</p><p>{body} end of it</p><p>Read more stories</p></article></body>"

    rows = [(i, f"http://h.example/{i}", page(f"Story {i}")) for i in range(7)]
    got = {r.page_id: r for r in P.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i].text == f"Story {i} head A passage that all copy. Story {i} end of it" and got[i].n_shared == 3 for i in (2, 3, 4))
    # With fewer than two places on a side markup is believed.
    assert got[0].text.startswith("Share this page Story 0 head")


def test_copies_are_no_template(spark):
    same = site(0, "A long story that stands on many pages word by word " * 3)
    rows = [(i, f"http://h.example/x/{i}", same) for i in range(9)] + [(20, "http://h.example/x/2b", site(20, "Another")), (21, "http://h.example/x/90", site(21, "Third"))]
    got = {r.page_id: r.text for r in P.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    story = ("A long story that stands on many pages word by word " * 3).strip()
    assert all(got[i] == story for i in range(9)) and got[20] == "Another" and got[21] == "Third"


def test_ids_keep_their_bits_and_any_type(spark):
    rows = [((1 << 53) + 1, "http://h.example/1", "<p>a"), (None, "http://h.example/2", "<p>b")]
    got = {(r.page_id, r.text) for r in P.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {((1 << 53) + 1, "a"), (None, "b")}
    named = spark.createDataFrame([("x1", "http://h.example/1", "<p>a")], "page_id string, url string, html string")
    assert [r.page_id for r in P.extract_main_text(named).collect()] == ["x1"]


def test_numbers_of_lines():
    for n in [*range(200), 1000, 5000, 10**6, 10**9]:
        got = int(P.sizes(np.array([P._size_code(n) << 2 | 3]))[0])
        assert P._size_code(n) < 1024 and abs(got - n) * 32 <= n
    lines = P.page_lines("<nav>a</nav><article>b<p>c</article>").lines()
    assert (P.unpack(P.pack(lines)) == lines).all() and (lines & 3).tolist() == [1, 2, 2] and P.unpack(b"").size == 0


def test_very_long_page_beside_short_ones(spark):
    long = "<body><p>Site name" + "".join(f"<p>line {i % 700} of many" for i in range(30_000)) + "</body>"
    rows = [(1, "http://h.example/1", long), (2, "http://h.example/2", "<body><p>Site name<p>short"), (3, "http://h.example/3", "<body><p>Site name<p>other")]
    got = {r.page_id: r.text for r in P.extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[2] == "short" and got[3] == "other" and got[1].startswith("line 0 of many") and got[1].endswith(f"line {29_999 % 700} of many")


def test_empty(spark):
    assert P.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def key(*values):
    return hashlib.md5("".join("-" if v is None else f"{len(str(v))}:{v}" for v in values).encode()).digest()


def brute_force(rows):
    """Texts of all rows, with the places of a host walked one by one."""
    at = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)([^#]*)")
    hosts, out = {}, []
    for i, url, html in {key(*r): r for r in rows}.values():
        m = at.match(url or "")
        if m and P.page_lines(html).texts:
            hosts.setdefault(m[1].lower(), []).append((m[2].encode(), key(i, url, html), P.page_lines(html)))
    near = {}
    for pages in hosts.values():
        pages.sort(key=lambda x: x[:2])
        for n, (path, k, page) in enumerate(pages):
            found = []
            for way in (-1, 1):
                j, last, places = n, page.lead(), 0
                while places < P.REACH and 0 <= (j := j + way) < len(pages):
                    if pages[j][2].lead() != last:
                        places, last = places + 1, pages[j][2].lead()
                        found.append((places, way, pages[j]))
            found.sort(key=lambda x: (-len(os.path.commonprefix([path.decode(), x[2][0].decode()])), x[0], x[1]))
            near[k] = [x[2][2].lines() for x in found]
    return sorted((r[0], *P.main_text(P.page_lines(r[2]), near.get(key(*r), []))) for r in rows)


def test_whole_query_against_a_walk_over_all_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((r.page_id, r.text, r.n_chars) for r in queries.op6_html_extraction(spark, SF).collect())
    want = brute_force(rows)
    assert got == [(i, t, len(t)) for i, t, _ in want] and sum(n for _, _, n in want) > 0


@pytest.mark.parametrize("places, spread", [(P.PLACES, P.SPREAD), (7, 3)])
def test_runs_of_copies_across_partitions(spark, monkeypatch, places, spread):
    monkeypatch.setattr(P, "PLACES", places)
    monkeypatch.setattr(P, "SPREAD", spread)
    rng = random.Random(3)
    rows = [(i, f"http://{rng.choice('ab')}.example/{rng.randint(0, 40)}/{i}", site(i, "Copied story. " * 9 if rng.random() < 0.6 else f"Story {rng.randint(0, 30)}")) for i in range(300)]
    df = spark.createDataFrame(rows, PAGES).repartition(7)
    got = sorted((r.page_id, r.text, r.n_shared) for r in P.extract_main_text(df).collect())
    assert got == brute_force(rows)
