import re

import numpy as np
from helpers import prose
from pyspark.sql import functions as F

from fairlead.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Home</a></li></ul></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><aside>Side</aside>
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold</b> and&nbsp;two<br>three</p><!-- no --><p>Second &lt;p&gt; &copy; &#233;&#x41;
  line</p><div class="ad">Buy</div><form><input value="x">Search</form><ul><li>first<li>second</ul><noscript>off</noscript><p hidden>no</p><table><tr><td>c1<td>c2</table>
<section id="comments"><p>Nice post!</p></section></article></main><footer>&copy; foot</footer></body></html>"""


def main_text(page):
    return "\n".join(t for z, t in html.blocks(page) if z == html.MAIN)


def test_markup():
    assert main_text(PAGE).split("\n") == ["Title & more", "One bold and two three", "Second <p> © éA line", "first", "second", "c1", "c2"]


def test_broken_markup():
    assert main_text("<article><h1>A</h1><p><b>B<br><p>C</p></article><footer>F") == "A\nB\nC"
    assert main_text("<article><p>a &am") == "a &am"
    assert main_text("<article><p>a</p><p") == "a"
    assert main_text('<article><p title="x > y">a</p><p title="cut') in ("a", "a\n")
    assert main_text("<article>1 < 2 and 3 > 2</article>") == "1 < 2 and 3 > 2"
    assert main_text("<article><script>if (a < b) {}</article>") == ""
    for cut in range(0, len(PAGE), 7):
        html.blocks(PAGE[:cut])
    for odd in ("", "<", "<>", "</", "<!", "<!--", "<a b='", "<![CDATA[x", "&", "</p></div></article>", "<" * 5000, '<a "' * 3000):
        html.blocks(odd)


def plain_repeats(pages, n=html.RUN):
    """Runs of n tokens by hash, and on how many pages each is."""
    on = {}
    for i, c in enumerate(pages):
        for h in html.window_hashes(c).tolist():
            on.setdefault(h, set()).add(i)
    return {h: len(v) for h, v in on.items()}


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(4)
    for n, kinds in ((1, 1), (2, 1), (300, 2), (300, 1), (400, 50)):
        text = np.append(r.integers(0, kinds, n - 1), kinds)
        order, lcp = html.suffix_array(text)
        suffixes = sorted((tuple(text[i:]), i) for i in range(n))
        assert order.tolist() == [i for _, i in suffixes]
        for k in range(1, n):
            a, b = suffixes[k - 1][0], suffixes[k][0]
            assert lcp[k] == next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def test_runs_equal_brute_force_in_chunks_of_any_size(spark):
    parts = prose(1, 12, words=40, vocabulary=30)
    streams = [f"{parts[i]} {parts[(i * 5) % 12]} {parts[i % 3]}" for i in range(12)] + ["a b", "x " * 40 + "y"]
    codes = [html.token_codes([s.strip()])[0] for s in streams]
    host = lambda i: "h" if i % 7 else "g"
    rows = [(i, host(i), 5 if i == 13 else i, bytes(c.astype("<u2").tobytes())) for i, c in enumerate(codes)]
    want = {}
    for h in "gh":
        # 5 and 13 are of one host and have one sketch: the least tokens count
        other = max((5, 13), key=lambda i: rows[i][3])
        own = [c for i, c in enumerate(codes) if host(i) == h and i != other]
        least = max(html.MIN_PAGES, len(own) * html.SHARE)
        want |= {(h, k): n for k, n in plain_repeats(own).items() if n >= least} | {(h, None): len(own)}
    df = spark.createDataFrame(rows, "uid long, host string, sketch long, codes binary")
    for chunk, tasks in ((1, 1), (100, 3), (1_000_000, 1), (1_000_000, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
        got = {(r.host, r.run): r.pages for r in html.repeated_runs(df, chunk).collect()}
        assert {k: n for k, n in got.items() if k in want} == want
        assert all(n < max(html.MIN_PAGES, got[h, None] * html.SHARE) for (h, k), n in got.items() if (h, k) not in want)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_counts_do_not_depend_on_how_a_host_is_cut(spark):
    """A run on exactly a fifth, one on exactly half and ones just below, all gathered in a few parts of the host."""
    p = prose(71, 400, words=40, vocabulary=3000)
    lines = {k: " ".join(f"{k}{i}" for i in range(html.RUN)) for k in ("fifth", "under", "half", "less", "rare")}
    on = {"fifth": range(80), "under": range(300, 379), "half": range(100, 300), "less": range(201, 400), "rare": range(0, 400, 30)}
    streams = [" ".join([p[i], *[lines[k] for k in lines if i in on[k]]]) for i in range(400)]
    rows = [(i, "h", i, bytes(html.token_codes([s])[0].astype("<u2").tobytes())) for i, s in enumerate(streams)]
    # near copies of one sketch: whichever comes first, the least tokens count
    rows += [(1000 + i, "h", 5, bytes(html.token_codes([streams[5] + " " + p[i]])[0].astype("<u2").tobytes())) for i in range(8)]
    df = spark.createDataFrame(rows, "uid long, host string, sketch long, codes binary")
    got = []
    try:
        for chunk, tasks, shuffled in ((10**6, 1, df), (900, 1, df), (3000, 3, df.repartition(5)), (10**6, 7, df.orderBy(F.desc("uid"))), (1, 2, df)):
            spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
            found = {r.run: r.pages for r in html.repeated_runs(shuffled, chunk).collect()}
            got.append({k: n for k, n in found.items() if k is None or n >= 80})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0][None] == 400 and {80, 199, 200} <= set(got[0].values()) and 79 not in got[0].values()
    assert all(g == got[0] for g in got)


def test_runs_decide_inside_articles(spark):
    """Boilerplate that no markup names goes from articles; what copies share, and a much quoted passage, stays."""
    p, offer = prose(51, 60, words=60, vocabulary=4000), "all the news of the sea once a week in your own letter box"
    quoted = "and the ships of the line went down to the sea in great numbers on that day"
    page = lambda *paragraphs: "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + f"<p>{offer}</p></article>"
    rows = [(i, page(p[i], p[i + 20], *[quoted] * (i < 8))) for i in range(20)] + [(100 + i, page(p[50], p[51], p[52])) for i in range(40)]
    rows += [(200, page()), (201, page(p[59]))]
    df = spark.createDataFrame([(i, "http://a/", h) for i, h in rows], "page_id long, url string, html string").repartition(5)
    for limit in (0, 1000):  # joined, broadcast
        got = {r.page_id: r.text for r in html.extract(df, broadcast_runs=limit).collect()}
        assert all(got[i] == "\n".join([p[i], p[i + 20], *[quoted] * (i < 8)]) for i in range(20))
        assert all(got[100 + i] == f"{p[50]}\n{p[51]}\n{p[52]}" for i in range(40)), "copies are one page"
        assert got[200] == offer and got[201] == p[59], "an article of nothing else stays"


def test_host_boilerplate_without_articles(spark):
    body, notice = prose(5, 12), "please note that this site is about ships and the sea and nothing else"
    pages = [(i, f"http://h.example/{i}", f"<div>{notice}</div><div>{b}</div><div>tiny</div>", "x") for i, b in enumerate(body)]
    pages += [(20, "http://other.example/", f"<div>{notice}</div>", "x"), (21, None, f"<p>{body[0]}", "x"), (22, "http://h.example/c", f"<div>{notice}</div><div>{body[3]}</div><div>tiny</div>", "x")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string, main string")).collect()}
    for i, b in enumerate(body):
        if i != 3:
            assert got[i] == f"{b}\ntiny", "the shared notice goes, unique runs stay"
    assert got[20] == notice and got[21] == body[0], "another host has no repeats"


def test_versions_of_a_text_keep_what_they_share(spark):
    p = prose(31, 30, words=60, vocabulary=4000)
    menu = "harbour news tides charts weather crew notices about this site and contact"
    page = lambda *paragraphs: f"<div>{menu}</div>" + "".join(f"<p>{x}</p>" for x in paragraphs)
    rows = [(i, "http://a/", page(p[i], p[i + 8])) for i in range(6)]
    rows += [(10 + i, "http://a/", page(p[20], p[21], p[22 + i])) for i in range(4)] + [(20, "http://a/", page(p[0], p[29])), (30, "http://a/", page())]
    rows += [(40, "http://b/", page(p[20], p[21], p[22])), (41, "http://b/", page(p[20], p[21], p[23]))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"{p[i]}\n{p[i + 8]}"
    for i in range(4):
        assert got[10 + i] == f"{p[20]}\n{p[21]}\n{p[22 + i]}", "copies neither lose what they share nor keep the menu"
    assert got[20] == f"{p[0]}\n{p[29]}", "a quotation stays"
    assert got[30] == "", "a menu and nothing else"
    assert got[40].endswith(f"{p[20]}\n{p[21]}\n{p[22]}") and got[41].endswith(f"{p[20]}\n{p[21]}\n{p[23]}")


def test_wrappers_that_look_like_chrome():
    article = "<article><p>one two three</p></article>"
    for wrapped in (f'<div class="page has-sidebar">{article}</div>', f'<div class="content-sidebar-wrap"><main>{article}</main></div>', f'<form action="/">{article}</form>', f'<div class="has-sidebar"><form>{article}</form></div>', '<div class="top"><div role="main">one two three</div></div>'):
        assert main_text(f"<body><nav>menu</nav>{wrapped}<footer>foot</footer></body>") == "one two three", wrapped
    for chrome in ('<div id="comments">{}</div>', "<aside>{}</aside>", "<nav>{}</nav>", "<footer>{}</footer>"):
        assert main_text(chrome.format(article)) == ""
    assert main_text(f'<div class="page has-sidebar">{article}<div class="related"><article>a much longer teaser</article></div></div>') == "one two three"
    assert main_text(f'{article}<div class="related"><article>teaser</article></div>') == "one two three"
    assert html.blocks('<form><div>one</div><nav>n</nav><div class="cookie">c</div></form>') == [(html.OPEN, "one"), (html.CHROME, "n"), (html.CHROME, "c")]


def test_class_words_inside_articles_are_confirmed_by_the_host(spark):
    p, offer = prose(41, 12, words=40, vocabulary=4000), "subscribe to our weekly letter now and get all the news of the sea"
    page = lambda i, own: f'<article><h2 id="promotion">Promotion {own}</h2><p class="alert">{own}</p><p>{p[i]}</p><section id="discussion"><p>{p[i + 6]}</p></section><div class="newsletter">{offer}</div><div class="ad">Buy</div></article>'
    got = [r.text for r in html.extract(spark.createDataFrame([(i, "http://a/", page(i, f"mind the {i}")) for i in range(5)], "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [f"Promotion mind the {i}\nmind the {i}\n{p[i]}\n{p[i + 6]}" for i in range(5)]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "http://a/", PAGE), (4, "http://a/", PAGE), (4, "http://a/", PAGE), (5, "http://a/", "<article>" + "<p>word</p>" * 20_000), (6, "", "<nav>only</nav>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[6] == "" and by[4] == by[None] == main_text(PAGE) != "" and by[5].count("\n") == 19_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_generated_pages(spark, sf):
    """On the generated pages the article is what stands between its tags."""
    from html import unescape

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html.extract(pages).collect():
        inner = re.split(r"<footer>|</article>", raw[r.page_id].split("<article>")[1])[0]
        want = [" ".join(unescape(re.sub(r"</?b>|<[^>]*$", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", inner)]
        assert r.text == "\n".join(x for x in want if x), r.page_id
