import html
import json
import random
import re
import sys
import time

import pytest

from quillon.llm import wrappers
from quillon.llm.wrappers import Page, align, fold, main_text, merged, render, stream, verdict


def page(*paragraphs, menu=3, extra=""):
    links = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(menu))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>t</title><script>var x='</p>';</script></head><body><div id=top><ul>{links}</ul></div><div class=c1><h2>{paragraphs[0][:9]}</h2>{body}</div>{extra}<div class=c2>All rights kept by Example Corp since ever</div></body></html>"


def test_inference_gives_groups_options_and_slots():
    pages = [page("Alpha one is here.", "Second."), page("Beta is another one.", "x", "y", "z", menu=5), page("Gamma alone.", extra="<div class=c9>only here</div>")]
    w = merged([stream(Page(p)) for p in pages])
    assert render(w) == "<html> <head!> <title!> =text </> </> <body> <div.top> <ul> (<li> #text </>)+ </> </> <div.c1> <h2> #text </> (<p> #text </>)+ </> (<div.c9> =text </>)? <div.c2> =text </> </> </>"


def test_optional_parts():
    pages = [f"<body><h1>{i}</h1>{'<table><tr><td>x</table>' if i == 1 else ''}<p>t {i}</p></body>" for i in range(3)]
    assert render(merged([stream(Page(p)) for p in pages])) == "<body> <h1> #text </> (<table> <tr> <td> =text </> </> </>)? <p> #text </> </>"


def test_a_wrapper_takes_in_its_own_streams():
    w = merged([stream(Page(page("a b", "c", "d"))), stream(Page(page("e", menu=2)))])
    assert render(align(w, stream(Page(page("f g", "h"))))) == render(w)
    assert fold(w) == w


def test_container_without_semantic_tags():
    pages = [page(*(f"Sentence {i} {j} with a number of words in it." for j in range(4))) for i in range(5)]
    told = verdict(merged([stream(Page(p)) for p in pages]))
    got = main_text(Page(pages[2]), told)
    # the h2, the same on all pages, is part of the template
    assert got.startswith("Sentence 2 0 with") and got.endswith("Sentence 2 3 with a number of words in it.")
    assert "Section" not in got and "rights" not in got


NOISE = """<header><h1>Site</h1></header><nav>Menu</nav><aside>Side</aside><div class="cookie-notice">We use cookies</div><div class="ad-box">Buy</div>
<form><label>Mail</label><button>Go</button></form><style>p{}</style><script>if (a < b) {}</script><!-- <p>no</p> --><noscript>Turn on</noscript>"""


@pytest.mark.parametrize("root", ["article", "main", 'div class="entry-content"', 'div role="main"', 'div id="post-17"'])
def test_what_is_no_article_goes(root):
    body = f"<p>One &amp; two<br>three &lt;b&gt;</p>{NOISE.replace('<header><h1>Site</h1></header>', '')}<p>Fo<b>ur</b>\n  five&nbsp;six</p>"
    text = f"<html><body>{NOISE}<{root}><h1>Title</h1>{body}<section id='comments'><p>First!</p></section></{root.split()[0]}><footer>Foot</footer></body>"
    assert main_text(Page(text), None) == "Title One & two three <b> Four five six"


def test_broken_markup():
    assert main_text(Page("<article><p>One<p>Two<div>Three</article><p>Out"), None) == "One Two Three"
    assert main_text(Page("<article><p>a < b and c > d</p><p title='x>y'>e</p>"), None) == "a < b and c > d e"
    assert main_text(Page("plain words &am; &amp more"), None) == "plain words &am; & more"
    assert main_text(Page(None), None) == main_text(Page(""), None) == main_text(Page("<html><nav>x</nav>"), None) == ""
    assert main_text(Page("</p></div><article></b>x</article><script>never closed"), None) == "x"
    Page("<" * 50_000), Page("<a '" * 5_000), Page("<div>" * 20_000)


def test_deep_pages():
    deep = "<div>" * 200
    assert main_text(Page(f"<article>{deep}<p>One<nav>Menu <b>x</b></nav><p>Two</p>"), None) == "One Two"
    assert main_text(Page(f"<body>{deep}<article>{deep * 3}<p>One<nav>Menu <b>x</b></nav><p>Two</p>"), None) == "One Two"
    many = Page("<article>" + "".join(f"<div>text {i}" for i in range(5_000)))
    assert main_text(many, None) == " ".join(f"text {i}" for i in range(5_000))
    sys.setrecursionlimit(wrappers.FRAMES)  # as tasks do
    a, b = (json.loads(json.dumps(stream(Page(f"<body>{deep * 3}<p>{i}</p>")))) for i in range(2))
    w = align(a, b)
    assert render(w).count("<div>") == wrappers.DEEPEST - 1 and "#text" in render(w)


@pytest.mark.parametrize("source", ["<a ", "<a '>", "<a \"'>", "<!--", "<", "<div>", "<script>", "</p>x", "<p>x", "<b>&amp;", "<p title='<'>", "<!x "])
def test_any_page_is_read_in_seconds(source):
    at = time.time()
    page = Page(source * (2_000_000 // len(source)))
    main_text(page, None)
    assert time.time() - at < 30


def test_repeats_of_any_length_fold():
    unit = "".join(f"<div class={word(j)}>text {j}</div>" for j in range(40))
    assert render(stream(Page(unit * 3))).endswith(")+") and len(stream(Page(unit * 3))) == 1
    r = random.Random(6)
    for _ in range(300):
        keys = [r.choice("abc") for _ in range(r.randint(0, 24))]
        brute = next((u for u in range(1, len(keys) // 2 + 1) if any(keys[i : i + u] == keys[i + u : i + 2 * u] for i in range(len(keys) - 2 * u + 1))), None)
        assert wrappers.period(keys, 1) == brute


def plain_site(n, seed=0):
    """Pages of one template without telling tags or classes: a long fixed text, a line on a third of the pages, links, a short article, and what the article says."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(["tale", "river", "stone", "walked", "under", "never", "old", "light"]) + str(r.randint(0, 99)) for _ in range(k))
    out = []
    for i in range(n):
        paragraphs = [say(r.randint(4, 12)) for _ in range(r.randint(1, 4))]
        notice = "<div class=qd>The shop is shut until the end of the month, orders wait</div>" if i % 3 == 0 else ""
        links = "".join(f"<div class=qe><a href=/{k}>{say(2)}</a></div>" for k in range(3))
        out.append((f"<body><div class=qa><div class=qb>{'Everything that we have done for years is told here in full. ' * 8}</div><div class=qc>{''.join(f'<div>{p}</div>' for p in paragraphs)}{links}{notice}<div class=qf>Reprint with leave of the house only</div></div></div></body>", " ".join(paragraphs)))
    return out


def test_the_wrapper_decides_without_telling_names(spark):
    pages = plain_site(30)
    alone = [main_text(Page(h), None) for h, _ in pages]
    assert not any(a == want for a, (_, want) in zip(alone, pages))
    df = spark.createDataFrame([(i, "http://p.example/x", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string").repartition(4)
    assert [r.text for r in wrappers.extract(df).orderBy("page_id").collect()] == [want for _, want in pages]


def test_the_wrapper_decides_under_article_too(spark):
    """The same text inside an article on pages that differ is template; on copies of one page it isn't."""
    pages = [f"<article><p>Shared line of the house</p><h2>Title {i}</h2><ul><li><a href=/>Go {i} one</a></li><li><a href=/>Go {i} two</a></li></ul><p>Body {i} says {i * 7919 % 1000} things at length</p></article>" for i in range(6)]
    rows = [(i, "http://q.example/", h) for i, h in enumerate(pages)] + [(100 + i, "http://r.example/", pages[0]) for i in range(6)]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"Title {i} Body {i} says {i * 7919 % 1000} things at length" for i in range(6)]
    assert got[100] == "Shared line of the house Title 0 Go 0 one Go 0 two Body 0 says 0 things at length"


def word(n):
    return "qz" + "".join(chr(97 + n // 26**i % 26) for i in range(4))


def test_what_long_pages_share_is_found_between_their_ends():
    def long(i):
        parts = [f"<div class={word(i * 2000 + j)}>Text {i} {j} that no other page has</div>" for j in range(1200)]
        return "<body>" + "".join(parts[:600]) + "<blockquote>The same on all pages</blockquote>" + "".join(parts[600:]) + "</body>"

    pages = [Page(long(i)) for i in range(4)]
    told = verdict(merged([stream(p) for p in pages]))
    got = main_text(pages[1], told)
    assert "The same" not in got and got.count("Text 1") == 1200


def test_alignment_against_plain_table(monkeypatch):
    r = random.Random(4)
    for n in range(400):
        monkeypatch.setattr(wrappers, "MASKS", r.choice([0, 4, 1 << 20]))
        a, b = ([(r.choice("abcde"[: r.randint(1, 5)]),) for _ in range(r.randint(0, 40))] for _ in "ab")
        ops = wrappers.matched(a, b)
        assert [x for o, i, j, _, _ in ops for x in a[i:j]] == a and [x for o, _, _, k, m in ops for x in b[k:m]] == b
        assert all(a[i:j] == b[k:m] for o, i, j, k, m in ops if o == "equal")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert sum(j - i for o, i, j, _, _ in ops if o == "equal") == row[-1]


def test_merging_by_levels_gives_the_same(spark, monkeypatch):
    html = [page(*(f"Sentence {i} {j} with words." for j in range(i % 5 + 1)), extra="<table><tr><td>x</table>" * (i % 3)) for i in range(60)]
    df = spark.createDataFrame([(i, "http://a.example/", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(7)
    monkeypatch.setattr(wrappers, "SPREAD", 1)
    monkeypatch.setattr(wrappers, "LEVELS", (1,))
    once = sorted(map(tuple, wrappers.extract(df).collect()))
    monkeypatch.setattr(wrappers, "SPREAD", 3)
    monkeypatch.setattr(wrappers, "LEVELS", (8, 2, 1))
    assert sorted(map(tuple, wrappers.extract(df).collect())) == once


def expected(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = wrappers.extract(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == expected(source[r.page_id]) and r.n_chars == len(r.text)


def test_joining_by_host_gives_the_same(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = sorted(map(tuple, wrappers.extract(pages).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST", -1)
    assert sorted(map(tuple, wrappers.extract(pages).collect())) == a


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "not a url", "", "x"), (None, "http://A.example/x", "<p>Hi</p>", "x"), (2, "http://a.example/y", "<p>Hi</p>", "x"), (2, "http://a.example/y", "<p>Hi</p>", "x")], "page_id long, url string, html string, host string")
    rows = wrappers.extract(df).collect()
    assert sorted(((r.page_id or 0, r.text) for r in rows)) == [(0, "Hi"), (1, ""), (1, ""), (2, "Hi"), (2, "Hi")]
    assert wrappers.extract(df.limit(0)).collect() == []
