"""Main-text extraction from pages with known articles."""

import random
import time

import pytest

from brindle.llm import html
from brindle.llm.html import extract, main_text

PROSE = "A long sentence of the article, with commas, and words enough to score as prose, as it should. " * 3


def test_article_without_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, buy, buy now, all of it.</div>
    <article><h1>Head &amp; line</h1><p><b>Bold<br><p>{PROSE}</p><p>short.</p><ul><li>one<li>two</ul>
    <form><p>{PROSE}</p></form><div class="comments"><p>{PROSE}</p></div></article>
    <aside><p>{PROSE}</p></aside><footer>&copy; all</footer></body></html>"""
    flat = " ".join(PROSE.split())
    assert main_text(page).split("\n") == ["Head & line", "Bold", flat, "short.", "one", "two"]


def test_best_container_without_article():
    links = "".join(f'<li><a href="/{i}">A link with, some, commas and text {i}</a></li>' for i in range(30))
    page = f'<body><div><ul>{links}</ul></div><div id="x"><h2>Title</h2><p>{PROSE}</p><p>{PROSE}</p></div><div>tiny</div></body>'
    flat = " ".join(PROSE.split())
    assert main_text(page).split("\n") == ["Title", flat, flat]


def test_loose_text_and_odd_markup():
    assert main_text("just text") == "just text"
    assert main_text("<p>a<p>b</div></p><b>c") == "a\nb\nc"
    assert main_text("<div>one<br>two&nbsp;&#x33;</div>") == "one two 3"
    assert main_text("<script>x</script>") == main_text("") == main_text(None) == ""
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<p>1 < 2 &amp; 3 > 2</p>") == "1 < 2 & 3 > 2"


def test_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", 5), (1, "<p>a</p>", 5), (2, None, None)], "page_id long, html string, n_chars int")
    out = extract(df, into="main")
    assert out.columns == [*df.columns, "main"]
    assert sorted((r.page_id, r.main) for r in out.collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert extract(df.limit(0), into="main").count() == 0


def test_frames_are_no_asides():
    flat = " ".join(PROSE.split())
    assert main_text(f'<body><div class="content no-sidebar"><p>{PROSE}</p></div></body>') == flat
    assert main_text(f'<form id="aspnetForm"><div id="main"><p>{PROSE}</p></div></form>') == flat
    page = f'<div class="layout right-sidebar"><article><p>{PROSE}</p></article><div class="sidebar">{PROSE}</div></div><div id="comments">{PROSE * 9}</div>'
    assert main_text(page) == flat
    assert main_text(f'<div id="content"><p>{PROSE}</p></div><div class="cookie-notice"><p>{PROSE * 4}</p></div>') == flat
    assert main_text(f'<div class="cookie-notice"><p>{PROSE}</p></div>') == ""


def test_equal_scores_take_the_first():
    page = f'<div><div id="a"><p>{PROSE}</p></div></div><div><div id="b"><p>{PROSE[::-1]}</p></div></div>'
    assert main_text(page).split("\n")[0] == " ".join(PROSE.split())


def test_time_grows_with_the_length():
    n = 100_000
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<p></p>" * n, "<blockquote>" * n + PROSE, "<ul>" + "<li><p>a" * n):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 30


def test_scores_against_recursion():
    rng = random.Random(5)

    def text(node):
        return "".join(c if isinstance(c, str) else text(c) for c in node.children)

    def size(node):
        return sum(len(" ".join(c.split())) if isinstance(c, str) else size(c) for c in node.children)

    def links(node):
        return size(node) if node.tag == "a" else sum(links(c) for c in node.children if not isinstance(c, str))

    def points(node):
        own = [c for c in node.children if isinstance(c, str)]
        loose = node.tag in html.CONTAINERS - {"td", "blockquote"} and any(len(c.strip()) >= 25 for c in own)
        if size(node) < 25 or not (loose or node.tag in html.SCORED):
            return 0, None
        s = "".join(own) if loose else text(node)
        return 1 + s.count(",") + min(len(s) // 100, 3), node if loose else node.parent

    for _ in range(40):
        tags = [rng.choice("div p section li a b td blockquote".split()) for _ in range(rng.randrange(1, 40))]
        page = "".join(f"<{t}>" + rng.choice(["", "a, b", "words, of prose, " * rng.randrange(1, 12)]) + (f"</{t}>" if rng.random() < 0.7 else "") for t in tags)
        tree = html.Tree()
        tree.feed(page)
        tree.close()
        nodes = html._order(tree.root)
        html._measure(nodes)
        html._score(nodes)
        want = {id(n): 0.0 for n in nodes}
        for n in nodes:
            p, above = points(n)
            for level in range(1, 5):
                if above is not None and p:
                    want[id(above)] += p / level
                    above = above.parent
        assert all(abs(n.score - want[id(n)]) < 1e-9 and n.chars == size(n) and n.linked == links(n) for n in nodes), page


def test_a_column_is_not_overwritten(spark):
    with pytest.raises(ValueError):
        extract(spark.createDataFrame([("<p>a</p>", 1)], "html string, Text int"))
