"""Wrappers of hosts: places in the expression, several layouts, names above an article."""

from __future__ import annotations

from duoclust.llm import html_extract

from .test_texts_and_tables import page


def main_texts(spark, rows):
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in got}


def test_constants_are_told_by_their_place(spark):
    """Two blocks with one path: the one before the heading is the same on all pages, the one after it is not."""
    rows = [(i, f"http://c.example/{i}", page(f"<div id='w'><p>Read the paper of the town</p><h2>Head {i}</h2><p>Body {i} with its own words</p></div>")) for i in range(8)]
    assert main_texts(spark, rows) == {i: f"Head {i}\n\nBody {i} with its own words" for i in range(8)}


def test_expressions_cover_every_stream():
    streams = [html_extract.fold(list(x)) for x in ("nhpppf", "nxhpf", "hphphpf", "nf", "pnhpp")]
    whole = []
    for k, x in enumerate(streams):
        whole = html_extract.align(whole, x) if k else x
    symbols = [s for g, _, _ in whole for s in g]
    required = {k for k, (_, _, maybe) in enumerate(whole) if not maybe}
    offsets = html_extract._offsets(whole)
    for x in streams:
        places = html_extract.match(x, whole)
        assert places == sorted(set(places)) and [symbols[p] for p in places] == [s for g, _, _ in x for s in g]
        assert {offsets[k] for k in required} <= set(places)
        assert html_extract._align_next(whole, x) and [symbols[p] for p in places]
    assert html_extract.folded(list("hpphppp"))[1] == [0, 1, 1, 0, 1, 1, 1]


def test_long_expressions_are_aligned_like_short_ones(monkeypatch):
    """How much of the table is held at once decides nothing: neither the expression nor the places."""
    import random

    rng = random.Random(4)

    def drawn(n, kinds):
        return [((f"s{rng.randrange(kinds)}",), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]

    # the next group that both have is 100 groups on: the former way for long expressions passed it over
    far = [(("end",), False, False)]
    pairs = [(drawn(rng.randrange(30), kinds), drawn(rng.randrange(30), kinds)) for kinds in (2, 5, 40) for _ in range(40)]
    pairs.append(([((f"a{k}",), False, False) for k in range(100)] + far, far))
    whole = [html_extract.align(x, y) for x, y in pairs]
    places = [[html_extract.match(z, e) for z in pair] for pair, e in zip(pairs, whole, strict=True)]
    assert [e.count(far[0]) for e in whole[-1:]] == [1] and len(whole[-1]) == 101
    for cells in (200, 40, 7, 1):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        assert [html_extract.align(x, y) for x, y in pairs] == whole
        assert [[html_extract.match(z, e) for z in pair] for pair, e in zip(pairs, whole, strict=True)] == places


def test_many_streams_of_one_host(spark):
    """More streams than one group aligns: each has its own order of parts."""
    import random

    rng, rows = random.Random(5), []
    for i in range(80):
        parts = [f"<div class='k{c}'><p>note</p></div>" for c in rng.sample("abcdefgh", 5)]
        rows.append((i, "http://m.example/", page("".join(parts) + f"<div id='w'><p>Text of page {i} and some more of it</p></div>")))
    assert main_texts(spark, rows) == {i: f"Text of page {i} and some more of it" for i in range(80)}


def test_two_layouts_of_one_host(spark):
    body = "Body of page {i} with quite some words."
    rows = [(i, f"http://l.example/{i}", page(f"<div id='wide'><h2>Head {i}</h2><p>{body.format(i=i)} And more of them.</p></div>")) for i in range(9)]
    rows += [(i, f"http://l.example/{i}", page(f"<div class='top'><a href=/>Home</a></div><section class='slim'><p>{body.format(i=i)}</p></section>")) for i in range(9, 12)]
    got = main_texts(spark, rows)
    assert all(got[i] == f"Head {i}\n\n{body.format(i=i)} And more of them." for i in range(9)) and all(got[i] == body.format(i=i) for i in range(9, 12))


def test_names_above_an_article(spark):
    names = ["layout has-sidebar", "with-header", "no-comments", "search-page", "legal"]
    rows = [(i, f"http://n{i}.example/", page(f"<div class='{n}'><{tag}><p>Text {i}</p><div class='comments'><article class='comment'><p>A reader</p></article></div></{tag}><div class='sidebar'><p>Side</p></div></div>"))
            for i, (n, tag) in enumerate((n, tag) for n in names for tag in ("article", "main"))]
    assert main_texts(spark, rows) == {i: f"Text {i}" for i in range(len(rows))}
    plain = [(i, "http://p.example/", page(f"<div class='layout has-sidebar'><div><p>Text {i} of this page</p></div><div class='sidebar'><p>Side</p></div></div>")) for i in range(3)]
    assert main_texts(spark, plain) == {i: f"Text {i} of this page" for i in range(3)}
    remark = [(1, "http://r.example/", page("<article><p>Text</p></article><div class='comments'><article class='comment'><p>A reader</p></article></div>"))]
    assert main_texts(spark, remark) == {1: "Text"}


def test_names_that_mean_other_things(spark):
    page = "<html><body><div class='layout with-sidebar'><article><h1>T{0}</h1><div>Constant lead</div><div class='share-price'>Price {0}</div><p>Body {0}</p><div class='share-bar'>Tell all</div><div class='ad-slot'>Buy</div></article></div></body></html>"
    pages = spark.createDataFrame([(k, "http://h/", page.format(k)) for k in range(8)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages).collect()}
    assert got[3] == "T3\n\nConstant lead\n\nPrice 3\n\nBody 3"


def test_places_decide_on_names_inside_an_article(spark):
    """Names of other things stay; a paragraph with the name of a notice goes only where the wrapper finds a constant."""
    article = "<article><p class='comment-style'>Style {0}</p><div class='related-work'>Work {0}</div><section class='header-files'>Files {0}</section><p class='legal'>Case {0}</p><p class='notice'>Same everywhere</p><div class='related-posts'>More</div><p>Body {0}</p></article>"
    rows = [(i, "http://many.example/", page(article.format(i))) for i in range(8)] + [(100, "http://one.example/", page(article.format(100)))]
    text = "Style {0}\n\nWork {0}\n\nFiles {0}\n\nCase {0}\n\n{1}Body {0}"
    assert main_texts(spark, rows) == {i: text.format(i, "Same everywhere\n\n" if i == 100 else "") for i, _, _ in rows}


def test_siblings_of_the_richest_container_stay(spark):
    rows = [(i, "http://s.example/", page(f"<div class='post'><p>First words of post {i}</p><p>And second words</p></div><div class='entry'><p>Longer words of the entry {i} that go on and on for a while</p></div><div class='menu'><p>Menu {i}</p></div>")) for i in range(4)]
    assert main_texts(spark, rows) == {i: f"First words of post {i}\n\nAnd second words\n\nLonger words of the entry {i} that go on and on for a while" for i in range(4)}
