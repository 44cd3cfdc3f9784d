"""Main text of hosts whose templates are not a bare article."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from junctura.llm import html_wrapper

STORY = ["The river rose in spring and the mill stood still.", "Nobody on the hill had seen such water before that year.", "They waited by the bridge until the evening came at last."]


def texts(spark, pages):
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)]
    got = html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def pages(around, n=6):
    """n pages of one host with stories of their own, and what they should give."""
    own = [[f"Head {i}", *(f"{x} ({i})" for x in STORY[: 1 + i % 3])] for i in range(n)]
    return [f"<html><body>{around(f'<h1>{o[0]}</h1>' + ''.join(f'<p>{x}</p>' for x in o[1:]), i)}</body></html>" for i, o in enumerate(own)], ["\n".join(o) for o in own]


NAMED = {
    "around": "<div class='content-sidebar-wrap'><article>{}</article></div>",
    "itself": "<article class='post no-sidebar'>{}</article>",
    "page": "<div id='page' class='site header-fixed'><div class='entry'>{}</div></div>",
    "main": "<main class='with-ads'>{}</main>",
    "whole name": "<div class='overlay'><main>{}</main></div>",
    "no tag": "<div class='content-sidebar-wrap'>{}</div>",
}


@pytest.mark.parametrize("name", NAMED)
def test_names_do_not_drop_the_story(spark, name):
    html, want = pages(lambda story, i: f"<div class='sidebar'>Side {i * i}</div><div class='top ad'>Buy {i}</div>{NAMED[name].format(story)}<div class='comments'><p>Well {i}</p></div>")
    assert texts(spark, html) == want


def test_rare_name_does_not_drop_the_story(spark):
    # one page of the host has a container of its own
    html, want = pages(lambda story, i: f"<div class='{'page-with-sidebar' if i == 3 else 'entry'}'>{story}</div>")
    assert texts(spark, html) == want


def test_cards_are_not_the_story(spark):
    card = lambda i: f"<article class='card'>Next {i}</article>"
    html, want = pages(lambda story, i: f"<main>{story}</main><section>{card(i)}{card(i + 1)}</section>")
    assert texts(spark, html) == want
    html, want = pages(lambda story, i: f"<main>{story}{card(i)}{card(i + 1)}</main>")
    assert texts(spark, html) == [f"{w}\nNext {i}\nNext {i + 1}" for i, w in enumerate(want)]


@pytest.mark.parametrize("n", [2, 6])
def test_no_tag_and_no_name(spark, n):
    html, want = pages(lambda story, i: f"<div class='m1'><a>Home</a> <a>All about us</a></div><div class='c1'>{story}<div class='m3'>Read more</div></div><div class='m2'>Made by hand</div>", n)
    assert texts(spark, html) == want


def test_copies_are_not_the_template(spark):
    # two addresses of one story differ in their date only
    page = "<html><body><div class='date'>{}</div><article><h1>Head</h1><p>A story.</p></article></body></html>"
    assert texts(spark, [page.format("1 May 2020"), page.format("3 June 2021")]) == ["Head\nA story."] * 2


def test_the_wrapper_decides(spark):
    """What the host's pages agree on goes, if it stands apart at an edge; slots stay.  Without the host's wrapper it would all stay."""
    story_of = lambda story: f"<header>{story[: story.index('</h1>') + 5]}</header>{story[story.index('</h1>') + 5 :]}"
    html, want = pages(lambda story, i: f"<article><div>We write for you</div>{story_of(story)}<div>Share this story with friends</div></article>")
    assert texts(spark, html) == want
    alone = ["\n".join(html_wrapper.blocks(html_wrapper.parse(p))) for p in html]
    assert alone == [f"We write for you\n{w}\nShare this story with friends" for w in want]
    # a paragraph among the story's own is part of it
    html, want = pages(lambda story, i: f"<article>{story_of(story)}<p>The end.</p></article>")
    assert texts(spark, html) == [f"{w}\nThe end." for w in want]


def test_the_wrapper_picks_the_region(spark):
    """Nothing but the alignment tells the story from the rest: no tag, no name, and the rest is longer."""
    rest = "".join(f"<p>{x} It is the same on every page of this place.</p>" for x in STORY)
    html, want = pages(lambda story, i: f"<div class='xa'>{rest}</div><div class='xb'>{story}</div><div class='xc'>{rest}</div>")
    assert texts(spark, html) == want
    assert all("every page" in "\n".join(html_wrapper.blocks(html_wrapper.parse(p))) for p in html)


PARTS = {
    "heading": ("<h2>Conclusion</h2><p>Point {i}</p><p>The end.</p>", "Conclusion\nPoint {i}\nThe end."),
    "recipe": ("<h2>Ingredients</h2><ul><li>{i} eggs<li>Flour</ul><h2>Method</h2><p>Stir {i} times.</p>", "Ingredients\n{i} eggs\nFlour\nMethod\nStir {i} times."),
    "code": ("<p>Run {i}:</p><pre>make all</pre>", "Run {i}:\nmake all"),
    "interview": ("<p><b>Q:</b> Why {i}?</p><p><b>A:</b> So {i}.</p><div>Q:</div><div>And {i}?</div>", "Q: Why {i}?\nA: So {i}.\nQ:\nAnd {i}?"),
    "terms": ("<dl><dt>Name<dd>N{i}<dt>Age<dd>{i}</dl>", "Name\nN{i}\nAge\n{i}"),
    "table": ("<table><tr><th>Year<th>Sum<tr><td>1990<td>{i}</table>", "Year\nSum\n1990\n{i}"),
    "price": ("<div class='share-price'>Price {i}</div><div class='share-price'>in euros</div>", "Price {i}\nin euros"),
    "section": ("<section><h2>Notes</h2><p>None.</p></section>", "Notes\nNone."),
}
AROUND = {
    "article": "<article>{}</article>",
    "form": "<form id='aspnetForm'><div class='top'><a href='/'>Start</a></div><div id='c'>{}</div><div class='base'>All the rest</div></form>",
    "form and main": "<form id='aspnetForm'><nav><a>Start</a></nav><main>{}</main></form>",
    "hidden": "<div id='app' hidden><nav>Start</nav><article>{}</article></div>",
    "aside": "<aside><p>About</p></aside><main>{}<aside>Short note</aside><form><label>Your mail</label></form></main>",
}


@pytest.mark.parametrize("n", [1, 2, 6])
@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("part", PARTS)
def test_articles_stay_whole(around, part, n):
    """Repeated headings, code, questions and terms, whole-page forms, few pages: the text is what it was made of."""
    if n == 1 and around == "form":
        return  # one page alone does not tell menu from text
    html, want = [], []
    for i in range(n):
        body, text = (x.format(i=i) for x in PARTS[part])
        html.append(f"<html><body>{AROUND[around].format(f'<h1>Head {i}</h1><p>{STORY[i % 3]} ({i})</p>{body}')}<div class='comments'>Well {i}</div></body></html>")
        want.append(f"Head {i}\n{STORY[i % 3]} ({i})\n{text}")
    roots = [html_wrapper.parse(p) for p in html]
    plan = html_wrapper.plan(html_wrapper.merged([html_wrapper.stream_of(r) for r in roots]))
    assert ["\n".join(html_wrapper.blocks(r, plan)) for r in roots] == want


@pytest.mark.parametrize("n", [2, 5])
def test_sentences_that_pages_share_stay(spark, n):
    html, want = pages(lambda story, i: f"<article>{story}<p>Reports come from the water board.</p><p>More on {i}.</p></article>", n)
    assert texts(spark, html) == [f"{w}\nReports come from the water board.\nMore on {i}." for i, w in enumerate(want)]


def test_short_pages_are_treated_as_their_sisters(spark):
    html, want = pages(lambda story, i: f"<article>{'<h1>Head 3</h1><p>Short.</p>' if i == 3 else story}<div>Share this story with your friends and with all of your neighbours</div></article>")
    want[3] = "Head 3\nShort."
    assert texts(spark, html) == want


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_generated_hosts(data):
    """A random template around random articles; the text is the articles'."""
    word = st.sampled_from("river mill stone water hill bridge evening year town market letter road".split())
    line = lambda a, b: " ".join(data.draw(st.lists(word, min_size=a, max_size=b)))
    menu = "".join(f"<li><a href='/'>{line(1, 2)}</a></li>" for _ in range(data.draw(st.integers(0, 5))))
    box = lambda: data.draw(st.sampled_from(["", "<div>{}</div>", "<div class='x1'><p>{}</p><p>again</p></div>", "<section><ul><li>{}</li></ul></section>"])).format(line(1, 4))
    around = data.draw(st.sampled_from(["<article>{}</article>", "<div class='c9'>{}</div>", "<main><div>{}</div></main>", "<table><tr><td>{}</td></tr></table>"]))
    top, base, before, after = f"<ul class='m'>{menu}</ul>{box()}", f"{box()}<p>made by hand</p>", box(), box()
    same = f"<h2>{line(1, 2)}</h2>"
    html, want = [], []
    for i in range(data.draw(st.integers(3, 6))):
        texts = [f"Head {i}", *(f"{line(8, 20)} {i} {k}" for k in range(data.draw(st.integers(2, 5))))]
        body = f"<h1>{texts[0]}</h1><p>{texts[1]}</p>{same}" + "".join(f"<p>{t}</p>" for t in texts[2:])
        texts.insert(2, same[4:-5])
        html.append(f"<body>{top}{around.format(before + body + after)}{base}</body>")
        want.append("\n".join(texts))
    roots = [html_wrapper.parse(p) for p in html]
    plan = html_wrapper.plan(html_wrapper.merged([html_wrapper.stream_of(r) for r in roots]))
    assert ["\n".join(html_wrapper.blocks(r, plan)) for r in roots] == want


def test_titles_and_names_within_the_story(spark):
    html, want = pages(lambda story, i: f"<header>Site {i}</header><article><div class='post-header share'>{story[: story.index('</h1>') + 5]}</div>{story[story.index('</h1>') + 5 :]}</article>")
    assert texts(spark, html) == want


def test_copies_keep_their_text(spark):
    """Near copies of one story on a host are no template, though most pages have its paragraphs."""
    story = "".join(f"<p>{x * 3}</p>" for x in STORY)
    html = [f"<body><div class='date'>{i}</div><article><h1>Head {i}</h1>{story}<p>{'changed ' * 60}{i}</p></article></body>" for i in range(6)]
    got = texts(spark, html)
    assert all(t.startswith(f"Head {i}\n{STORY[0]}") for i, t in enumerate(got))


@pytest.mark.parametrize("n", [3000, 100_000])
def test_deep_and_wide_pages(spark, n):
    html, want = pages(lambda story, i: f"<article>{story}</article>", 3)
    deep = "<html><body><article>" + "<div>" * n + "in the deep" + "</div>" * n + "</article></body></html>"
    wide = "<html><body><article>" + "".join(f"<p class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>x{i}</p>" for i in range(n)) + "</article></body></html>"
    ids = "<html><body><article>" + "".join(f"<div id='k{i:x}g'>x{i}</div>" for i in range(n)) + "</article></body></html>"
    got = texts(spark, [*html, deep, wide, ids])
    numbers = "\n".join(f"x{i}" for i in range(n))
    assert got[:3] == want and got[3] == "in the deep" and got[4] == numbers and got[5] == numbers


def test_wrappers_do_not_grow_with_pages():
    """Elements with an id of their own on each page do not stay in the wrapper."""
    w = None
    for i in range(300):
        ids = "".join(f"<section class='u{chr(97 + i % 26)}{chr(97 + i // 26)}x{chr(97 + j)}'>own {i} {j}</section>" for j in range(20))
        own = html_wrapper.wrapper_of(html_wrapper.parse(f"<body><nav>n</nav><article><p>text {i}</p>{ids}</article></body>"))
        w = own if w is None else html_wrapper.merged([w, own])
    assert sum(1 for _ in html_wrapper.walk(w)) <= html_wrapper.MAX_NODES and html_wrapper.region(w) == ("article", "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=90), st.lists(st.sampled_from("abcdefgh"), max_size=90))
def test_alignment_is_a_common_subsequence(x, y):
    x, y = [(c, "") for c in x], [(c, "") for c in y]
    found = html_wrapper.matched(x, y)
    assert all(x[i] == y[j] for i, j in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/pdivarticleh1 ='\"&;#!-x\n", max_size=200))
def test_any_text_is_a_page(page):
    html_wrapper.blocks(html_wrapper.parse(page))
    w = html_wrapper.wrapper_of(html_wrapper.parse(page))
    assert html_wrapper.expression(html_wrapper.unpacked(html_wrapper.packed(w))) == html_wrapper.expression(w)
