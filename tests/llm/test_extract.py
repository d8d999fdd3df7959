import itertools
import random

import pytest

from skyledger.llm.extract import extract_text, least_cut, main_text

ARTICLE = (
    "<article><h1>A  title</h1><p>First <b>bold</b> words &amp; more of the story that goes on."
    "<p>Second paragraph, left open, with <a href='/x'>a link</a> and a good many other words."
    "<ul><li>one point of the list<li>another point of the list</ul></article>"
)
TEXT = (
    "A title First bold words & more of the story that goes on. Second paragraph, left open, with a"
    " link and a good many other words. one point of the list another point of the list"
)
LONG = "This sentence is as long as any sentence of the article and has no link in it at all. "


def page(before="", after="", inside=""):
    body = ARTICLE.replace("</article>", inside + "</article>")
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{body}{after}</body></html>"


@pytest.mark.parametrize(
    "junk",
    [
        "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>",
        f"<header><p>{LONG}</p></header>",
        f"<footer>&copy; {LONG}</footer>",
        f"<aside><p>{LONG}</p></aside>",
        f"<div class='ad'>{LONG}</div>",
        f"<div class='sidebar left'><p>{LONG}</p></div>",
        f"<div id=cookie-notice><p>{LONG}</p></div>",
        f"<section class=\"comments\"><article class='comment'><p>{LONG}</p></article></section>",
        f"<div id='commentList'><p>{LONG}{LONG}</p></div>",
        f"<form><label>{LONG}</label><input name=q><button>Go</button></form>",
        "<script>var t='</p><p>x</p>'; if (a<b) {}</script>",
        "<style>p > a {color: red}</style>",
        f"<!-- {LONG} <p> -->",
        f"<div role='navigation'>{LONG}</div>",
        f"<div hidden><p>{LONG}</p></div>",
        f"<div style='display: none'>{LONG}</div>",
        f"<noscript>{LONG}</noscript>",
        f"<div class='related-posts'><p>{LONG}</p></div>",
    ],
)
def test_boilerplate_goes(junk):
    assert main_text(page(before=junk)) == TEXT
    assert main_text(page(after=junk)) == TEXT
    assert main_text(page(inside=junk)) == TEXT


def test_markup_oddities():
    assert main_text("") == ""
    assert main_text("no tags at all but a few words in it") == "no tags at all but a few words in it"
    assert main_text(page(inside="<p>a<br>b &lt;c&gt; &#233;&nbsp;x</p>")) == TEXT + " a b <c> é x"
    assert main_text(page(inside="<p>open <b>until<p>the end")) == TEXT + " open until the end"
    assert main_text("<p>" * 5000 + "deep words here</p>") == "deep words here"
    assert main_text("<article><p>1 < 2 and words") == "1 < 2 and words"
    assert main_text("<article><p>text <unclosed 'quote</p><p>the end") == "text the end"
    assert main_text("<article><p>text <never closed") == "text <never closed"
    assert main_text("<article><div><div>" * 300 + "<p>" + LONG) == LONG.strip()


def test_the_title_in_an_articles_header_stays():
    header = f"<article><header><h2>The title</h2><p>By someone, {LONG}</p></header><p>{LONG}</p></article>"
    assert main_text(header) == f"The title {LONG.strip()}"


def test_a_page_without_an_article():
    body = f"<div class=menu><a href=/>x</a></div><div><h2>On words</h2><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(f"<body>{body}<div class=footer>{LONG}</div></body>") == (
        f"On words {LONG.strip()} {LONG.strip()}"
    )


def cost(label, odds, links):
    alone = sum(o for o, x in zip(odds, label) if o > 0 and not x)
    alone += sum(-o for o, x in zip(odds, label) if o < 0 and x)
    return alone + sum(w for a, b, w in links if label[a] != label[b])


def test_the_cut_is_least():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 9)
        odds = [rng.randrange(-9, 10) for _ in range(n)]
        pairs = list(itertools.combinations(range(n), 2))
        links = [(a, b, rng.randrange(1, 9)) for a, b in pairs if rng.random() < 0.5]
        least = min(cost(x, odds, links) for x in itertools.product([False, True], repeat=n))
        label = least_cut(odds, links)
        assert cost(label, odds, links) == least
        smallest = [
            x for x in itertools.product([False, True], repeat=n) if cost(x, odds, links) == least
        ]
        assert sum(label) == min(map(sum, smallest))


def test_neighbours_decide_a_doubtful_block():
    text = f"<p>{LONG}</p>"
    assert main_text(f"<main>{text}<p>Hm.</p>{text}</main>").split()[17:19] != []
    assert "Hm." in main_text(f"<main>{text}<p>Hm.</p>{text}</main>")


def test_odd_tables(spark):
    rows = [(1, "u", page(), 5), (2, None, None, None), (3, "u", "", 1), (None, "v", page(), 5), (1, "u", page(), 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, N_CHARS int")
    got = extract_text(df)
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    found = {(r.page_id, r.url, r.text, r.n_chars) for r in got.collect()}
    assert found == {(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "u", "", 0), (None, "v", TEXT, len(TEXT))}
    assert got.count() == 5 and extract_text(df.filter("false")).count() == 0


STORY = " ".join(f"Sentence {i} of a story that has no link in it at all." for i in range(5))


@pytest.mark.parametrize(
    "html",
    [
        f"<div class='site has-sidebar'><article><p>{STORY}</p></article></div>",
        f"<div class='site no-sidebar'><div><p>{STORY}</p></div></div>",
        f"<div class='layout sidebar-left'><article><p>{STORY}</p></article></div>",
        f"<div class='layout sidebar-left'><div><p>{STORY}</p></div></div>",
        f"<div id='page-nav-menu'><div class='widget'><main><p>{STORY}</p></main></div></div>",
        f"<article class='post tag-privacy category-search'><p>{STORY}</p></article>",
        f"<article class='post privacy search'><p>{STORY}</p></article>",
        f"<article class='post comments-closed'><p>{STORY}</p></article>",
        f"<main class='sidebar-right'><article class='social'><p>{STORY}</p></article></main>",
    ],
)
def test_names_around_the_main_text_do_no_harm(html):
    junk = (
        f"<section class=comments><article class=comment><p>{LONG}</p></article></section>"
        f"<div class='related-posts'><article class=post><p>{LONG}</p></article></div>"
        "<div class='sidebar'><a href=/>Home</a></div>"
    )
    assert main_text(f"<body>{html}</body>") == STORY
    if "comments-closed" not in html:
        assert main_text(f"<body>{html}{junk}</body>") == STORY
        inside = html.replace("</p>", "</p>" + junk)
        assert main_text(f"<body>{inside}</body>") == STORY


def test_asides_that_hold_articles_go():
    card = f"<div class='related'><article><p>{LONG}</p></article></div>"
    thread = f"<ol class=comments><li><article><p>{LONG * 9}</p></article></li></ol>"
    story = f"<div id=page><p>{STORY}</p></div>"
    assert main_text(f"<body>{story}{card}{thread}</body>") == STORY
    assert main_text(f"<body><main><p>{STORY}</p>{card}{thread}</main></body>") == STORY
