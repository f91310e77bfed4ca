import random
import time

import pytest
from pyspark.sql import functions as F

from waypost.llm.html_text import WINDOW, extract_main_text, main_text, stretches

MENU = '<nav><ul><li><a href="/a">Home</a></li></ul></nav>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        (f"<body>{MENU}<article><h1>T &amp; U</h1><p>one\n  two</p><p>three<br>four</article><footer>&copy; x</footer>", "T & U\none two\nthree\nfour"),
        ('<article><p>a<script>var t="</p>";</script>b</p><style>p{}</style><!-- c --><p>&lt;d&gt; &eacute;&#233;&nbsp;e</p></article>', "ab\n<d> éé e"),
        ('<article><p>a</p><div class="ad box">buy</div><form>name</form><aside>side</aside><p>b <a href="#">c</a></p></article>', "a\nb c"),
        ('<main><header>top</header><p>a</p><section id="comments"><p>me too</p></section></main><p>outside</p>', "a"),
        ('<article><p>a</p><div class="ad">never closed <p>b</p></article>', "a\nnever closed\nb"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ('<article title="a>b"><p data-x=\'<p>\'>q</p></article>', "q"),
        ('<div id="page"><div class="top">t</div><div class="post-content"><h2>a</h2><div>b</div><div class="comment">c</div></div><p>d</p></div>', "a\nb"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_unmarked_page():
    body = "<p>A long paragraph with quite a few words in it, as articles have.</p>" * 3
    page = f'<div>{"<a href=x>menu item</a> " * 9}</div><p>hi</p><div></div><ul>{"<li><a href=y>link</a></li>" * 9}</ul>{body}<ul>{"<li><a href=z>more</a></li>" * 9}</ul><p>c</p>'
    assert main_text(page) == "\n".join(["A long paragraph with quite a few words in it, as articles have."] * 3)


def test_unmarked_page_with_one_huge_paragraph():
    short = [f"Short paragraph number {i} of the text." for i in range(20)]
    links = "".join(f"<ul><li><a href=y>link {i}</a></li></ul>" for i in range(5))
    lines = [*short[:10], "word " * 800 + "end", *short[10:], "The end."]
    paragraphs = [f"<p>{x}</p>" for x in lines]
    page = f"<p>hi</p>{links}{''.join(paragraphs[:5])}{links}{''.join(paragraphs[5:])}{links}<p>c</p>"
    assert main_text(page) == "\n".join(lines)


def test_stretches():
    assert stretches([0, 0, 0, 0, 9, 9, 0, 9, 0, 0, 0, 0, 1], 0) == [(4, 8), (12, 13)]
    assert stretches([], 0) == [] and stretches([0, 0], 0) == []
    weights = [0, 0, 0, 0, 9, 9, 0, 9, 0, 0, 0, 0, 1]
    assert stretches(weights, 5, [False] * 13) == [(4, 8)] and stretches(weights, 5, [False] * 12 + [True]) == [(4, 8), (12, 13)]


def line_blocks(weights, limit, sure, window):
    """The same by definition: maximal runs of windows with a positive sum."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        j = i
        while j < n and sums[j] > 0:
            j += 1
        if j > i and (max(sums[i:j]) > limit or any(sure[i:j])):
            own = [k for k in range(i, j) if weights[k]]
            out.append((own[0], own[-1] + 1))
        i = max(j, i + 1)
    return out


def test_stretches_by_definition():
    rng = random.Random(1)
    for _ in range(500):
        weights = [rng.choice([0, 0, 0, 0, 1, 5, 9]) for _ in range(rng.randint(0, 40))]
        sure = [w > 0 and rng.random() < 0.1 for w in weights]
        limit = rng.choice([0, 4, 8, 12])
        assert stretches(weights, limit, sure) == line_blocks(weights, limit, sure, WINDOW)


PARAGRAPHS = [f"Paragraph {i} of the article holds a sentence of ordinary length." for i in range(7)]


@pytest.mark.parametrize("mark", ["article", "section", 'div class="post"'])
def test_links_in_the_middle(mark):
    links = f"<ul>{'<li><a href=y>link</a></li>' * 9}</ul>"
    inner = "".join(f"<p>{x}</p>" for x in PARAGRAPHS[:3]) + links + "".join(f"<p>{x}</p>" for x in PARAGRAPHS[3:])
    page = f"{MENU}<{mark}>{inner}</{mark.split()[0]}><footer>foot</footer>"
    assert [x for x in main_text(page).split("\n") if x != "link"] == PARAGRAPHS
    assert main_text(page) == "\n".join(PARAGRAPHS)  # a menu is none of the text wherever it stands
    one = page.replace(links, "<p><a href=y>One link of the text</a></p>")
    assert main_text(one).split("\n") == [*PARAGRAPHS[:3], "One link of the text", *PARAGRAPHS[3:]]


@pytest.mark.parametrize("mark", ["article", "section", 'div class="post"'])
def test_a_short_last_block_counts(mark):
    links = f"<ul>{'<li><a href=y>link</a></li>' * 9}</ul>"
    page = f"{MENU}<{mark}>{''.join(f'<p>{x}</p>' for x in PARAGRAPHS)}{links}<p>The end.</p></{mark.split()[0]}>"
    assert main_text(page) == "\n".join([*PARAGRAPHS, "The end."])


@pytest.mark.parametrize("name", ["related-work", "notice-of-proof", "alert-fatigue", "login-howto", "comments-on-kant", "header-image-caption", "search-results-explained"])
def test_sections_named_by_what_they_tell(name):
    text = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    assert main_text(f'<article>{text}<section class="{name}"><p>More of it.</p></section></article>') == "\n".join([*PARAGRAPHS, "More of it."])


def test_names_of_containers():
    text = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    whole = "\n".join(PARAGRAPHS)
    for kept in ('<p class="market-share">', '<p class="comment">', '<div class="market-share">'):
        tag = kept[1:].split()[0]
        assert main_text(f"<article>{text}{kept}It rose.</{tag}></article>") == f"{whole}\nIt rose."
    for dropped in ("ad", "share-buttons", "left-sidebar", "box advert", "comment-list"):
        assert main_text(f'<article>{text}<div class="{dropped}"><p>Buy this.</p></div></article>') == whole
    # names that would leave nothing are ignored
    assert main_text(f'<div class="comment-page">{text}</div>') == whole
    # a few cards that are marked do not outweigh the text
    assert main_text(f"{text}<div><a href=x>1</a></div>" + "<article>See too</article>" * 2).startswith(whole)


@pytest.mark.parametrize(
    "page",
    [
        '<div class="ad">x ' * 50_000, '<div class="post">x ' * 50_000, "<b " * 300_000, '<b "' * 250_000, "<!x" * 300_000, "<script>" * 100_000, "</div>" * 150_000,
        "<nav>x</div>" * 80_000, "<a href='" * 100_000, "</script " * 100_000, "<!--" * 200_000, "&#" * 400_000, "<div " + "class= " * 150_000 + ">", "<ul><li>" * 120_000 + "</ul>" * 120_000,
    ],
)
def test_hostile_pages(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_table(spark):
    rows = [(1, "u", "<article>x</article>"), (2, None, None), (None, "u", ""), (3, "u", "<p>" + "word " * 200_000), (1, "u", "<article>x</article>")]
    df = spark.createDataFrame([(*r, "text") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.n_chars) for r in extract_main_text(df).collect())
    assert got == [("1", 1), ("1", 1), ("2", 0), ("3", 999_999), ("None", 0)]
    assert extract_main_text(df.where("page_id = 9")).count() == 0


@pytest.mark.parametrize("marked", [True, False])
def test_given_pages(spark, small, marked):
    """The article's text, got the plain way from these pages' single template; also where the page does not mark it."""
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    shown = pages if marked else pages.withColumn("html", F.regexp_replace("html", "</?article>", ""))
    texts = {r.page_id: r.text for r in extract_main_text(shown).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        inner = re.sub("</?b>", "", re.sub("</?(p|br|h1)>", "\n", inner))
        assert texts[r.page_id] == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in inner.split("\n")) if x)
