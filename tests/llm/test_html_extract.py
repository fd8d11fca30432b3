import time

import pytest

from weftgraph.llm import html_extract as H
from weftgraph.llm.html_extract import extracted, main_text

LONG = "This is a paragraph of the article, with commas, and with enough words to count as prose for anyone who reads it, now and later."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "noise",
    [
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav>",
        "<header><div>Site</div></header>",
        "<footer>&copy; Someone</footer>",
        "<aside><p>" + LONG.replace("article", "aside") + "</p></aside>",
        "<div class='cookie-notice'><p>We use cookies, many of them, everywhere, always.</p></div>",
        "<div class='ad'>Buy now, cheap, good.</div>",
        "<form><p>Your name, please, and address, too.</p><input></form>",
        "<script>var t='</p>';</script><style>p{}</style><!-- <p>hidden</p> -->",
        "<section id='comments'><p>" + LONG.replace("article", "comment") + "</p></section>",
        "<div id='sidebar'><p>Latest news, of today, and tomorrow.</p></div>",
        "<div role='navigation'>Menu</div>",
        "<div style='display: none'>Secret</div>",
    ],
)
@pytest.mark.parametrize("shape", ["<article><h1>Head</h1>{}</article>", "<div class='content'><h1>Head</h1>{}</div>", "<main><div><h1>Head</h1>{}</div></main>", "<div><div><h1>Head</h1>{}</div></div>"])
def test_noise_goes_and_the_article_stays(shape, noise):
    body = shape.format(f"<p>{LONG}</p>{noise}<p>{LONG} &amp; more</p>")
    expected = f"Head {LONG} {LONG} & more"
    assert main_text(page(noise + body + noise)) == expected


def test_white_space_references_and_inline_markup():
    text = f"<article><p>a<b>b</b>c&nbsp;&lt;d&gt;\n\t e &#233;<br>f</p><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>"
    assert main_text(page(text)) == f"abc <d> e é f {LONG} one two x y"


def test_pages_that_are_cut_or_broken():
    assert main_text(f"<article><p><b>{LONG}<br><p>{LONG}</p><p>rest") == f"{LONG} {LONG} rest"
    assert main_text(f"<article><p>{LONG}</p><p>tail <a hre") == f"{LONG} tail"
    assert main_text(f"<div><span><p>{LONG}</div></span></p>") == LONG
    assert main_text("just words") == "just words"


def test_siblings_that_look_like_the_article():
    body = f"<div><div><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><div class='links'><a href='x'>{LONG}</a></div></div>"
    assert main_text(page(body)) == f"{LONG} {LONG} {LONG}"


def test_defined_cases(spark):
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", "<p></p>", "x"), (4, "u", deep, "x"), (4, "u", deep, "x"), (None, None, f"<p>{LONG}</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted(((r.page_id or 0), r.url, r.text, r.n_chars) for r in extracted(df).collect())
    n = len(LONG)
    assert found == [(0, None, LONG, n), (1, "u", "", 0), (2, "u", "", 0), (3, "u", "", 0), (4, "u", LONG, n), (4, "u", LONG, n)]
    assert extracted(df.where("page_id < 0")).count() == 0


@pytest.mark.parametrize("names", ["class='site no-sidebar'", "class='content has-sidebar'", "class='main with-comments'", "id='hasSidebar'", "class='content right-sidebar'", "class='page-with-header'", "class='sidebar'", "id='form-wrap'"])
def test_names_around_the_article_do_not_drop_it(names):
    body = f"<div {names}><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><div class='site-footer'><p>Contact us, or call.</p></div>"
    assert main_text(page(body)) == f"Head {LONG} {LONG}"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='content'>{}</div>"])
def test_headings_and_paragraphs_named_after_regions_stay(wrap):
    body = wrap.format(f"<h2 class='section-header'>Head</h2><p>{LONG}</p><p class='feedback'>{LONG}</p><p class='ad'>Buy now.</p><div class='share-buttons'>Share</div>")
    assert main_text(page(body)) == f"Head {LONG} {LONG}"


def test_named_elements_that_hold_the_main_element_stay():
    body = f"<div class='sidebar'><main><p>{LONG}</p></main></div><div class='comments'><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page(body)) == LONG


ARTICLE = "<h1>Title here</h1><p>First, long paragraph of the article, with commas, and text enough to count.</p><p>Second one, also long enough to count as a paragraph.</p>"
WANTED = "Title here First, long paragraph of the article, with commas, and text enough to count. Second one, also long enough to count as a paragraph."


def test_scores_decide_where_no_tag_says_article():
    links = "".join(f"<li><a href='/{i}'>Link number {i}, with words, and commas, in it</a></li>" for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div><div>{ARTICLE}</div><div><ul>{links}</ul></div></div></body>"
    assert H.main_text(page) == WANTED
    several = f"<body><article>Short teaser of another, longer text.</article><div>{ARTICLE}</div></body>"
    assert WANTED in H.main_text(several)


def test_layout_names_and_forms_around_the_article():
    for name in ("content with-sidebar", "no-sidebar", "main-content has-header", "article-form", "post hidden-xs", "story social"):
        assert H.main_text(f'<body><nav>Menu</nav><div class="{name}"><article>{ARTICLE}</article></div><footer>foot</footer></body>') == WANTED, name
    assert H.main_text(f"<body><form><nav>Menu</nav><div><article>{ARTICLE}</article></div><label>Name</label></form></body>") == WANTED
    assert H.main_text(f"<body><article>{ARTICLE}<form><p>Your comment, please</p><label>Name</label></form></article></body>") == WANTED
    deep = ARTICLE.replace("<h1>Title here</h1>", "<header><div><h1>Title here</h1><p>By someone</p></div></header>")
    assert H.main_text(f"<body><article>{deep}</article></body>") == WANTED


def test_points_reach_every_ancestor():
    root = H.parse("<div>" * 200 + "<p>A paragraph with words, commas, and length enough.</p>" + "</div>" * 200)
    order = H._scored(root)
    divs = [x for x in order if x.tag == "div"]
    points = next(x.points for x in order if x.tag == "p")
    assert divs[-1].near == points and divs[-2].far == points / 2
    assert all(abs(a.far - b.far / 3) < 1e-12 for a, b in zip(divs[:-3], divs[1:-2], strict=True)) and divs[0].far > 0


def test_time_grows_with_the_length():
    started = time.process_time()
    H.main_text("<article>" + "<blockquote>" * 8000 + "text, enough of it to be counted" + "</p></div>" * 8000)
    H.main_text("<b>" * 8000 + "<p>text, enough of it to be counted" * 8000 + "</i></u>" * 8000)
    assert time.process_time() - started < 5


def test_ties_go_to_the_first():
    half = "<p>Words of a paragraph, and a comma, and enough of them.</p>"
    root = H.parse(f"<body><div><section><div>{half}</div></section></div><div><section><div>{half}</div></section></div></body>")
    order = H._scored(root)
    best = max(order, key=lambda x: x.score)
    again = [x for x in order if x.score == best.score]
    assert len(again) > 1 and best is again[0]
