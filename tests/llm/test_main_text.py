from __future__ import annotations

import html
import re

import pytest

from fleetmatch.llm import main_text
from fleetmatch.llm.main_text import Scorer, built_in, weighed
from tests.conftest import SF

LONG = "Words of the first paragraph of the article go on for a while, with <b>bold</b> ones and <a href='/x'>links</a> in between."
LONG_TEXT = "Words of the first paragraph of the article go on for a while, with bold ones and links in between."
ARTICLE = f"<h1>The title</h1><p>{LONG}</p><p>Second &amp; last paragraph &lt;here&gt;.</p>"
TEXT = f"The title\n{LONG_TEXT}\nSecond & last paragraph <here>."
MENU = "<ul><li><a href='/a'>Home page</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Contact</a></li></ul>"
COMMENTS = "".join(f"<div class='comment'><p>Reader {k} says a lot of things about this, more than the article itself does say.</p></div>" for k in range(9))


def text(source):
    return main_text.main_text(source, Scorer(built_in()))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav>{MENU}</nav><article>{ARTICLE}</article><footer>&copy; someone and others, all rights reserved, of a long text in here</footer>",
        f"<body><header><h1>Site</h1>{MENU}</header><main>{ARTICLE}</main><aside><p>Other things to read here</p></aside>",
        f"<body><div id=header>Site name</div><div class='post-content'>{ARTICLE}</div><div id='sidebar'>{MENU}<p>Some long text of a sidebar that is here.</p></div>",
        f"<body><div class='cookie-banner'><p>We use cookies, do you agree to that or not?</p><button>Yes</button></div><div itemprop='articleBody'>{ARTICLE}</div>",
        f"<body><article>{ARTICLE}</article><section id='comments'><h2>Comments</h2>{COMMENTS}</section>",
        f"<body><article>{ARTICLE}<section class='comments'>{COMMENTS}</section></article>",
        f"<body><article><header class='entry-header'><h1>The title</h1></header>{ARTICLE[18:]}<footer class='entry-footer'>Share this</footer></article>",
        f"<body><form id='all'><div class='x1'>{MENU}</div><div class='x2'>{ARTICLE}</div></form>",
        f"<body><div class='x1'>{MENU}</div><div class='x2'>{ARTICLE}</div><div class='x3'>A short line</div>",
        f"<table><tr><td>{MENU}</td><td>{ARTICLE}</td></tr></table><div>Imprint</div>",
        f"<body class='has-sidebar comments-open'><main><form action='/s'><label>Search this site</label><p>For all of it</p></form>{ARTICLE}<div class='newsletter-signup'><p>Get our news by mail every week.</p></div></main>",
        f"<ARTICLE CLASS=post>{ARTICLE}</ARTICLE><script>var x = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><noscript><p>no</p></noscript>",
        f"<nav><a href='a'>Open link<ul><li>Menu</nav><article><b>{ARTICLE}</article></b><div class=ad>Buy this now</div>",
    ],
)
def test_layouts(page):
    assert text(page) == TEXT


def test_noise_inside_does_not_cut():
    parts = [f"<p>{LONG}</p><div class='ad'><p>{'Buy it. ' * 400}</p></div><aside><ul><li>Read this</li></ul></aside>" for _ in range(3)]
    assert text(f"<article>{''.join(parts)}</article>") == "\n".join([LONG_TEXT] * 3)


def test_references_white_space_and_odd_markup():
    assert text("<article><p>a&nbsp;b \n\t c<br>d</p>e &eacute;&#233;&#xE9; &amp;amp; &unknown; &am &copy 1 < 2 <3 <p title='a>b'>f<p>g</article>") == "a b c d\ne ééé &amp; &unknown; &am © 1 < 2 <3\nf\ng"
    assert text("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><dl><dt>t<dd>d</dl></article>") == "one\ntwo\na b\nc\nt\nd"
    assert text("<article><p>x<span>y</span>z <i> i </i></p></article>") == "xyz i"
    assert text("<article><p>text</p><script>unclosed <p>no") == "text"
    assert text("<article><p>text<!-- unclosed <p>no") == "text"
    assert text("<head><title>no</title><p>head left open</p>") == "head left open"


@pytest.mark.parametrize("page", [None, "", "   ", "<a", "<nav><a>x</a></nav>", "<script>x", "<p></p>", "<!--", "</p", "<p class='x"])
def test_pages_without_content(page):
    assert text(page) == ""


@pytest.mark.parametrize("page", ["<", "&", "< <", "1 < 2"])
def test_bare_signs_do_not_crash(page):
    assert isinstance(text(page), str)


def test_plain_text_page():
    assert text("just some words without any markup at all, ten or more") == "just some words without any markup at all, ten or more"


def test_weights_are_counted():
    """A name that labelled pages have outside content only turns its elements down; elsewhere it says nothing."""
    source = f"<div class='zulu'><p>{'word ' * 40}</p></div><div class='kilo'><p>{'text ' * 10}</p></div>"
    assert "word" in text(source)
    pages = ["<div class='zulu'><p>a b c d e f g</p></div><div class='kilo'><p><!--content-->a b c d e f g<!--/content--></p></div>"] * 5
    own = weighed(main_text.counted(pages))
    assert own[".zulu"] < -1 < 1 < own[".kilo"]
    assert main_text.main_text(source, Scorer(own)) == ("text " * 10).strip()


def test_table_against_its_markup(spark):
    """Pages of the table: what lies between the tags of their article, by a plain split."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    raw = {r.page_id: r for r in pages.collect()}
    rows = main_text.op12_main_text(spark, SF).collect()
    assert len(rows) == len(raw)
    for r in rows:
        inner = re.sub(r"</?(?:a|b)\b[^>]*>", "", re.search("<article>(.*)</article>", raw[r.page_id].html, re.S)[1]).replace("<br>", " ")
        lines = [" ".join(html.unescape(p).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == raw[r.page_id].url


def test_held_out_layouts(spark):
    """The same pages with their article and footer as plain containers of other names, or none."""
    scorer = Scorer(built_in())
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = main_text.main_text(r.html, scorer)
        for open_, close, foot in (("<div class=story-body>", "</div>", "<div id=site-footer>"), ("<main>", "</main>", "<div class=copyright>")):
            other = r.html.replace("<article>", open_).replace("</article>", close).replace("<footer>", foot).replace("</footer>", "</div>")
            assert main_text.main_text(other, scorer) == want


def test_columns(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "mine", 5, "t"), (2, None, None, None, None, None), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _main string, N_Chars int, TEXT string")
    out = main_text.extracted(df)
    assert out.columns == ["page_id", "url", "html", "_main", "text", "n_chars"]
    got = sorted(out.collect(), key=lambda r: r.page_id)
    assert [(r.text, r.n_chars, r._main) for r in got] == [(TEXT, len(TEXT), "mine"), ("", 0, None), ("", 0, None)]
    assert main_text.extracted(df.limit(0)).count() == 0


def test_long_pages():
    assert len(text("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>").split("\n")) == 5000
    assert text("<div>" * 3000 + "deep words here, more than ten of them, one two three" + "</div>" * 3000).startswith("deep")
    many = 30_000
    assert len(text("<div>" + "<b>word <i>of it <a>one</a><br>" * many + "</u>" * many)) > 3 * many
    assert text("<p>" + "<div>" * many + "many words in here, ten and more of them, really so" + "</b>" * many).startswith("many")
