"""Main text of pages in odd markup, and along several layouts."""

import time

import numpy as np
import pytest

from packaudit.llm import html_extract
from packaudit.llm.html_extract import Forest, Page, tokens

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, text string, lang string, _html string"


def leaves(html):
    page = Page(html)
    return [(t, page.tag[page.parent[i]]) for i, t in enumerate(page.text) if t is not None]


def under(html, text):
    """Tags from the leaf with this text up to the root."""
    page = Page(html)
    i, out = page.text.index(text), []
    while (i := page.parent[i]) >= 0:
        out.append(page.tag[i])
    return out


@pytest.mark.parametrize("close", ["</div>", ""])
def test_a_thousand_nested_blocks(close):
    html = "<body><article>" + "<div>" * 1000 + "deep" + close * 1000 + "<p>behind</p></article><footer>end</footer></body>"
    assert under(html, "behind").count("article") == 1 and "article" not in under(html, "end")
    assert under(html, "deep").count("div") == 1000


@pytest.mark.parametrize("tag", ["svg", "object", "canvas", "noscript", "iframe", "template"])
def test_text_behind_an_element_that_is_never_closed(tag):
    html = f"<article><p>one</p><{tag} width='3'><p>two</p></article><p>three</p>"
    assert [t for t, _ in leaves(html)] == ["one", "two", "three"]
    assert "article" in under(html, "two") and "article" not in under(html, "three")


def test_code_that_is_never_closed():
    assert [t for t, _ in leaves("<p>one</p><script>var x = 1 < 2;<p>two</p>")] == ["one", "two"]
    assert [t for t, _ in leaves("<p>one</p><style>a{}")] == ["one"]
    assert [t for t, _ in leaves("<p>one</p><script>if (a < b) {}</script>two<svg><path d='M0'/>x</svg>")] == ["one", "two"]


def test_quotes_comments_and_ends():
    assert [t for t, _ in leaves('<p title="a > b">one</p><p class=x>two<!-- <p>no</p> --></p><!-- open > <p>three &amp; 3</p>')] == ["one", "two", "three & 3"]
    assert leaves('<a "x">one</a>')[0][0] == "one"
    assert leaves('<p class="x>one</p><p>two</p>')[0][0] == "one"
    assert [t for t, _ in leaves("1 < 2 and <b>3</b> <p")] == ["1 < 2 and 3 <p"]


@pytest.mark.parametrize("piece", ['<a "', "<a '", '<a x="', "<!--", "<", "</", "<svg>", "<script>", '<p x="y\'', "< a=\"'>", "<div>", "</div>", "<li>", "&amp"])
def test_a_megabyte_is_parsed_in_linear_time(piece):
    def seconds(n):
        began = time.process_time()
        Page(piece * (n // len(piece)))
        return time.process_time() - began

    assert seconds(1_000_000) < 20 * max(seconds(100_000), 0.05) + 2


def test_tokens_cover_what_they_say():
    html = "a<p class='x'>b</p><!-- c --><br/>d<!doctype x>"
    assert [(html[a:b], end, tag) for a, b, end, tag, _ in tokens(html)] == [("<p class='x'>", "", "p"), ("</p>", "/", "p"), ("<!-- c -->", "", None), ("<br/>", "", "br"), ("<!doctype x>", "", None)]


def test_hashed_names_are_features():
    """A forest can learn a name that no list has."""
    pages = [Page(f"<body><div class='{'zq' if i % 2 else 'kw'}'>some text of this block</div></body>") for i in range(40)]
    x = np.concatenate([p.features() for p in pages])
    y = np.concatenate([[0, 0, i % 2, i % 2] for i in range(40)]).astype(float)
    p = Forest.fit(x, y).probability(x)
    assert ((p > 0.5) == (y > 0.5)).all()


@pytest.fixture(scope="module")
def forest(spark):
    return html_extract.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_layouts_without_an_article(forest):
    """Held-out layouts: names in place of elements, several parts around, comments with long text."""
    say = [f"Sentence number {i} of the story goes on, with some more words in it." for i in range(12)]
    body = "".join(f"<p>{s}</p>" for s in say)
    around = "<div class='navbar'><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></div>"
    aside = "<div id='sidebar'><h3>More</h3><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div>"
    comments = "<div class='comments'><h3>Comments</h3><div class='comment'><p>I read all of this and it is a good one, thank you.</p></div></div>"
    for html in (
        f"<html><body>{around}<div class='post'>{body}</div>{aside}<div class='footer'>Copyright</div></body></html>",
        f"<html><body>{around}<main><div class='entry-content'>{body}</div></main>{comments}<footer>Terms</footer></body></html>",
    ):
        page = Page(html)
        assert page.decoded(forest.probability(page.features())) == "\n".join(say)


def test_odd_rows(spark, forest):
    rows = [(1, "u", None, "t", "x", "y"), (2, None, "", "t", "x", "y"), (None, "u", "<p>", None, None, None), (3, "u", "plain text", "t", "x", "y"), (3, "u", "plain text", "t", "x", "y")]
    got = html_extract.extract(spark.createDataFrame(rows, SCHEMA), forest=forest).collect()
    assert sorted((r["page_id"] or 0, r["url"]) for r in got if r["text"] == "") >= [(0, "u"), (1, "u")]
    assert len(got) == 5 and got[0].asDict().keys() == {"page_id", "url", "text"}
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).count() == 0
