"""Consensus of hosts, and marks that must not cost the article."""

import pytest

from tremor.llm import html_consensus

SCHEMA = "page_id bigint, url string, html string"


def texts(spark, pages):
    return {r.page_id: r.text for r in html_consensus.extract_pages(spark.createDataFrame(pages, SCHEMA)).collect()}


def test_the_host_overrules_an_odd_page(spark):
    even = '<div class="main-col">{}</div><div class="extra">{}</div>'
    pages = [(i, "http://h.example/x", even.format("article words, here " * 40, "short")) for i in range(6)]
    odd = even.format("tiny article", "long list of things, " * 60)
    pages += [(9, "http://h.example/y", odd), (10, None, odd)]
    # null urls are no host: these would outvote page 10
    pages += [(20 + i, None, pages[0][2]) for i in range(6)]
    got = texts(spark, pages)
    assert got[9] == "tiny article" and got[0].startswith("article words")
    assert got[10].startswith("long list")


def test_many_templates_are_no_consensus(spark):
    """Six templates of equal weight: each page keeps its own best container."""
    page = '<div class="{}">{}</div><div class="a">short</div>'
    pages = [(10 * k + i, "http://h.example/", page.format(c, f"words of {c}, and more " * 40)) for k, c in enumerate("bcdefg") for i in range(3)]
    got = texts(spark, pages)
    assert all(got[10 * k + i].startswith(f"words of {c}") for k, c in enumerate("bcdefg") for i in range(3))


ARTICLE = "<p>" + "running words of the article, " * 12 + "</p>"
WANT = " ".join(("running words of the article, " * 12).split())


@pytest.mark.parametrize("page, want", [
    (f"<body><div class='site has-sidebar'><article>{ARTICLE}</article></div><footer><a href=x>foot</a></footer></body>", WANT),
    (f"<body><div class='no-sidebar'><main>{ARTICLE}</main><div class='sidebar'><p>side</p></div></div><div><a href=x>foot</a></div></body>", WANT),
    (f"<body><div id='content-with-ads'><div>{ARTICLE}</div></div><footer>foot</footer></body>", WANT),
    (f"<article>{ARTICLE}<h2 id='related-work'>Related work</h2><section id='discussion'><p>one</p></section><section id='search'><p>two</p></section></article>",
     WANT + " Related work one two"),
    (f"<div class='post'>{ARTICLE}<section id='navigation'><p>three</p></section><section id='comments'><p>no</p></section></div>", WANT + " three"),
    (f"<main>{ARTICLE}</main><div class='related'><article><p>a teaser</p></article></div>", WANT),
    ("<body><nav>no</nav><div class='alert'><a href=x>some links</a></div><div><a href=y>and more</a></div></body>", "some links and more"),
])
def test_words_do_not_cost_the_article(page, want):
    assert html_consensus.extract(page, [html_consensus.vote(page)[0]]) == want
