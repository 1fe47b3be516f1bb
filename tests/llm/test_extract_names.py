"""What of a page is its article: names, nesting, and votes of a host."""

from __future__ import annotations

import time

import pytest

from textsluice.llm import extract

P = "<p>" + "word " * 30 + "</p>"
WORDS = " ".join(["word"] * 30)


@pytest.mark.parametrize("name", ["article-comments", "post-comments", "comments-content", "main-sidebar", "content-ad", "entry-footer", "postComments", "advert",
                                  "share", "site-menu nav", "related", "cookie-notice", "newsletter-box", "content-sidebar"])
@pytest.mark.parametrize("form", ["<div class='{}'>no</div>", "<p class={!r}>no</p>", "<ul><li class='{}'>no</ul>", "<p>a <span id='{}'>no</span></p>",
                                  "<article class='{}'><p>no</p></article>", "<section class='x {}'><div><p>no</div></section>"])
def test_names_put_aside(name, form):
    assert "no" not in extract.main_text(f"<body><article>{P}{form.format(name)}<p>end</p></article></body>").split()


@pytest.mark.parametrize("name", ["social-network-history", "has-comments", "no-sidebar", "elementor-widget-post-content", "article-header", "header-image-text", "banner-story"])
def test_names_of_content_stay(name):
    assert "yes" in extract.main_text(f"<body><article>{P}<div class='{name}'>yes</div></article></body>").split()


def test_muted_elements_end_where_they_do():
    page = f"<body><article>{P}<p class=advert>buy<p>one<span class=ad>x<span>y</span>z</span>two<ul><li class=share>no<li>three</ul><b class='promo'>n<i>m</i></b>four</article></body>"
    assert extract.main_text(page) == f"{WORDS} one two three four".replace("one two", "onetwo")
    assert extract.main_text("<div class='comments'><p>only these</p></div>") == ""
    assert extract.main_text("<div class='widget'><p>only this</p></div>") == "only this"


def test_votes_do_not_lose_text(spark):
    usual = "<body><div class='story'>" + "<p>" + "s " * 80 + "</p></div></body>"
    odd = "<body><div class='post'><p>" + "p " * 80 + "</p></div><div class='story'>teaser</div></body>"
    rows = [(i, "http://h.org/%d" % i, usual) for i in range(20)] + [(99, "http://h.org/99", odd)]
    got = {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[99] == " ".join(["p"] * 80) and got[0] == " ".join(["s"] * 80)


def test_host_with_twenty_layouts(spark):
    def page(k, extra):
        return f"<body><div class='lay{'abcdefghijklmnopqrst'[k]}'><p>" + f"w{k} " * 40 + f"</p></div><div class='zone'>{'z ' * extra}</div></body>"
    rows = [(20 * i + k, "http://h.org/", page(k, 70 if (i, k) == (3, 5) else 1)) for k in range(20) for i in range(4)]
    got = {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[20 * i + k] == " ".join([f"w{k}"] * 40) for k in range(20) for i in range(4))


def test_deep_and_long_pages_take_seconds():
    begin = time.process_time()
    deep = "<div>" * 100_000 + "text" + "</div>" * 100_000
    assert extract.main_text(deep) == "text"
    assert extract.main_text("<p class=ad>" * 50_000 + "</p><p>x") == "x"
    assert extract.main_text("<span class=ad>" * 20_000 + "y" + "</span>" * 20_000 + "z") == "z"
    assert time.process_time() - begin < 20
