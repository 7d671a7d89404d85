"""Elements that hold article text in spite of a boilerplate word in their class, id or role."""

import json

import pytest
from pyspark.sql import functions as F

from labelmill.llm import wrappers

SHELL = "<html><body{body}><nav><p>Menu</p></nav>{before}<article{article}><h1>Title</h1>{inside}<p>End</p></article></body></html>"


def shell(inside="", body="", article="", before=""):
    return SHELL.format(inside=inside, body=body, article=article, before=before)


def text(html, seen=()):
    return wrappers.main_text(html, wrappers.Wrapper(wrappers.infer([*seen] or [html])))


@pytest.mark.parametrize("page, want", [
    (shell(body=' class="no-sidebar"'), "Title\n\nEnd"),
    (shell(body=' class="sidebar search"'), "Title\n\nEnd"),
    (shell(article=' class="post comments-open"'), "Title\n\nEnd"),
    (shell('<h2 id="related-work">Related work</h2>'), "Title\n\nRelated work\n\nEnd"),
    (shell('<h2 id="comments">Comments</h2>'), "Title\n\nComments\n\nEnd"),
    (shell('<p id="side-effects">Nausea</p>'), "Title\n\nNausea\n\nEnd"),
    (shell('<section id="search-algorithms"><p>Depth first</p></section>'), "Title\n\nDepth first\n\nEnd"),
])
def test_article_text_is_kept(page, want):
    assert text(page) == want
    assert text(page, [page] * 3) == want
    assert text(page, [shell()] * 3) == want


def test_names_in_the_article_need_several_pages():
    named = [shell(f'<div class="x related"><p>More {i}</p></div>') for i in range(3)]
    assert text(named[0], named) == "Title\n\nEnd"
    assert text(named[0], named[:1]) == text(named[0], [named[1], shell()]) == "Title\n\nMore 0\n\nEnd"
    # A page that the expression does not match follows the host too.
    odd = shell('<blockquote><p>Odd</p></blockquote><div class="related"><p>More</p></div>')
    assert text(odd, named) == "Title\n\nOdd\n\nEnd"
    # The name counts on pages outside the article only: nothing is known about it in the article.
    before = shell(before='<div class="related"><p>Before</p></div>')
    assert text(named[0], [before] * 3) == "Title\n\nMore 0\n\nEnd"


def test_names_outside_articles():
    page = '<body><div class="cookie-notice"><p>We use cookies</p></div><div class="page side-effects"><p>Text</p></div></body>'
    assert text(page) == "Text"


def test_wrapper_is_inferred_from_all_pages_of_a_host(spark):
    """A name that only two of a host's many pages show, and a page of its own kind, are in the host's wrapper."""
    plain = "<nav>menu</nav><article><h1>t{0}</h1><p>a</p></article>"
    named = "<nav>menu</nav><article><h1>t{0}</h1><p>a</p><div class='related'><p>more</p></div></article>"
    rows = [(i, f"https://h.example.com/{i}", (named if i in (70, 150) else plain).format(i)) for i in range(200)]
    rows.append((200, "https://h.example.com/200", "<article><h1>t</h1><table><tr><td>x</td></tr></table></article>"))
    # Once there, whether in one row or in two, is not shown.
    rows += 2 * [(300, "https://once.example.com/1", named.format(1))] + [(301, "https://once.example.com/2", plain.format(2))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in wrappers.extract(pages).collect()}
    assert got[70] == "t70\n\na" and got[150] == "t150\n\na" and got[200] == "t\n\nx" and got[300] == "t1\n\na\n\nmore"
    hosted = pages.withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    for group in (2, 64):
        found = {r.host: wrappers.Wrapper(list(wrappers._tuples(json.loads(r.wrapper)))) for r in wrappers.host_wrappers(hosted, group).collect()}
        assert set(found) == {"h.example.com", "once.example.com"}
        for _, _, html in rows[69:71] + rows[200:201]:
            assert found["h.example.com"]._match(wrappers.read_tokens(html)[0])


def test_merged_wrappers_hold_what_each_of_them_holds():
    own = [wrappers.shape(wrappers.read_tokens(f"<article><p>a</p>{x}</article>")[0], set()) for x in ("", "<ul><li>b</li></ul>", "<pre>c</pre>")]
    both = wrappers.merged([wrappers.merged(own[:2]), wrappers.merged([own[0], own[2]])])
    assert all(wrappers.Wrapper(both).holds(w) for w in own)
    assert wrappers.merged([both, *own]) == both
