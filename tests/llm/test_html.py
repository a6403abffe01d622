import html
import re

import duckdb

from ringforge.llm.html_text import extract, main_text
from ringforge.llm.queries import QUERIES

LONG = "The quick brown fox jumps over the lazy dog, again and again, until it is tired of it."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_furniture_goes():
    body = f"""<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Site name</header><div class="cookie-notice">We use cookies, a lot of them, truly.</div>
    <main><article><h1>Title</h1><p>{LONG}</p><aside>Side note that is long enough to count as text.</aside><p>{LONG}&nbsp;&amp; more</p><form>Mail <input></form></article>
    <section id="comments"><p>I think, as a reader, that this article is wrong in many ways.</p></section></main><div class="ad">Buy now, buy today, buy here, never stop.</div><footer>&copy; x</footer>"""
    assert main_text(page(body)) == f"Title\n\n{LONG}\n\n{LONG} & more"


def test_scoring_without_semantic_tags():
    links = "".join(f"<li><a href=/{k}>A link with quite some text, number {k}</a></li>" for k in range(9))
    body = f'<div id="top"><ul>{links}</ul></div><div class="wrap"><div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div><div><ul>{links}</ul></div>'
    assert main_text(page(body)) == "Head\n\n" + "\n\n".join([LONG] * 3)


def test_siblings_are_kept():
    body = f"<div><h1>H</h1><div class=x><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><p><a href=a>{LONG}</a></p></div>"
    assert main_text(page(body)).split("\n\n")[-1] == LONG and main_text(page(body)).startswith("H\n\n")


def test_broken_markup():
    assert main_text(page(f"<article><p><b>{LONG}<br><p>two<p>three &lt;b&gt; &#233;&#x41;</article>")) == f"{LONG}\n\ntwo\n\nthree <b> éA"
    assert main_text("<p>" + LONG + "<!-- never closed <p>x") == LONG
    assert main_text(f"<article><p>{LONG}</p><script>never closed <p>x") == LONG
    assert main_text(f'<article><p>{LONG}</p><a href="x>unclosed quote</a>').startswith(LONG)
    assert main_text("<div>" * 5000 + LONG) == LONG
    assert main_text("just text") == "just text"
    assert main_text("") == main_text(None) == main_text("<html></html>") == ""


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", page(f"<article><p>{LONG * 3000}</p></article>"), "t"), (1, "u", "x", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, "u", len(LONG)), (2, None, 0), (None, "v", 0), (3, "w", len(LONG * 3000)), (1, "u", 1)], key=str)
    assert extract(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    want = {}
    for pid, h in duckdb.sql(f"select page_id, html from '{sf}/pages.parquet'").fetchall():
        a = h[h.index("<article>") : h.find("</article>")].replace("<br>", " ")
        want[pid] = "\n\n".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", y)).split()) for y in re.split(r"</?(?:article|h1|p)>", a)) if x)
    got = {r.page_id: r.text for r in QUERIES["op1_html_extraction"](spark, sf).collect()}
    assert got == want


def test_blocks_are_joined_by_two_line_ends(spark):
    body = page(f"<article><h1>Title</h1><p>{LONG}</p><p>{LONG}<br>more</p></article>")
    want = f"Title\n\n{LONG}\n\n{LONG} more"
    assert main_text(body) == want
    got = extract(spark.createDataFrame([(1, "u", body)], "page_id long, url string, html string")).first()
    assert (got.text, got.n_chars) == (want, len(want))


def test_names_that_only_may_mean_furniture():
    links = "".join(f"<a href=/{k}>Another story, number {k}</a> " for k in range(4))
    keep = "A paragraph of the article whose name is unlucky, with a comma or two."
    body = f"""<article><h1>T</h1><p>{LONG}</p><p class="search-results">{keep}</p><div class="related-story">{keep}</div><h2 id="search">Search</h2><section id="related-work"><p>{keep}</p></section>
    <p class="ad-hoc">{keep}</p><div class="social-science">{keep}</div><div class="related">{links}</div><div class="share">Share this</div><div class="ad-box">{keep}</div><p>x <math><mi>y</mi></math></p></article>"""
    assert main_text(page(body)).split("\n\n") == ["T", LONG, keep, keep, "Search", keep, keep, keep, "x y"]


def test_time_is_in_proportion_to_the_page():
    import time

    for unit in ("<div>", "<span>", "<div><p>", "<ul><li>", "<b><p>x", "<table><tr><td>", "</p>", "<a href=x>"):
        body = page(f"<p>{LONG}</p>" + unit * 20_000 + LONG)
        t = time.perf_counter()
        assert LONG in main_text(body)
        assert time.perf_counter() - t < 4, unit
