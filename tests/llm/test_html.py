"""Differencing of pages: the alignment, the neighbours whatever the partitioning, and what it decides."""

import html as html_lib
import re
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trendloom.llm import html_text


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=20), st.lists(st.sampled_from("abcdef"), max_size=20), st.sampled_from([0, 30, 1 << 24]))
def test_common_lines_are_a_longest_common_subsequence(a, b, table_bits):
    kept, rest = [x for x, s in zip(a, html_text.common_lines(a, b, table_bits)) if s], iter(b)
    assert len(kept) == longest(a, b) and all(x in rest for x in kept)


def address(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
    return (m[1].lower(), m[2]) if m else ("", "")


def brute_force(pages):
    """Each page against the nearest page on either side that has other lines, over the whole host, without Spark."""
    rows = sorted((*address(p["url"]), p["page_id"], html_text.page_lines(p["html"] or "")) for p in pages if address(p["url"])[0])
    content = [[t for z, t in r[3] if z != html_text.CHROME_ZONE] for r in rows]
    found = {p["page_id"]: (html_text.page_lines(p["html"] or ""), 0) for p in pages}
    for i, (host, path, page_id, lines) in enumerate(rows):
        near = []
        for step in (-1, 1):
            j = i + step
            while 0 <= j < len(rows) and rows[j][0] == host and content[j] == content[i]:
                j += step
            if 0 <= j < len(rows) and rows[j][0] == host:
                near.append(rows[j])
        if near:
            other = max(near, key=lambda r: html_text.common_start(r[1], path))
            texts, theirs = [t for _, t in lines], [t for _, t in other[3]]
            gone = html_text.template_lines([z for z, _ in lines], texts, theirs)
            assert sum(html_text.common_lines(texts, theirs)) == longest(texts, theirs)
            found[page_id] = ([x for k, x in enumerate(lines) if k not in gone], len(gone))
    return {k: ("\n".join(t for z, t in lines if z != html_text.CHROME_ZONE), n) for k, (lines, n) in found.items()}


@pytest.mark.parametrize("marked", [True, False])
def test_every_page_against_brute_force_and_any_partitioning(spark, marked):
    """All pages of sf0.01, and all of them with the marks of their articles stripped."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    if not marked:
        for p in pages:
            p["html"] = re.sub("</?article>", "", p["html"])
    pages += [p | {"page_id": p["page_id"] + 10**6} for p in pages[:20]]  # copies at the same address
    want, results = brute_force(pages), []
    df = spark.createDataFrame([(p["page_id"], p["url"], p["html"]) for p in pages], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append({r.page_id: (r.text, r.n_template) for r in html_text.extract_text(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert results[0] == results[1] == want
    assert sum(n > 0 for _, n in want.values())


def test_differencing_finds_templates_that_nothing_marks(spark):
    """A short article under a large template of plain blocks, on a host with runs of copies."""
    template = "".join(f"<div>Template line {i}, as on every page of this site</div>" for i in range(30))
    page = lambda own: f'<html><body><div>Top of the site</div>{own}{template}<script>var a = "<p>no</p>";</script></body></html>'
    rows = [(i, f"http://plain.example/a/{i:03d}", page(f"<p>Story {i // 10} is told here, and &amp; only here.</p>")) for i in range(60)]
    rows += [(1000, "http://alone.example/", page("<p>Alone</p>")), (1001, None, page("<p>No address</p>")), (1002, "http://plain.example/zz", None)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert all(got[i] == f"Story {i // 10} is told here, and & only here." for i in range(60))
    assert got[1000].startswith("Top of the site\nAlone\nTemplate line 0") and got[1001].startswith("Top of the site\nNo address") and got[1002] == ""


def test_marked_articles_that_quote_each_other_stay_whole(spark):
    quote = "<p>Both pages quote this line.</p>"
    rows = [(i, f"http://q.example/{i}", f"<nav>Home</nav><article><h1>T{i}</h1>{quote}</article><div>About us</div>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"T{i}\nBoth pages quote this line." for i in range(3)}


@pytest.mark.parametrize("html", ["<a '\"" * 20_000, '<a ">"' * 20_000 + "'", "<script>" + "</script " * 20_000, "<!--" * 20_000, "<a b='" * 20_000 + ">", "<div class=ad>" * 20_000 + "<span>" * 20_000])
def test_broken_pages_take_time_in_proportion(html):
    began = time.perf_counter()
    html_text.page_lines(html)
    assert time.perf_counter() - began < 3


def test_html_keeps_articles_whole(spark, sf):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    rows = html_text.op7_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id]["html"], re.S)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", b))).split()) for b in re.split(r"</?(?:p|h1|h2|ul|li|div)\b[^>]*>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("html,want", [
    ('<article><p class="share price">The share price rose.</p></article>', "The share price rose."),
    ('<article><div class="related work">Others did this before.</div></article>', "Others did this before."),
    ('<article><section class="login">How to log in safely.</section><p>End.</p></article>', "How to log in safely.\nEnd."),
    ('<article><p>Text.</p><div class="related"><a href="a">One story</a><a href="b">Another</a> by us</div><p>More.</p></article>', "Text.\nMore."),
    ('<article><p>Text.</p><div class="share"><ul><li><a>Mail</a></li><li><a>Post</a></li></ul></div></article>', "Text."),
    ('<article><p>Text.</p><div class="share"><a>x</a></article>', "Text."),
    ('<article><p>Text.</p><div class="comments"><p>First!</p></div></article>', "Text."),
    ('<div class="related">Outside of it.</div><article><p>Text.</p></article>', "Text."),
    ('<p class="ad">A paragraph is no container.</p>', "A paragraph is no container."),
    ('<div class="ad">Buy.</div><p>Text.</p>', "Text."),
])
def test_class_words_need_a_container_and_in_an_article_links(html, want):
    assert html_text.main_text(html_text.page_lines(html), set()) == want
