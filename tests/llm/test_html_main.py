"""Page differencing against a plain version, and parts of pages that a parser can trip over."""

import os
import random
import re
from collections import Counter

import pytest

from docsieve.llm import html_main
from docsieve.llm.lcs import _solve, common
from docsieve.llm.shared import Workspace

SCHEMA = "page_id long, url string, html string, score double, key string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "k") for r in rows], SCHEMA)


def text(html):
    return html_main.main_text(html_main.blocks(html), set())


def site(seed, hosts=5, n=60):
    """Pages with frames of their host, passages that some share, and copies; without a word of structure."""
    r, rows = random.Random(seed), []
    for k in range(n):
        host = r.choices(range(hosts), [12, 3, 2, 1, 1])[0]
        lines = [f"Welcome to site {host}", f"Body of page {k} which is long enough to be no copy", f"More of page {k}"]
        if r.random() < 0.3:
            lines.insert(2, "A passage that some pages quote")
        lines.append(f"All about site {host}")
        if r.random() < 0.1 and rows:
            rows.append((k, rows[-1][1], rows[-1][2]))
        else:
            rows.append((k, f"http://h{host}.org/{r.choice('abc')}/{r.randrange(30)}?x={k}", "".join(f"<div>{x}</div>" for x in lines)))
    return rows


def expected_votes(rows):
    """Which lines each page shares with its nearest page, and which lines their hosts vote out."""
    own = sorted((re.match(r"http://([^/]*)", u)[1], re.sub(r"^http://[^/]*|\?.*", "", u), k, [t for t, _, _ in html_main.blocks(h)]) for k, u, h in rows)
    shared, votes, voters = {}, Counter(), Counter()
    for i, (host, path, k, lines) in enumerate(own):
        near = [own[j] for j in (i - 1, i + 1) if 0 <= j < len(own) and own[j][0] == host]
        if not near:
            continue
        other = max(near, key=lambda x: len(os.path.commonprefix([x[1], path])))
        at = [i for i, _ in common(lines, other[3])]
        shared[k] = {lines[i] for i in at}
        if sum(len(lines[i]) for i in at) < 0.8 * sum(map(len, lines)):
            voters[host] += 1
            votes.update((host, x) for x in shared[k])
    frame = {x for x in votes if votes[x] >= max(3, voters[x[0]] / 2)}
    return {k: {x for x in shared.get(k, ()) if (host, x) in frame} for host, _, k, _ in own}


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_of_the_frame_equal_a_plain_version(spark, parts, monkeypatch):
    rows = site(parts)
    # equal addresses are told apart by their number here, by the page's key there
    rows = [(k, u.split("?")[0] + f"/{k:03}", h) for k, u, h in rows]
    want = expected_votes(rows)
    assert any(want.values()) and any("A passage that some pages quote" in t for t in (r[2] for r in rows))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.page_id: r.text for r in html_main.extract(pages(spark, rows)).collect()}
        monkeypatch.setattr(html_main, "BROADCAST_HASHES", 0)
        again = {r.page_id: r.text for r in html_main.extract(pages(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k, _, h in rows:
        lines = [t for t, _, _ in html_main.blocks(h)]
        assert got[k] == again[k] == "\n\n".join([x for x in lines if x not in want[k]] or lines)


def test_article_is_found_without_its_tags(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    bare = table.selectExpr("page_id", "url", "regexp_replace(html, '</?(article|main)[^>]*>', '') AS html")
    whole = {r.page_id: r.text for r in html_main.extract(table).collect()}
    assert {r.page_id: r.text for r in html_main.extract(bare).collect()} == whole and any(whole.values())


def test_frame_within_an_article_goes(spark):
    rows = [(k, f"http://h.org/{k:02}", f"<article><p>Story {k} told at some length</p><p>Quote</p><p>Follow us</p></article>" if k % 5 in (1, 2) else f"<article><p>Story {k} told at some length</p><p>Follow us</p></article>") for k in range(12)]
    rows += [(50, "http://two.org/a", "<p>Same<p>Own words of one page"), (51, "http://two.org/b", "<p>Same<p>Other words there")]
    got = {r.page_id: r.text for r in html_main.extract(pages(spark, rows)).collect()}
    assert got[0] == "Story 0 told at some length" and got[1] == "Story 1 told at some length\n\nQuote"
    assert got[50] == "Same\n\nOwn words of one page"  # two pages don't make a site


def test_copies_have_no_vote(spark):
    rows = [(k, f"http://h.org/{k:02}", "<p>One page<p>that stands everywhere") for k in range(20)]
    assert {r.text for r in html_main.extract(pages(spark, rows)).collect()} == {"One page\n\nthat stands everywhere"}


def test_odd_rows(spark):
    rows = [(1, None, None), (1, "http://a/b", "<p>x"), (1, "http://a/b", "<p>x"), (None, "", ""), (2, "odd url", "<<<>>> &amp &#x;"), (3, "http://a/c", "<p>" + "long words " * 200_000), (4, "http://a/d", "<p>line" * 30_000)]
    got = html_main.extract(pages(spark, rows))
    assert got.count() == len(rows) and got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.n_chars for r in got.where("page_id = 3").collect()} == {len("long words " * 200_000) - 1}
    assert html_main.extract(pages(spark, rows).where("false")).count() == 0


def test_neighbours_across_ranges(spark):
    rows = [(k, f"http://h.org/{k:03}", f"<p>Frame of it<p>Text number {k} stands here") for k in range(50)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "9", "25", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        url = "regexp_extract(url, '//([^/]*)', 1) AS host", "regexp_extract(url, '//[^/]*(.*)', 1) AS path", "page_id AS key", "html"
        got = html_main.shared_lines(pages(spark, rows).selectExpr(*url), Workspace(spark, "t")).collect()
        assert sorted(r["key"] for r in got) == list(range(50)) and all(len(r.shared) == 1 and r.vote for r in got)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tags_left_out_or_closed_early():
    assert text("<html><head><title>T</title><meta charset=utf-8><body><p>Hello") == "Hello"
    assert text("<head><title>T</title><p>Hello") == "Hello"
    assert text("<p>One</p><svg viewBox='0 0 1 1' /><p>Two") == "One\n\nTwo"
    assert text("<p>One <svg><text>no</text></svg> two</p>") == "One two"
    assert text("<!-- <script> --><p>One</p><!--> <p>Two</p>") == "One\n\nTwo"
    assert text("<p>One</p><script>var a = '<p>no</p>'") == "One"
    assert text("<div style='overflow:hidden' data-hidden=false data-id=menu>One</div>") == "One"
    assert text("<div hidden>no</div><div aria-hidden=true>no</div>Yes") == "Yes"


def test_names_are_read_whole():
    for name in ("layout has-sidebar", "post no-comments", "article-related-work", "without-menu", "searchable", "addresses"):
        assert text(f"<main><div class='{name}'>Kept</div></main>") == "Kept", name
    for name in ("sidebar", "cookie-notice", "siteFooter", "main_nav", "reader-comments", "ad", "post share-buttons", "ad-slot-3", "comment-list"):
        assert text(f"<main><p>Kept</p><div class='{name}'>gone</div></main>") == "Kept", name


def test_halved_subsequences_are_as_long(monkeypatch):
    from docsieve.llm import lcs

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(40))] for _ in range(2))
        whole = _solve(a, b)
        monkeypatch.setattr(lcs, "TABLE_BITS", 20)
        halved = _solve(a, b)
        monkeypatch.undo()
        assert len(halved) == len(whole) and all(a[i] == b[j] for i, j in halved)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(halved, halved[1:], strict=False))
