"""Main text of HTML pages by nearest-URL page differencing.

Pages of a host are sorted by URL path; each page is paired with the neighbour whose path shares the longer prefix (ties:
the one before). The text lines (blocks) of both, those of the article too, are aligned by their longest common subsequence.
A shared line is a vote that it belongs to the site's frame, and goes if at least half of the host's pages (and LEAST_PAGES)
gave that vote: neighbouring articles do share passages, which the plain rule (every shared line goes) would lose, but
hardly half of a site. Pairs whose text is shared almost whole are copies of one page, tell nothing of the frame and
have no vote. A page of which nothing would be left keeps its lines.

The page's structure tells the rest. Menus, page headers, footers, asides, forms, scripts, notices, adverts and reader
comments are known by their elements, roles and class names and go whole. Where a page marks its article (``article``,
``main``), what stands outside goes too.

The sort deals (host, path) ranges to tasks, so a host with a third of all pages is split; the first and last two pages of
each range (four a partition) meet in one small task. Line hashes are shuffled; pages are only where lines of more than
BROADCAST_HASHES were voted out, and otherwise are read where they lie.

Defined results: null html is an empty page with empty text; a null or odd URL has the empty host; pages without a
neighbour keep all lines; rows that repeat a page_id are pages of their own; pages cut off anywhere are read as far as they
go; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lcs import common
from .shared import Workspace

#: Least pages of a host that must share a line before it can go, share of the host's pages that must, and share of a
#: page's text from which two pages are copies.
LEAST_PAGES, FRAME, COPY = 3, 0.5, 0.8
BROADCAST_HASHES = 2_000_000
#: Parts that the voted lines of a host are dealt to, so that no host meets in one task.
SALTS = 16

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never part of an article.
DROPPED = frozenset("nav footer aside form dialog button menu head noscript template svg object select math canvas".split())
#: Elements that may stand in a head; any other ends it, with or without its end tag.
HEAD = frozenset("base link meta title style script noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer foot copyright comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager search hidden toc skip".split()
)
#: Words that may stand beside those; any other word (``has-sidebar``, ``no-comments``) makes a name mean something else.
BESIDE = frozenset(
    "a the site page main top bottom left right primary secondary global sub header bar box area wrapper wrap container content block section panel pane column col row grid list item items link links button buttons icon icons text label "
    "title form field reader readers user users post posts article articles blog news web inner outer upper lower first second third last sticky fixed static mobile desktop slot unit space zone group set holder region layer mini small "
    "large big wide full js id element module component div ul li google facebook twitter email mail media privacy policy law bottombar to".split()
)
#: Words that tell a page's header from an article's.
PAGE_HEADER = frozenset("site page global top main".split())
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: A comment, a declaration, an element whose content is no markup, or a tag (whose quotes may be left open).
TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|textarea|title|iframe|xmp|noembed|noframes)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\b[^>]*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""",
    re.S | re.I,
)


def _marked(name: str, inside_article: bool) -> bool:
    """Whether one class name or id marks what isn't the article."""
    words = {w.lower() for w in NAME_WORD.findall(name)}
    marks = words & MARKS
    if marks and words <= MARKS | BESIDE:
        return True
    return not inside_article and "header" in words and words <= PAGE_HEADER | {"header"}


def _dropped(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in ("html", "body", "main") or tag == "article" and "comment" not in attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name in ("class", "id") and any(_marked(x, inside_article) for x in value.split()):
            return True
    return False


def blocks(html: str) -> list[tuple[str, bool, bool]]:
    """Text blocks in page order: (text, in a marked article, in an element that isn't the article). Text of dropped
    elements that don't make blocks (an advert within a line) is left out."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, in article, dropped, in a dropped element within a line
    held: list[str] = []
    article = dropped = skipped = heads = False

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, article, dropped))

    def cut(k: int) -> None:
        nonlocal article, dropped, skipped
        del stack[k:]
        article, dropped, skipped = stack[-1][1:] if stack else (False, False, False)

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at and not skipped:
            held.append(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not tag:
            if m[1] and not skipped:
                held.append(" ")
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if tag == "br":
            held.append(" ")
        if close:
            if block:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
            continue
        if heads and tag not in HEAD:
            flush()
            cut(next((i for i, s in enumerate(stack) if s[0] == "head"), len(stack)))
            heads = False
        drops = _dropped(tag, attributes, article)
        if not block and not drops and not ((dropped or skipped) and any(t == tag for t, *_ in stack)):
            continue
        inline = not block and tag != "head"
        if not inline:
            flush()
        elif drops and not skipped:
            held.append(" ")
        if tag in ("article", "main") and not article and not drops:
            cut(0)  # an element left open before the article doesn't hold it
        while stack and (stack[-1][0] == "p" and block or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
            cut(len(stack) - 1)
        if tag in VOID or attributes.endswith("/"):
            continue
        article, dropped, skipped = article or tag in ("article", "main"), dropped or drops and not inline, skipped or drops and inline
        stack.append((tag, article, dropped, skipped))
        heads = heads or tag == "head"
    if at < len(html) and not skipped:
        held.append(html[at:])
    flush()
    return out


def stays(page: list[tuple[str, bool, bool]]) -> list[str]:
    """The lines that a page's structure leaves: those of the marked article, or without one all that aren't dropped."""
    marked = any(article and not dropped for _, article, dropped in page)
    return [text for text, article, dropped in page if not dropped and (article or not marked)]


def main_text(page: list[tuple[str, bool, bool]], frame: set[int]) -> str:
    """What structure leaves without the lines of the frame, or with them if nothing else is left."""
    lines = stays(page)
    return "\n\n".join([x for x in lines if _hash(x) not in frame] or lines if frame else lines)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Slices that bound how many parsed pages are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        pages = [blocks(h or "") for h in batch.column(3).to_pylist()]
        lines = _lists([[_hash(t) for t, _, _ in p] for p in pages], pa.int64())
        sizes = _lists([[len(t) for t, _, _ in p] for p in pages], pa.int32())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), lines, sizes], names=["host", "path", "key", "lines", "sizes"])


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compare(before: tuple | None, own: tuple, after: tuple | None) -> tuple[list[int], bool]:
    """The lines that a page, as (host, path, key, lines, sizes), shares with the nearer of its neighbours in the host, and
    whether the two have a vote on the frame."""
    near = [x for x in (before, after) if x and x[0] == own[0]]
    if not near:
        return [], False
    other = max(near, key=lambda x: _prefix(x[1], own[1]))  # ties: the first
    at = [i for i, _ in common(own[3], other[3])]
    return sorted({own[3][i] for i in at}), sum(own[4][i] for i in at) < COPY * sum(own[4])


PAIRED = "host string, key long, vote boolean, shared array<long>, path string, lines array<long>, sizes array<int>, decide boolean"
_KINDS = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_()]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in PAIRED.split(", ")])


def _found(before: tuple | None, own: tuple, after: tuple | None) -> tuple:
    shared, vote = compare(before, own, after)
    return own[0], own[2], vote, shared, None, None, None, None


def _edge(own: tuple, decide: bool) -> tuple:
    return own[0], own[2], None, None, own[1], own[3], own[4], decide


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the pages within a sorted range; its first two and last two pages are passed on as they are, since the
    neighbours of the outer ones may lie in other ranges."""
    window: list[tuple] = []  # the last three pages
    n = 0
    for batch in batches:
        out = []
        for own in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            n += 1
            window.append(own)
            if n == 1:
                out.append(_edge(own, True))
            if len(window) == 3:
                if n == 3:
                    out.append(_edge(window[1], False))
                out.append(_found(*window))
                window.pop(0)
        if out:
            yield _table(out)
    last = [_edge(window[0], False)] if n > 3 else []
    if n > 1:
        yield _table([*last, _edge(window[-1], True)])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the outer pages of the ranges; the rows come sorted."""
    before, own = None, None
    for batch in batches:
        out = []
        for host, key, path, lines, sizes, decide in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7)), strict=True):
            after = (host, path, key, lines, sizes, decide)
            if own and own[5]:
                out.append(_found(before, own, after))
            before, own = own, after
        if out:
            yield _table(out)
    if own and own[5]:
        yield _table([_found(before, own, None)])


def shared_lines(pages: DataFrame, space: Workspace) -> DataFrame:
    """(host, key, vote, shared): a page's lines that its nearest page has too, as hashes."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = space.keep(pages.mapInArrow(_lines, "host string, path string, key long, lines array<long>, sizes array<int>"), "lines")
    order = ("host", "path", "key")
    paired = space.keep(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_beside, PAIRED), "paired")
    edges = paired.where(F.col("decide").isNotNull()).repartition(1).sortWithinPartitions(*order)
    kept = ("host", "key", "vote", "shared")
    return paired.where(F.col("decide").isNull()).select(*kept).union(edges.mapInArrow(_stitch, PAIRED).select(*kept))


def frame_lines(pages: DataFrame, space: Workspace) -> DataFrame:
    """(key, frame): the hashes of a page's lines that were voted out; pages that keep all have no row."""
    shared = space.keep(shared_lines(pages, space), "shared")
    line = F.explode("shared").alias("line")
    votes = shared.where("vote").select("host", line).groupBy("host", "line").agg(F.count(F.lit(1)).alias("votes"))
    voters = shared.where("vote").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    out = space.keep(votes.where(F.col("votes") >= LEAST_PAGES).join(voters, "host").where(F.col("votes") >= FRAME * F.col("pages")).select("host", "line"), "out")
    if out.count() <= BROADCAST_HASHES:
        found = shared.select("host", "key", line).join(F.broadcast(out), ["host", "line"])
    else:
        salted = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        found = shared.select("host", "key", line, F.pmod("key", F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["host", "line", "salt"])
    return space.keep(found.groupBy("key").agg(F.collect_set("line").alias("frame")), "frame")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        ids, urls, htmls, frames = (batch.column(i).to_pylist() for i in range(4))
        texts = [main_text(blocks(html or ""), set(frame or ())) for html, frame in zip(htmls, frames, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars."""
    space = Workspace(pages.sparkSession, "html")
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    frame = frame_lines(rows.select(host.alias("host"), path.alias("path"), "key", "html"), space)
    # the voted lines of all pages together are counted; beyond the bound, hashing them spares a sort of the pages
    many = frame.agg(F.sum(F.size("frame") + 1)).first()[0] or 0
    joined = rows.join(F.broadcast(frame) if many <= BROADCAST_HASHES else frame.hint("shuffle_hash"), "key", "left")
    return joined.select("page_id", "url", "html", "frame").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
