"""Main text of web pages: blocks by markup, template lines by differencing nearest URLs.

Pages of a host are paired with the page of the nearest URL path. Their block lines are aligned
by a longest common subsequence and shared lines are deleted as template. Markup has the last
word at both ends: lines of menus, forms and the like are never text, and lines inside an
article are never template, since articles are also copied between URLs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import read, written

# Elements without end tag; elements that are never main text; elements that end a
# block; class, id and role words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form button select textarea iframe svg object "
    "dialog menu title".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer masthead toolbar cookie cookies consent gdpr notice notices alert "
    "popup modal newsletter subscribe signup login comment comments reply replies respond disqus share sharing "
    "social related recommended widget pagination pager search skip contentinfo complementary".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option"}
_ROOTS = frozenset({"html", "body"})
_ARTICLES = frozenset({"article", "main"})


class Blocks(HTMLParser):
    """Collects (line, in article) for each block outside dropped elements, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # name, dropped, in article
        self.lines: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.dropped = self.article = False

    def _end_block(self):
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                self.lines.append((line, self.article))
            self.parts = []

    def _restore(self):
        self.dropped, self.article = self.stack[-1][1:] if self.stack else (False, False)

    def _furniture(self, tag, attrs):
        if tag in _ROOTS:
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words = value.lower().split()
                if tag not in _ARTICLES:
                    words = [x for w in words for x in re.split(r"[-_]+", w)]
                if not FURNITURE.isdisjoint(words):
                    return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_block()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close("p", within=BLOCKS - {"p"})
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            self._close(tag, within={"ul", "ol", "table", "select", "dl", "tr"} - {tag})
        self.stack.append((
            tag,
            self.dropped or tag in DROPPED or self._furniture(tag, attrs),
            self.article or tag in _ARTICLES,
        ))
        self._restore()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the slash means nothing in html

    def _close(self, tag, within=frozenset()):
        """Ends the innermost open ``tag``, unless an element of ``within`` stands inside it."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                del self.stack[i:]
                self._restore()
                return
            if name in within:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_block()
        # An inline end tag closes nothing beyond its block.
        self._close(tag, within=frozenset() if tag in BLOCKS or tag in DROPPED else BLOCKS)

    def handle_data(self, data):
        if not self.dropped:
            self.parts.append(data)


def blocks(html: str) -> list[tuple[str, bool]]:
    """(line, in article) of the page's blocks that the markup does not drop, in page order."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser._end_block()
    return parser.lines


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Bit-parallel rows of the length table over the lines that both have, walked back from the end.
    """
    both = set(a) & set(b)
    left = [i for i, x in enumerate(a) if x in both]
    right = [x for x in b if x in both]
    n = len(right)
    where: dict[int, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << n) - 1
    row, rows = full, []
    for i in left:
        match = where[a[i]]
        row = ((row + (row & match)) | (row & ~match)) & full
        rows.append(row)
    out, j = [], n
    for k in range(len(left) - 1, -1, -1):
        before = rows[k - 1] if k else full
        # Zeros of a row up to j count the common length; equal rows up to j need no match here.
        mask = (1 << j) - 1
        if (~rows[k] & mask).bit_count() > (~before & mask).bit_count():
            out.append(left[k])
            j = _match(rows[k], before, where[a[left[k]]], j)
    return out[::-1]


def _match(row: int, before: int, match: int, j: int) -> int:
    """The last place under ``j`` whose match lengthens the sequence; the walk goes on below it."""
    candidates = match & ((1 << j) - 1)
    while candidates:
        place = candidates.bit_length() - 1
        below = (1 << place) - 1
        if (~before & below).bit_count() + 1 >= (~row & ((1 << j) - 1)).bit_count():
            return place
        candidates &= below
    return 0


def template_lines(own: list[int], protected: list[bool], other: list[int]) -> list[int]:
    """Positions of ``own`` to delete: shared with ``other`` and not in an article.

    A pair of which one page would lose every line tells nothing of a template.
    """
    shared = shared_lines(own, other)
    if len(shared) in (len(own), len(other)):
        return []
    return [i for i in shared if not protected[i]]


def _site(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or ""), parts.path.rstrip("/")
    except ValueError:
        return "", url or ""


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def _page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, page, host, path, lines, article): hashed block lines of each page."""
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, htmls = batch.column(2).to_pylist(), batch.column(3)
            sites = [_site(u) for u in urls]
            lines, inside = [], []
            for html in htmls:
                found = blocks(html.as_py() or "")
                lines.append(np.array([xxhash.xxh64_intdigest(x) for x, _ in found], np.uint64).view(np.int64))
                inside.append([y for _, y in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([s[0] for s in sites]), pa.array([s[1] for s in sites]),
                    pa.array(lines, pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.bool_())),
                ],
                ["page_id", "page", "host", "path", "lines", "article"],
            )

    schema = f"page_id {kind}, page bigint, host string, path string, lines array<bigint>, article array<boolean>"
    return pages.select("page_id", F.xxhash64("url", "html").alias("page"), "url", "html").mapInArrow(run, schema)


def template_of(pages: DataFrame) -> DataFrame:
    """(page_id, page, template): positions of the block lines that differencing deletes, if any.

    Pages are sorted by host and path over ranges, so a host of any size is split; the page
    before and after each come from the same range or, at its ends, from the next range's edge
    row. The nearer of the two shares more leading path segments; ties go to the page before.
    """
    order = ["host", "path", "page_id", "page"]
    ranged = written(
        _page_lines(pages).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "lines"
    )
    site = F.struct("host", "path", "lines")
    within = Window.partitionBy("part").orderBy(*order)
    near = ranged.withColumns({"before": F.lag(site).over(within), "after": F.lead(site).over(within)})
    edges = near.filter("before IS NULL OR after IS NULL").select(
        "part", F.when(F.col("before").isNull(), site).alias("first"), F.when(F.col("after").isNull(), site).alias("last")
    ).groupBy("part").agg(F.first("first", ignorenulls=True).alias("first"), F.first("last", ignorenulls=True).alias("last"))
    # A row for each range: the one window over all of them is as small as the number of ranges.
    by_part = Window.orderBy("part")
    edges = written(
        edges.select("part", F.lag("last").over(by_part).alias("before_"), F.lead("first").over(by_part).alias("after_")), "edges"
    )
    near = near.join(edges, "part").select(
        "page_id", "page", "host", "path", "lines", "article",
        F.coalesce("before", "before_").alias("before"), F.coalesce("after", "after_").alias("after"),
    )
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for i, row in enumerate(batch.to_pylist()):
                best = None
                for other in (row["before"], row["after"]):
                    if other and other["host"] == row["host"]:
                        common = _common(row["path"], other["path"])
                        if best is None or common > best[0]:
                            best = common, other
                if best and not all(row["article"]):
                    found = template_lines(row["lines"], row["article"], best[1]["lines"])
                    if found:
                        kept.append(i)
                        gone.append(found)
            taken = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), pa.array(gone, pa.list_(pa.int32()))], ["page_id", "page", "template"]
            )

    return near.mapInArrow(run, f"page_id {kind}, page bigint, template array<int>")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A block's white space becomes one space; blocks join in page order by a newline. On a page
    with an article only lines inside it are text, elsewhere all lines that the markup does not
    drop and differencing does not delete. Null or empty html, and pages of furniture alone,
    have the empty text. A null or unreadable URL has the empty host. Pages copied under
    several URLs, and repeated rows, keep their text: a pair that shares all lines deletes
    none. Other columns are not read.

    Only hashes of lines are sorted and paired; html moves once, to meet the deleted positions.
    """
    kinds = dict(pages.dtypes)
    template = written(template_of(pages), "template").withColumnsRenamed({"page_id": "id_", "page": "page_"}).distinct()
    held = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("page"))
    joined = held.join(template, held.page_id.eqNullSafe(template.id_) & (held.page == template.page_), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, gone in zip(batch.column(2), batch.column(3), strict=True):
                lines = blocks(html.as_py() or "")
                article = any(inside for _, inside in lines)
                deleted = set(gone.as_py() or ())
                texts.append("\n".join(
                    line for i, (line, inside) in enumerate(lines) if i not in deleted and (inside or not article)
                ))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return joined.select("page_id", "url", "html", "template").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    )


def op5_main_text(spark, sf_dir):
    return main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
