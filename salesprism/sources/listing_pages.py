"""Rows of sales listings from HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions import text
from salesprism.functions.sales import sales_or_shipped
from salesprism.operators.lookup import map_or

# ---- Fixed values: the headers of a listing and where its table stands. ----
SALES_HEADERS = {
    "NA_Sales": "NA Sales", "EU_Sales": "PAL Sales", "JP_Sales": "Japan Sales", "Other_Sales": "Other Sales",
    "Total_Sales": "Total Sales", "Total_Shipped": "Total Shipped",
}
SCORE_HEADERS = {"Critic_Score": "Critic Score", "User_Score": "User Score"}
TEXT_HEADERS = {"Publisher": "Publisher", "Developer": "Developer", "Release_Date": "Release Date", "Last_Update": "Last Update"}
BODY_ID = "generalBody"
TABLE_IDS = ("chart", "chart-body")
TABLE_CLASSES = ("chart", "chart_table")
# ---- End of fixed values. ----

# A listing also has the score of the site that made it, under the site's own name.
SITE_SCORE, SCORE_END = "Site_Score", " Score"
CELLS = ("Rank", "Name", "Platform", *TEXT_HEADERS, *SALES_HEADERS, SITE_SCORE, *SCORE_HEADERS)
PARSED = "page_id long, row int, reject string, " + ", ".join(f"{c} string" for c in CELLS)
NO_TABLE, NO_HEADER, WIDTH, NO_NAME = "no_table", "no_header", "cell_count", "no_name"

# A plain tag, in which the parser of the standard library sees just what stands there: names of
# ASCII letters, values in quotes or without any special character.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][a-zA-Z0-9]*)"
    r"((?:[ \t\n\r]+[a-zA-Z_][a-zA-Z0-9_:-]*(?:=(?:\"[^\"<>&]*\"|'[^'<>&]*'|[a-zA-Z0-9_#.:;%-]+(?!/)))?)*)[ \t\n\r]*(/?)>"
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_][a-zA-Z0-9_:-]*)(?:=(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\"']+)))?")
# Elements whose content is not markup, or ends in ways of their own.
_RAW = frozenset(("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"))
_READ = frozenset(("div", "table", "tr", "td", "th", "a", "img"))
ROWS_PER_BATCH = 10_000


class _Element:
    """A table, row or cell with what was found inside it."""

    def __init__(self, kind: str, attributes: Mapping[str, str | None], in_body: bool):
        self.kind, self.attributes, self.in_body = kind, attributes, in_body
        self.children: list[_Element] = []
        self.texts: list[str] = []
        self.link: list[str] | None = None  # the text of the first link
        self.in_link = False
        self.alt: str | None = None

    @property
    def text(self) -> str:
        return "".join(t.strip() for t in self.texts)


class _Tables(HTMLParser):
    """All tables of a page; a row or cell ends where the next one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[_Element] = []
        self.open: list[_Element] = []
        self.divs: list[bool] = []
        self.hidden = 0

    def _close(self, kinds: tuple[str, ...]) -> None:
        """Ends the innermost open element of ``kinds`` within the current table, and what it holds."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].kind in kinds:
                del self.open[i:]
                return
            if self.open[i].kind == "table":
                return

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if tag == "div":
            self.divs.append(attributes.get("id") == BODY_ID)
        elif tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            self.open.append(_Element("table", attributes, any(self.divs)))
            self.tables.append(self.open[-1])
        elif tag in ("tr", "td", "th") and self.open:
            self._close(("tr",) if tag == "tr" else ("td", "th"))
            kinds = ("table",) if tag == "tr" else ("tr", "table")
            for parent in reversed(self.open):
                if parent.kind in kinds:
                    if parent.kind == kinds[0]:
                        self.open.append(_Element(tag, attributes, False))
                        parent.children.append(self.open[-1])
                    break
        elif tag == "a":
            for cell in self._cells():
                if cell.link is None:
                    cell.link, cell.in_link = [], True
        elif tag == "img":
            for cell in self._cells():
                cell.alt = (attributes.get("alt") or "") if cell.alt is None else cell.alt

    def handle_endtag(self, tag):
        if tag == "div" and self.divs:
            self.divs.pop()
        elif tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table":
            at = max((i for i, e in enumerate(self.open) if e.kind == "table"), default=None)
            if at is not None:
                del self.open[at:]
        elif tag in ("tr", "td", "th"):
            self._close(("tr",) if tag == "tr" else ("td", "th"))
        elif tag == "a":
            for cell in self._cells():
                cell.in_link = False

    def _cells(self) -> list[_Element]:
        return [e for e in self.open if e.kind in ("td", "th")]

    def handle_data(self, data):
        if self.hidden:
            return
        for cell in self._cells():
            cell.texts.append(data)
            if cell.in_link:
                cell.link.append(data)


def _plain(html: str) -> _Tables | None:
    """The tables of a page of plain tags; None for any other page.

    A page with a comment, a declaration, an element of raw text or an odd tag is left to the parser
    of the standard library, which takes several times as long to find the tags.
    """
    parts = _TAG.split(html)
    if len(parts) // 5 != html.count("<"):
        return None
    parser = _Tables()
    started = parser.open
    for i in range(0, len(parts) - 1, 5):
        words, closing, name, attributes, empty = parts[i : i + 5]
        if words and started:
            parser.handle_data(unescape(words) if "&" in words else words)
        name = name.lower()
        if name in _READ:
            if not closing:
                parser.handle_starttag(name, [(k.lower(), x or y or z) for k, x, y, z in _ATTRIBUTE.findall(attributes)] if attributes else ())
            if closing or empty:
                parser.handle_endtag(name)
        if name in _RAW or (closing and (attributes or empty)):
            return None
    if parts[-1] and started:
        parser.handle_data(unescape(parts[-1]))
    return parser


def _chosen(tables: list[_Element]) -> _Element | None:
    """The listing among the page's tables, by place, then name, then headers."""
    def classes(t):
        return (t.attributes.get("class") or "").split()

    def titles(t):
        return [c.text.lower() for row in t.children for c in row.children if c.kind == "th"]

    tests = [lambda t: t.in_body, lambda t: TABLE_CLASSES[0] in classes(t)]
    tests += [lambda t, i=i: t.attributes.get("id") == i for i in TABLE_IDS]
    tests += [lambda t: TABLE_CLASSES[1] in classes(t)]
    tests += [lambda t: any("global" in x for x in titles(t)) and any("sales" in x for x in titles(t))]
    return next((t for test in tests for t in tables if test(t)), None)


def _header(rows: list[_Element]) -> tuple[int, list[str]] | None:
    """Number and column names of the row that holds Pos and Game; a wide Game starts with the picture."""
    for i, row in enumerate(rows):
        heads = [c for c in row.children if c.kind == "th"]
        whole = " ".join(c.text for c in heads)
        if "Pos" not in whole or "Game" not in whole:
            continue
        names: list[str] = []
        for head in heads:
            span = head.attributes.get("colspan") or "1"
            span = int(span) if re.fullmatch(r"\d{1,3}", span.strip()) else 1
            if head.text == "Game" and span >= 2:
                names += ["BoxArt", *["Game"] * (span - 1)]
            else:
                names += [head.text or f"col_{len(names)}"] * span
        return i, names
    return None


def parse_page(html: str | None) -> list[dict]:
    """A dict per listing row, in page order, with ``reject`` where it is no title; one for a page without a table."""
    parser = _plain(html or "")
    if parser is None:
        parser = _Tables()
        parser.feed(html or "")
        parser.close()
    table = _chosen(parser.tables)
    if table is None:
        return [{"row": 0, "reject": NO_TABLE}]
    header = _header(table.children)
    if header is None:
        return [{"row": 0, "reject": NO_HEADER}]
    start, names = header
    site = [n for n in names if n.endswith(SCORE_END) and n not in SCORE_HEADERS.values()]
    wanted = TEXT_HEADERS | SALES_HEADERS | SCORE_HEADERS | ({SITE_SCORE: site[-1]} if site else {})
    out = []
    for n, row in enumerate(table.children[start + 1 :], 1):
        cells = [c for c in row.children if c.kind == "td"]
        if not cells:
            continue
        if len(cells) != len(names):
            out.append({"row": n, "reject": WIDTH})
            continue
        by_name = dict(zip(names, cells, strict=True))  # of equal names the last cell
        read = {c: by_name[h].text if h in by_name else None for c, h in wanted.items()}
        game, console = by_name.get("Game"), by_name.get("Console")
        name = "" if game is None else game.text if game.link is None else "".join(t.strip() for t in game.link)
        platform = "" if console is None else (console.alt or "").strip() or console.text
        rank = by_name["Pos"].text if "Pos" in by_name else None
        out.append(read | {"row": n, "reject": None if name else NO_NAME, "Rank": rank, "Name": name, "Platform": platform})
    return out


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", deal: bool = False) -> DataFrame:
    """The cells of all listing rows as text, and a row with ``reject`` for what could not be read.

    Pages are parsed one by one where they lie; a null page has no table, nor has one in which none
    begins, which is not parsed. ``deal`` deals the pages to parse out anew, for tables whose
    files are too few or too large to be read by many tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "row": pa.int32(), **dict.fromkeys(("reject", *CELLS), pa.string())}

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items()], list(kinds))

        for batch in batches:
            rows: list[dict] = []
            for page, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
                number = page.as_py()
                rows += [row | {"page_id": number} for row in parse_page(html.as_py())]
                if len(rows) >= ROWS_PER_BATCH:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    begins = F.col(html_col).rlike("(?i)<table")
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.when(begins, F.col(html_col)).alias("html"))
    if deal:
        read = read.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return read.mapInArrow(run, PARSED)


def listing_rows(parsed: DataFrame, families: Mapping[str, str] = schema.PLATFORM_FAMILIES) -> DataFrame:
    """The raw listing table, typed, from the cells that were read; genre is not on the pages."""
    blank = lambda c: text.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = parsed.filter("reject IS NULL")
    rows = map_or(rows, "Platform", families, "Platform_Family", F.col("Platform"))
    sales = {c: text.sales_cell(F.col(c)) for c in SALES_HEADERS}
    dates = {c: blank(F.col(c)) for c in ("Release_Date", "Last_Update")}
    typed = {
        "Rank": text.rank_cell(F.col("Rank")), "Year": text.release_year(dates["Release_Date"]), "Genre": F.lit(""),
        **{c: F.coalesce(F.col(c), F.lit("")) for c in ("Publisher", "Developer")}, **dates, **sales,
        **{c: text.score_cell(F.col(c)) for c in schema.SCORES},
        "Global_Sales": sales_or_shipped(sales["Total_Sales"], sales["Total_Shipped"]),
    }
    return rows.withColumns(typed).select("page_id", "row", *schema.RAW_COLUMNS)


def rejects(parsed: DataFrame) -> DataFrame:
    """(reject, rows): what could not be read, by reason."""
    return parsed.filter("reject IS NOT NULL").groupBy("reject").agg(F.count("*").alias("rows"))
