"""Literal listing pages: which table, which header, which rows."""

from salesprism.sources import listing_pages as lp

HEAD = "<tr><th>Pos</th><th colspan=2>Game</th><th>Console</th><th>Publisher</th><th>Total Sales</th><th>Site Score</th></tr>"
ROW = "<tr><td>1</td><td><img src=b.png></td><td><a href=x>The  Game</a> <a>more</a></td><td><img alt=' PS4 '>x</td><td> Pub &amp; Co </td><td>1.5m</td><td>8.5</td></tr>"


def test_rows_of_a_page():
    page = f"<div id=generalBody><table>{HEAD}{ROW}<tr><td colspan=7>advert</td></tr><tr></tr><tr><td>2<td><td><td>PC<td>P<td>0<td></table></div>"
    rows = lp.parse_page(page)
    assert rows[0] == {
        "row": 1, "reject": None, "Rank": "1", "Name": "The  Game", "Platform": "PS4", "Publisher": "Pub & Co", "Total_Sales": "1.5m", "Site_Score": "8.5",
        **dict.fromkeys(("Developer", "Release_Date", "Last_Update", "NA_Sales", "EU_Sales", "JP_Sales", "Other_Sales", "Total_Shipped", "Critic_Score", "User_Score")),
    }
    assert [(r["row"], r["reject"]) for r in rows[1:]] == [(2, lp.WIDTH), (4, lp.NO_NAME)]


def test_which_table():
    other, own = "<table><tr><th>Global sales</th></tr></table>", f"<table class='big {{}}' id='{{}}'>{HEAD}{ROW}</table>"
    for marked in (own.format("chart", ""), own.format("", "chart-body"), own.format("chart_table", "")):
        assert lp.parse_page(other + marked)[0]["Name"] == "The  Game"
    assert lp.parse_page(other) == [{"row": 0, "reject": lp.NO_HEADER}]
    titled = "<table><tr><th>Pos</th><th>Game</th><th>Global</th><th>My Sales</th></tr><tr><td>3</td><td>Plain</td><td></td><td></td></tr></table>"
    assert (lp.parse_page(titled)[0]["Name"], lp.parse_page(titled)[0]["Platform"]) == ("Plain", "")
    for none in (None, "", "<p>text", "<table><tr><td>1"):
        assert lp.parse_page(none) == [{"row": 0, "reject": lp.NO_TABLE}]


def test_typed_rows_and_rejects(spark):
    pages = spark.createDataFrame([(1, f"<table class=chart>{HEAD}{ROW}{ROW.replace('The  Game', '')}</table>"), (2, None)], "page_id long, html string")
    parsed = lp.parse_pages(pages)
    row = lp.listing_rows(parsed).collect()
    assert [(r.Rank, r.Name, r.Platform, r.Platform_Family, r.Year, r.Global_Sales, r.Site_Score, r.Critic_Score, r.Genre) for r in row] == [
        (1, "The  Game", "PS4", "PlayStation", 0, 1.5, 8.5, None, "")
    ]
    assert {tuple(r) for r in lp.rejects(parsed).collect()} == {(lp.NO_NAME, 1), (lp.NO_TABLE, 1)}
    assert lp.listing_rows(lp.parse_pages(pages.limit(0))).count() == 0


ODD = (
    None, "", "no markup & none", "<p>a < b</p><table><tr><td>x", '<TABLE ID=chart><tr><th>Pos<th>Game<tr><td>1<td>A &amp; B &lt;c&gt;',
    '<table class="chart x"><tr><th>Pos</th><th colspan=2>Game</th></tr><tr><td>1</td><td/><td><a href=x>N <b>o</b></a> y</td></tr></table>',
    '<table id=chart><tr><th>Pos</th><th>Game</th></tr><!-- <tr><td>9</td><td>no</td></tr> --><tr><td>1</td><td>N</td></tr></table>',
    '<table id=chart><tr><th>Pos</th><th>Game</th></tr><tr><td>1</td><td><script>"<td>"</script>N</td></tr></table>',
    '<table id=chart><tr><th>Pos</th><th>Console</th><th>Game</th></tr><tr><td>1</td><td><img hidden alt=PS/></td><td>N</td></tr></table> &am',
    "<div id='generalBody' ><table><tr><th>Pos</th><th colspan='2'>Game</th></tr><tr><td>1</td><td><img alt='a'/></td><td>N&nbsp;</td></tr></table></div>",
    '<table id=chart><tr><th>Pos</th><th>Game</th></tr><tr><td>1</td><td title="a>b">N</td></tr><tr><td>2</td></tr></table>',
)


def test_plain_pages_read_as_by_the_parser(monkeypatch):
    plain = [lp.parse_page(page) for page in ODD]
    monkeypatch.setattr(lp, "_plain", lambda html: None)
    assert plain == [lp.parse_page(page) for page in ODD]


def test_pages_without_a_table_are_not_parsed(spark):
    """One file of many pages is dealt out, and only pages in which a table begins reach the parser."""
    pages = spark.createDataFrame([*enumerate(ODD), (None, "<p>x</p>")], "page_id long, html string").coalesce(1)
    parsed = lp.parse_pages(pages, deal=True)
    expected = {(n, row["row"], row["reject"], row.get("Name")) for n, page in enumerate(ODD) for row in lp.parse_page(page)}
    assert {(r.page_id, r.row, r.reject, r.Name) for r in parsed.collect()} == expected | {(None, 0, "no_table", None)}
    kinds = lp.rejects(parsed)
    assert {r.reject: r.rows for r in kinds.collect()}["no_table"] == 5
    assert parsed.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
