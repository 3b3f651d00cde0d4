"""Queries on listing pages and on the report table."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesprism import schema
from salesprism.models import clusters
from salesprism.operators import market
from salesprism.plans import report
from salesprism.plans.raw_listing import SHORT
from salesprism.plans.titles import base_titles
from salesprism.session import written_once
from salesprism.sources import files, listing_pages
from salesprism.workload.files import new_folder
from salesprism.workload.registry import BASE, LOOKUPS, ORACLES, on_titles, query

PER_PAGE = 8
HEADERS = (
    "Pos", "Game", "Console", "Publisher", "Release Date", "Total Sales", "Total Shipped", "NA Sales", "PAL Sales", "Japan Sales",
    "Other Sales", "Critic Score", "User Score",
)


def rendered(base):
    """Listing pages with the titles of a few ids each, and a row that spans cells on every page."""
    heads = "".join(f"<th colspan=2>{h}</th>" if h == "Game" else f"<th>{h}</th>" for h in HEADERS)
    name = F.replace(F.replace("Name", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    day = F.concat(F.dayofmonth("Release_Date").cast("string"), F.lit("th "), F.expr(SHORT), F.lit(" "), F.year("Release_Date").cast("string"))
    score = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in ("Critic_Score", "User_Score")]
    sold = [F.concat(F.col(c).cast("string"), F.lit("m")) for c in ("Global_Sales", *schema.REGIONS)]
    cells = [
        F.col("title_id").cast("string"), F.lit('<img src="box.png">'), F.concat(F.lit('<a href="/game"> '), name, F.lit("</a> <i>new</i>")),
        F.concat(F.lit('<img alt="'), "Platform", F.lit('">')), F.col("Publisher"), day, sold[0], F.lit(""), *sold[1:], *score,
    ]
    row = F.concat(F.lit("<tr><td>"), F.concat_ws("</td>\n<td>", *cells), F.lit("</td></tr>"))
    pages = base.groupBy(F.floor(F.col("title_id") / PER_PAGE).alias("page_id")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = f"<html><body><table><tr><td>menu</td></tr></table><div id='generalBody'><table><tr>{heads}</tr><tr><td colspan=3>advert</td></tr>"
    return pages.select("page_id", F.concat(F.lit(head), F.array_join("rows", ""), F.lit("</table></div></body></html>")).alias("html"))


COLUMNS = ("Rank", "Name", "Platform", "Platform_Family", "Year", "Publisher", *schema.REGIONS, "Global_Sales", "Total_Shipped", "Critic_Score", "User_Score")
SOLD = ", ".join(f'round(CAST(CAST({c} AS DECIMAL(18,4)) AS DECIMAL(18,3))::DOUBLE, 3) AS "{c}"' for c in (*schema.REGIONS, "Global_Sales"))


@query(
    "listing_pages_parsed",
    f"""WITH {LOOKUPS}, {BASE} SELECT title_id AS "Rank", "Name", b."Platform" AS "Platform", coalesce(f.family, b.Platform) AS "Platform_Family", year(Release_Date)::INTEGER AS "Year",
    "Publisher", {SOLD}, CAST(0 AS DOUBLE) AS "Total_Shipped", round("Critic_Score", 6) AS "Critic_Score", round("User_Score", 6) AS "User_Score"
    FROM base b LEFT JOIN families f ON f.platform = b.Platform""",
)
def _(spark, sf_dir):
    return listing_pages.listing_rows(listing_pages.parse_pages(rendered(base_titles(spark, sf_dir)))).select(*COLUMNS)


@query(
    "listing_rejects",
    f"""WITH {LOOKUPS}, {BASE} SELECT 'cell_count' AS reject, count(DISTINCT title_id // {PER_PAGE}) AS rows FROM base HAVING count(*) > 0
    UNION ALL SELECT 'no_table', count(*) FROM pages HAVING count(*) > 0""",
)
def _(spark, sf_dir):
    """Rows and pages that are no listing; no page of the pages table holds one."""
    listings = listing_pages.parse_pages(rendered(base_titles(spark, sf_dir)))
    others = listing_pages.parse_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), deal=True)
    return listing_pages.rejects(listings.unionByName(others))


def section(name, query_name, label, value, order, where="true"):
    lines = f"SELECT {label} AS label, CAST({value} AS DOUBLE) AS value, row_number() OVER (ORDER BY {order}) - 1 AS ord FROM ({ORACLES[query_name]}) WHERE {where}"
    return f"SELECT '{name}' AS section, CAST(ord AS INTEGER) AS ord, CAST(label AS VARCHAR) AS label, round(value, 6) AS value FROM ({lines})"


def fields(name, sources, columns):
    table = ", ".join(f"({ORACLES[s]}) AS q{i}" for i, s in enumerate(sources))
    return " UNION ALL ".join(
        f"SELECT '{name}' AS section, {i} AS ord, '{c}' AS label, round(CAST({c} AS DOUBLE), 6) AS value FROM {table}" for i, c in enumerate(columns)
    )


REPORT = " UNION ALL ".join([
    fields("overview", ("table_summary", "sales_gini"), ("row_count", "first_year", "last_year", "total_sales", "gini")),
    section("regions", "region_totals", "region", "share", "region"),
    fields("momentum", ("growth_metrics",), ("cagr", "volatility", "release_density")),
    section("boom_years", "boom_and_bust_years", '"Year"', "yoy", 'yoy DESC, "Year"', "kind = 'boom'"),
    section("tiers", "tier_contributions", "tier", "lift", "tier_ord"),
    section("genres", "top_genres", '"Genre"', "sales", 'sales DESC, "Genre"') + " WHERE ord < 5",
    section("publishers", "publisher_moat", '"Publisher"', "moat_score", 'moat_score DESC, "Publisher"'),
    fields("quality", ("score_sales_correlation", "score_gap_summary"), ("correlation", "mean_gap", "std_gap")),
])


# What the report's lines read of a title.
LINED = (
    "Name", "Publisher", "Genre", "Year", "Decade", "Sales_Tier", "Composite_Score", "Score_Gap", *schema.REGIONS, "Global_Sales",
)


@on_titles("report_table")
def _(t):
    return report.report(written_once(t.select(*LINED)))


ORACLES["report_table"] = REPORT


PICKS = " UNION ALL ".join([
    section("genres", "top_genres", '"Genre"', "sales", 'sales DESC, "Genre"') + " WHERE ord < 8",
    section("platforms", "platform_share", '"Platform_Family"', "share", 'share DESC, "Platform_Family"'),
    section("preferences", "preference_picks", "\"Genre\" || '|' || region", "preference", "preference DESC, \"Genre\" || '|' || region"),
    section("turns", "boom_and_bust_years", "kind || '|' || \"Year\"", "yoy", "kind || '|' || \"Year\"",
            f"(kind = 'boom') OR \"Year\" IN (SELECT \"Year\" FROM ({ORACLES['boom_and_bust_years']}) WHERE kind = 'bust' ORDER BY yoy, \"Year\" LIMIT 2)"),
    section("disagreements", "largest_disagreements", '"Name"', '"Score_Gap"', 'abs("Score_Gap") DESC, ingest_id') + " WHERE ord < 3",
])


@on_titles("report_picks")
def _(t):
    return report.picks(t)


ORACLES["report_picks"] = PICKS


REPORTED = (
    "ingest_id", "Name", "Publisher", "Genre", "Platform_Family", "Platform_Family_CN", "Year", "Decade", "Sales_Tier", "Composite_Score",
    "Score_Gap", "Critic_Score", "User_Score", *schema.REGIONS, "Global_Sales",
)


@on_titles("report_table_with_clusters")
def _(t):
    """The report with the summary of fitted clusters."""
    t = written_once(t.select(*REPORTED))
    return report.report(t, market.cluster_summary(clusters.cluster_regions(t)))


@on_titles("report_documents")
def _(t):
    """The report as one JSON document a section, written and read back."""
    path, folded = new_folder(t, "report-json"), report.documents(report.report(written_once(t.select(*LINED))))
    files.write_json(folded, path)
    back = t.sparkSession.read.schema(folded.schema).json(path)
    return back.select("section", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["label"]), "|").alias("labels"))


ORACLES["report_documents"] = f"SELECT section, CAST(count(*) AS INTEGER) AS n, string_agg(label, '|' ORDER BY ord) AS labels FROM ({REPORT}) GROUP BY 1"
