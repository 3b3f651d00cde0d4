"""The analysis report as one long table: a typed row per line of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.operators import market, ordered, temporal

SECTIONS = ("overview", "regions", "momentum", "tiers", "genres", "publishers", "quality", "clusters")


def _lines(df: DataFrame, section: str, order: list[Column], label: Column, value: Column) -> DataFrame:
    """Rows of a short result, numbered in ``order``; sorted as one array, not by a global window."""
    line = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], label.cast("string").alias("label"), value.cast("double").alias("value"))
    lines = df.agg(F.array_sort(F.collect_list(line)).alias("lines"))
    numbered = lines.select(F.posexplode("lines").alias("ord", "line"))
    return numbered.select(F.lit(section).alias("section"), "ord", F.col("line.label").alias("label"), F.col("line.value").alias("value"))


def _fields(df: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """The columns of a one-row result as lines."""
    cells = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("label"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)]
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))


def report(t: DataFrame, clusters: DataFrame | None = None, booms: int = 3, top: int = 5) -> DataFrame:
    """(section, ord, label, value) of all sections; clusters only if their summary is handed in.

    Each section is a small aggregate of ``t``; the same shape lets them be one table, to be written
    as CSV or JSON or read by a page.
    """
    per_year = temporal.yearly(t)
    overview = market.summary(t).crossJoin(F.broadcast(ordered.gini(t)))
    boom = temporal.boom_and_bust(per_year, booms=booms, busts=0).filter("kind = 'boom'")
    quality = market.score_correlation(t).crossJoin(F.broadcast(market.gap_summary(t)))
    sections = [
        _fields(overview, "overview", ["row_count", "first_year", "last_year", "total_sales", "gini"]),
        _lines(market.region_totals(t), "regions", [F.col("region")], F.col("region"), F.col("share")),
        _fields(temporal.growth(per_year), "momentum", ["cagr", "volatility", "release_density"]),
        _lines(boom, "boom_years", [-F.col("yoy"), F.col("Year")], F.col("Year"), F.col("yoy")),
        _lines(market.tier_contributions(t), "tiers", [F.col("tier_ord")], F.col("tier"), F.col("lift")),
        _lines(market.top_by_sales(t, "Genre", top, digits=2), "genres", [-F.col("sales"), F.col("Genre")], F.col("Genre"), F.col("sales")),
        _lines(market.publisher_moat(t), "publishers", [-F.col("moat_score"), F.col("Publisher")], F.col("Publisher"), F.col("moat_score")),
        _fields(quality, "quality", ["correlation", "mean_gap", "std_gap"]),
    ]
    if clusters is not None:
        label = clusters.columns[0]
        sections.append(_lines(clusters.orderBy(F.desc("size"), label).limit(3), "clusters", [-F.col("size"), F.col(label)], F.col(label), F.col("avg_sales")))
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out


def picks(t: DataFrame, genres: int = 8, preferences: int = 8, booms: int = 3, busts: int = 2, disagreements: int = 3) -> DataFrame:
    """(section, ord, label, value) of what a page of highlights shows."""
    pair = F.concat_ws("|", "Genre", "region")
    turns = temporal.boom_and_bust(temporal.yearly(t), booms=booms, busts=busts)
    turn = F.concat_ws("|", "kind", F.col("Year").cast("string"))
    preferred = market.region_preference(t).orderBy(F.desc("preference"), "Genre", "region").limit(preferences)
    gaps = market.largest_disagreements(t)  # ordered anew: equal to six digits is equal, then the id decides
    sections = [
        _lines(market.top_by_sales(t, "Genre", genres, digits=2), "genres", [-F.col("sales"), F.col("Genre")], F.col("Genre"), F.col("sales")),
        _lines(market.share_of_total(t, "Platform_Family"), "platforms", [-F.col("share"), F.col("Platform_Family")], F.col("Platform_Family"), F.col("share")),
        _lines(preferred, "preferences", [-F.col("preference"), pair], pair, F.col("preference")),
        _lines(turns, "turns", [turn], turn, F.col("yoy")),
        _lines(gaps, "disagreements", [-F.round(F.abs("Score_Gap"), 6), F.col("ingest_id")], F.col("Name"), F.col("Score_Gap")).filter(F.col("ord") < disagreements),
    ]
    out = sections[0]
    for section in sections[1:]:
        out = out.unionByName(section)
    return out


def documents(lines: DataFrame) -> DataFrame:
    """(section, lines): the lines of a section folded into one array, for a JSON document each.

    A section has a few lines, whatever the table's size.
    """
    line = F.struct("ord", "label", "value")
    return lines.groupBy("section").agg(F.array_sort(F.collect_list(line)).alias("lines"))
