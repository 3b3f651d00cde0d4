"""Market and time metrics on the ``titles`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions import sales as sales_f
from salesprism.operators import lookup, market, ordered, profile, temporal
from salesprism.workload.registry import on_titles, total

GS = total("Global_Sales")
R = schema.REGIONS
FAMILY = "Platform_Family_CN"


@on_titles(
    "table_summary",
    f'SELECT count(*) AS row_count, min("Year") AS first_year, max("Year") AS last_year, {GS} AS total_sales FROM titles',
)
def _(t):
    return market.summary(t)


@on_titles(
    "region_totals",
    ", sums AS (SELECT " + ", ".join(f"{total(r)} AS {r}" for r in R) + " FROM titles), long AS ("
    + " UNION ALL ".join(f"SELECT '{r}' AS region, {r} AS total FROM sums" for r in R)
    + ") SELECT region, total, round(total / (SELECT sum(total) FROM long), 6) AS share FROM long",
)
def _(t):
    return market.region_totals(t)


for _key, _name in (("Genre", "top_genres"), ("Publisher", "top_publishers_10"), (FAMILY, "top_platform_families")):

    def _top(t, key=_key):
        return market.top_by_sales(t, key, 10, digits=2)

    on_titles(
        _name, f'SELECT "{_key}", round({GS}, 2) AS sales FROM titles GROUP BY 1 ORDER BY {GS} DESC, 1 LIMIT 10'
    )(_top)


@on_titles(
    "platform_share",
    f'SELECT "Platform_Family", {GS} AS sales, round({GS} / (SELECT {GS} FROM titles), 6) AS share FROM titles GROUP BY 1',
)
def _(t):
    return market.share_of_total(t, "Platform_Family")


@on_titles(
    "genre_region_preference",
    ", g AS (SELECT Genre, " + ", ".join(f"{total(r)} AS {r}" for r in R) + " FROM titles GROUP BY 1), a AS (SELECT "
    + ", ".join(f"{total(r)} AS {r}" for r in R) + " FROM titles) "
    + " UNION ALL ".join(
        f"""SELECT g.Genre AS "Genre", '{r}' AS region, round(g.{r} / (g.NA_Sales + g.EU_Sales + g.JP_Sales + g.Other_Sales)
        - a.{r} / (a.NA_Sales + a.EU_Sales + a.JP_Sales + a.Other_Sales), 6) AS preference FROM g, a"""
        for r in R
    ),
)
def _(t):
    return market.region_preference(t)


@on_titles(
    "platform_diversity_entropy",
    f", f AS (SELECT Platform_Family, {GS} AS s FROM titles GROUP BY 1), p AS (SELECT s / (SELECT sum(s) FROM f) AS p FROM f WHERE s > 0)"
    " SELECT round(-sum(p * log2(p)), 6) AS entropy FROM p",
)
def _(t):
    return market.group_diversity(t)


@on_titles(
    "publisher_reach",
    f'SELECT "Publisher", {GS} AS sales, count(DISTINCT Decade) AS decades FROM titles GROUP BY 1',
)
def _(t):
    return market.publisher_reach(t)


@on_titles(
    "publisher_moat",
    f", r AS (SELECT Publisher, {GS} AS s, count(DISTINCT Decade) AS d FROM titles GROUP BY 1)"
    ' SELECT Publisher AS "Publisher", round(0.7 * s / (SELECT max(s) FROM r) + 0.3 * d / (SELECT max(d) FROM r), 6) AS moat_score'
    " FROM r ORDER BY 0.7 * s / (SELECT max(s) FROM r) + 0.3 * d / (SELECT max(d) FROM r) DESC, Publisher LIMIT 5",
)
def _(t):
    return market.publisher_moat(t)


@on_titles(
    "tier_contributions",
    f", m AS (SELECT {GS} / count(*) AS mean FROM titles), t AS (SELECT Sales_Tier AS tier, count(*) AS titles, {GS} AS sales, "
    + ", ".join(f"{total(r)} AS {r}" for r in R)
    + " FROM titles GROUP BY 1) SELECT tier, CASE tier "
    + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(schema.SALES_TIERS))
    + " END AS tier_ord, titles, sales, "
    + ", ".join(f'round({r} / (NA_Sales + EU_Sales + JP_Sales + Other_Sales), 6) AS "{r}_share"' for r in R)
    + ", round(sales / titles, 4) AS avg_sales, round(round(sales / titles, 4) / (SELECT mean FROM m), 6) AS lift FROM t",
)
def tier_contributions(t):
    return market.tier_contributions(t)


@on_titles(
    "score_sales_matrix",
    f'SELECT "Score_Tier", "Sales_Tier", round({GS}, 2) AS sales FROM titles WHERE Score_Tier IS NOT NULL GROUP BY 1, 2',
)
def _(t):
    return market.score_sales_matrix(t)


RESILIENCE = (
    ", g AS (SELECT Platform_Family_CN, " + ", ".join(f"{total(r)} AS {r}" for r in R)
    + " FROM titles GROUP BY 1), l AS (SELECT *, NA_Sales + EU_Sales + JP_Sales + Other_Sales AS w FROM g), res AS (SELECT Platform_Family_CN, "
    + " + ".join(f"({r} / w) ** 2" for r in R)
    + " AS hhi, -("
    + " + ".join(f"coalesce({r} / w * log2(nullif({r} / w, 0)), 0)" for r in R)
    + ") AS entropy, CASE greatest(NA_Sales, EU_Sales, JP_Sales, Other_Sales) "
    + " ".join(f"WHEN {r} THEN '{r}'" for r in R)
    + " END AS dominant_region FROM l WHERE w <> 0)"
)


@on_titles(
    "regional_resilience",
    RESILIENCE + ' SELECT Platform_Family_CN AS "Platform_Family_CN", round(hhi, 6) AS hhi, round(entropy, 6) AS entropy, dominant_region FROM res',
)
def _(t):
    return market.regional_resilience(t)


@on_titles(
    "concentration_extremes",
    RESILIENCE
    + """ SELECT 'concentrated' AS side, Platform_Family_CN AS "Platform_Family_CN", round(hhi, 6) AS hhi, round(entropy, 6) AS entropy, dominant_region
    FROM (SELECT * FROM res ORDER BY hhi DESC, Platform_Family_CN LIMIT 3)
    UNION ALL SELECT 'diversified', Platform_Family_CN, round(hhi, 6), round(entropy, 6), dominant_region
    FROM (SELECT * FROM res ORDER BY hhi, Platform_Family_CN LIMIT 3)""",
)
def _(t):
    return market.most_and_least_concentrated(market.regional_resilience(t))


@on_titles(
    "score_quartiles",
    "SELECT round(quantile_cont(Composite_Score, 0.25), 2) AS q25, round(quantile_cont(Composite_Score, 0.5), 2) AS q50,"
    " round(quantile_cont(Composite_Score, 0.75), 2) AS q75 FROM titles",
)
def _(t):
    return market.score_quartiles(t)


@on_titles("score_sales_correlation", "SELECT round(corr(Composite_Score, Global_Sales), 6) AS correlation FROM titles")
def _(t):
    return market.score_correlation(t)


@on_titles(
    "score_gap_summary",
    "SELECT round(avg(Score_Gap), 6) AS mean_gap, round(stddev_samp(Score_Gap), 6) AS std_gap,"
    " round(avg(CASE WHEN Score_Gap > 0 THEN 1.0 WHEN Score_Gap IS NOT NULL THEN 0.0 END), 6) AS share_positive FROM titles",
)
def _(t):
    return market.gap_summary(t)


@on_titles(
    "largest_disagreements",
    'SELECT ingest_id, "Name", "Platform_Family_CN", round(Score_Gap, 6) AS "Score_Gap", "Global_Sales" FROM titles'
    " WHERE Score_Gap IS NOT NULL ORDER BY abs(titles.Score_Gap) DESC, ingest_id LIMIT 5",
)
def _(t):
    return market.largest_disagreements(t)


@on_titles(
    "cluster_insights",
    f""", lab AS (SELECT *, 'Cluster ' || CAST(title_id % 4 AS VARCHAR) AS label FROM titles),
    gc AS (SELECT label, Genre AS v, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, Genre) AS rn FROM lab GROUP BY 1, 2),
    pc AS (SELECT label, Platform_Family_CN AS v, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, Platform_Family_CN) AS rn FROM lab GROUP BY 1, 2)
    SELECT label AS "Regional_Cluster_Label", count(*) AS size, round({GS} / count(*), 6) AS avg_sales,
    (SELECT string_agg(v, '|' ORDER BY rn) FROM gc WHERE gc.label = lab.label AND rn <= 3) AS top_genres,
    (SELECT string_agg(v, '|' ORDER BY rn) FROM pc WHERE pc.label = lab.label AND rn <= 3) AS top_platforms
    FROM lab GROUP BY label""",
)
def _(t):
    labelled = t.withColumn(
        "Regional_Cluster_Label", F.concat(F.lit("Cluster "), (F.col("title_id") % 4).cast("string"))
    )
    return market.cluster_summary(labelled)


@on_titles(
    "sales_gini",
    ", s AS (SELECT Global_Sales AS x, row_number() OVER (ORDER BY Global_Sales) AS i, count(*) OVER () AS n FROM titles)"
    " SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 6) AS gini FROM s",
)
def _(t):
    return ordered.gini(t)


@on_titles(
    "publishers_grouped",
    """, top AS (SELECT Publisher FROM titles GROUP BY 1 ORDER BY count(*) DESC, Publisher LIMIT 30)
    SELECT CASE WHEN Publisher IN (SELECT Publisher FROM top) THEN Publisher ELSE 'OtherPublisher' END AS "Publisher_Grouped",
    count(*) AS n FROM titles GROUP BY 1""",
)
def _(t):
    grouped = lookup.group_rest(t, "Publisher", F.count("*"), 30, schema.OTHER_PUBLISHER, "Publisher_Grouped")
    return lookup.value_counts(grouped, "Publisher_Grouped")


@on_titles(
    "top_genre_titles",
    f", top AS (SELECT Genre FROM titles GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 3)"
    ' SELECT ingest_id, "Genre", "Global_Sales" FROM titles WHERE Genre IN (SELECT Genre FROM top)',
)
def _(t):
    return lookup.keep_top(t, "Genre", sales_f.exact_sum(F.col("Global_Sales")), 3).select("ingest_id", "Genre", "Global_Sales")


@on_titles(
    "other_genre_titles",
    f", top AS (SELECT Genre FROM titles GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 3)"
    ' SELECT ingest_id, "Genre", "Global_Sales" FROM titles WHERE Genre NOT IN (SELECT Genre FROM top)',
)
def _(t):
    return lookup.drop_top(t, "Genre", sales_f.exact_sum(F.col("Global_Sales")), 3).select("ingest_id", "Genre", "Global_Sales")


@on_titles(
    "top_genres_per_platform",
    """, c AS (SELECT Platform, Genre, count(*) AS n, row_number() OVER (PARTITION BY Platform ORDER BY count(*) DESC, Genre) AS position
    FROM titles GROUP BY 1, 2) SELECT Platform AS "Platform", Genre AS "Genre", n, position FROM c WHERE position <= 3""",
)
def _(t):
    return lookup.top_per_group(t, ["Platform"], "Genre", 3)


@on_titles(
    "yearly_sales_releases",
    f'SELECT "Year", {GS} AS sales, count("Name") AS releases FROM titles GROUP BY 1',
)
def _(t):
    return temporal.yearly(t)


YOY = f""", y AS (SELECT Year, {GS} AS sales, count(Name) AS releases FROM titles GROUP BY 1),
 d AS (SELECT Year, sales, releases, nullif(sales, 0) / lag(nullif(sales, 0)) OVER (ORDER BY Year) - 1 AS yoy FROM y)"""


@on_titles("yoy_changes", YOY + ' SELECT Year AS "Year", sales, releases, round(yoy, 6) AS yoy FROM d')
def _(t):
    return temporal.yoy_changes(temporal.yearly(t))


@on_titles(
    "growth_metrics",
    YOY
    + """ SELECT round(((SELECT arg_max(sales, Year) FROM y) / (SELECT arg_min(sales, Year) FROM y)) ** (1.0 / ((SELECT count(*) FROM y) - 1)) - 1, 6) AS cagr,
    round((SELECT stddev_samp(yoy) FROM d), 6) AS volatility,
    round((SELECT avg(releases) FROM (SELECT releases FROM y ORDER BY Year DESC LIMIT 5)), 6) AS release_density""",
)
def _(t):
    return temporal.growth(temporal.yearly(t))


@on_titles(
    "boom_and_bust_years",
    YOY
    + """ SELECT 'boom' AS kind, Year AS "Year", round(yoy, 6) AS yoy FROM (SELECT * FROM d WHERE yoy IS NOT NULL ORDER BY yoy DESC, Year LIMIT 3)
    UNION ALL SELECT 'bust', Year, round(yoy, 6) FROM (SELECT * FROM d WHERE yoy IS NOT NULL ORDER BY yoy, Year LIMIT 3)""",
)
def _(t):
    return temporal.boom_and_bust(temporal.yearly(t))


@on_titles(
    "platform_lifecycle",
    f""", py AS (SELECT Platform_Family_CN AS p, Year AS y, {GS} AS s FROM titles GROUP BY 1, 2),
    b AS (SELECT p, min(y) AS y0, max(y) AS y1, greatest(max(y) - 2, min(y)) AS r, greatest(max(y) - 4, min(y)) AS k FROM py GROUP BY 1)
    SELECT py.p AS "Platform_Family_CN", y0 AS first_year, y1 AS last_year,
    round(round(sum(CASE WHEN y >= r THEN s ELSE 0 END), 4) / (round(sum(CASE WHEN y BETWEEN r - 3 AND r - 1 THEN s ELSE 0 END), 4) + 1e-6), 6) AS momentum,
    round(sum(CASE WHEN y >= r THEN s ELSE 0 END), 4) AS recent_sales, round(sum(s), 4) AS total_sales,
    round(sum(CASE WHEN y >= k THEN s ELSE 0 END) / sum(s), 6) AS retention_share
    FROM py JOIN b ON py.p = b.p GROUP BY py.p, y0, y1""",
)
def _(t):
    return temporal.lifecycle(t)


@on_titles(
    "missing_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count(\"{c}\") AS missing, count(*) AS row_count FROM titles"
        for c in ("ingest_id", "Name", "Platform", "Year", "Genre", "Critic_Score", "User_Score", "Composite_Score", "Score_Tier")
    ),
)
def _(t):
    kept = t.select("ingest_id", "Name", "Platform", "Year", "Genre", "Critic_Score", "User_Score", "Composite_Score", "Score_Tier")
    return profile.column_profile(kept).drop("dtype")


@on_titles("year_span", "SELECT min(Year) AS first_year, max(Year) AS last_year FROM titles")
def _(t):
    return profile.year_span(t)


@on_titles(
    "full_duplicate_rows",
    """, g AS (SELECT count(*) AS n FROM titles GROUP BY Name, Platform, Genre, Year, Critic_Score)
    SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def _(t):
    return profile.full_duplicates(t.select("Name", "Platform", "Genre", "Year", "Critic_Score"))
