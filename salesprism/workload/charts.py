"""Datasets behind the charts on the ``titles`` view."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions.text import quarter_suffix
from salesprism.operators import charts, market, ordered
from salesprism.workload.registry import on_titles, tier_case, total

GS = total("Global_Sales")
R = schema.REGIONS
SUM4 = "round(sum(sales), 4)"


@on_titles(
    "log_histogram",
    """, l AS (SELECT log10(Global_Sales) AS v FROM titles WHERE Global_Sales > 0), s AS (SELECT min(v) AS lo, max(v) AS hi FROM l)
    SELECT CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n FROM l, s GROUP BY 1""",
)
def _(t):
    return charts.log_histogram(t)


def box_sql(key: str) -> str:
    return f""", q AS (SELECT "{key}" AS k, quantile_cont(Global_Sales, 0.25) AS q1, quantile_cont(Global_Sales, 0.5) AS med,
    quantile_cont(Global_Sales, 0.75) AS q3 FROM titles GROUP BY 1),
    j AS (SELECT q.*, Global_Sales AS x, Global_Sales BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
    FROM titles JOIN q ON titles."{key}" = q.k)
    SELECT k AS "{key}", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
    min(CASE WHEN inside THEN x END) AS whisker_low, max(CASE WHEN inside THEN x END) AS whisker_high,
    count(CASE WHEN NOT inside THEN 1 END) AS outliers FROM j GROUP BY k, q1, med, q3"""


@on_titles("box_by_genre", box_sql("Genre"))
def _(t):
    return charts.box_statistics(t, "Genre")


@on_titles("box_by_platform_family", box_sql("Platform_Family_CN"))
def _(t):
    return charts.box_statistics(t, "Platform_Family_CN")


@on_titles(
    "median_order", 'SELECT "Genre", round(quantile_cont(Global_Sales, 0.5), 6) AS median FROM titles GROUP BY 1'
)
def _(t):
    return charts.median_order(t)


@on_titles(
    "pareto_curve",
    """, r AS (SELECT ingest_id, Global_Sales, row_number() OVER w AS rank, sum(CAST(Global_Sales AS DECIMAL(18,4))) OVER w AS c
    FROM titles WINDOW w AS (ORDER BY Global_Sales DESC, ingest_id ROWS UNBOUNDED PRECEDING))
    SELECT ingest_id, Global_Sales AS "Global_Sales", rank, round(CAST(c AS DOUBLE) / (SELECT GS FROM (SELECT """
    + GS
    + """ AS GS FROM titles)), 6) AS cum_share,
    CAST(c AS DOUBLE) / (SELECT """
    + GS
    + " FROM titles) <= 0.8 AS within_line FROM r",
)
def _(t):
    return ordered.pareto_curve(t)


@on_titles(
    "top_publishers_15",
    f'SELECT "Publisher", {GS} AS sales FROM titles GROUP BY 1 ORDER BY {GS} DESC, 1 LIMIT 15',
)
def _(t):
    return charts.top_publishers(t)


@on_titles(
    "region_genre_means",
    f", top AS (SELECT Genre FROM titles GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 10), l AS ("
    + " UNION ALL ".join(f"SELECT Genre, '{r}' AS region, {r} AS s FROM titles WHERE Genre IN (SELECT Genre FROM top)" for r in R)
    + """) SELECT Genre AS "Genre", region, round(avg(s), 6) AS mean, round(avg(s) - 1.96 * stddev_samp(s) / sqrt(count(s)), 6) AS low,
    round(avg(s) + 1.96 * stddev_samp(s) / sqrt(count(s)), 6) AS high FROM l GROUP BY 1, 2""",
)
def _(t):
    return charts.region_genre_means(t)


@on_titles(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, " + ("1.0" if a == b else f"round(corr({a}, {b}), 6)") + "::DOUBLE AS correlation FROM "
        + ("(SELECT 1)" if a == b else "titles")
        for a in (*R, "Global_Sales")
        for b in (*R, "Global_Sales")
    ),
)
def _(t):
    return charts.sales_correlations(t)


@on_titles(
    "lorenz_curve",
    f""", v AS (SELECT Global_Sales AS x, count(*) AS n FROM titles GROUP BY 1),
    c AS (SELECT sum(n) OVER w AS cn, sum(n * CAST(x AS DECIMAL(18,4))) OVER w AS cs FROM v WINDOW w AS (ORDER BY x))
    SELECT 0.0::DOUBLE AS row_share, 0.0::DOUBLE AS value_share UNION ALL
    SELECT round(CAST(cn AS DOUBLE) / (SELECT count(*) FROM titles), 6), round(CAST(cs AS DOUBLE) / (SELECT {GS} FROM titles), 6) FROM c""",
)
def _(t):
    return ordered.lorenz_curve(t)


@on_titles(
    "region_fit",
    "SELECT round(regr_slope(EU_Sales, NA_Sales), 6) AS slope, round(regr_intercept(EU_Sales, NA_Sales), 6) AS intercept,"
    " round(regr_r2(EU_Sales, NA_Sales), 6) AS r2, CAST(regr_count(EU_Sales, NA_Sales) AS BIGINT) AS n FROM titles",
)
def _(t):
    return charts.region_fit(t)


@on_titles("region_points", 'SELECT "NA_Sales", "EU_Sales", count(*) AS n FROM titles GROUP BY 1, 2')
def _(t):
    return charts.region_points(t)


@on_titles(
    "top_titles",
    """, top AS (SELECT ingest_id, Name, Year, Global_Sales, Platform_Family_CN FROM titles ORDER BY Global_Sales DESC, ingest_id LIMIT 100)
    SELECT ingest_id, Name AS "Name", Year AS "Year", Global_Sales AS "Global_Sales", Platform_Family_CN AS "Platform_Family_CN",
    CAST(dense_rank() OVER (ORDER BY Platform_Family_CN) - 1 AS INTEGER) AS color_code FROM top""",
)
def _(t):
    return charts.top_titles(t)


@on_titles(
    "release_calendar",
    'SELECT "Year", ' + ", ".join(f"count(CASE WHEN right(Release_Quarter, 2) = '{q}' THEN Name END) AS \"{q}\"" for q in charts.QUARTERS)
    + " FROM titles GROUP BY 1",
)
def _(t):
    return charts.release_calendar(t)


@on_titles(
    "quarter_suffixes",
    "SELECT right(Release_Quarter, 2) AS quarter, count(*) AS n FROM titles GROUP BY 1",
)
def _(t):
    return t.groupBy(quarter_suffix(F.col("Release_Quarter")).alias("quarter")).agg(F.count("*").alias("n"))


HEX_ROWS = int(35 / math.sqrt(3))


@on_titles(
    "hex_density",
    f""", p AS (SELECT Composite_Score AS x, Global_Sales AS y FROM titles WHERE Composite_Score IS NOT NULL),
    b AS (SELECT min(x) AS x0, (max(x) - min(x)) / 35 AS sx, min(y) AS y0, (max(y) - min(y)) / {HEX_ROWS} AS sy FROM p),
    g AS (SELECT x0, sx, y0, sy, (x - x0) / sx AS u, (y - y0) / sy AS v FROM p, b),
    d AS (SELECT *, round_even(u, 0) AS u1, round_even(v, 0) AS v1, floor(u) + 0.5 AS u2, floor(v) + 0.5 AS v2 FROM g),
    e AS (SELECT *, (u - u1) * (u - u1) + 3.0 * (v - v1) * (v - v1)
      < (u - floor(u) - 0.5) * (u - floor(u) - 0.5) + 3.0 * (v - floor(v) - 0.5) * (v - floor(v) - 0.5) AS grid FROM d)
    SELECT CASE WHEN grid THEN u1 ELSE u2 END AS cell_x, CASE WHEN grid THEN v1 ELSE v2 END AS cell_y,
    round(min(x0 + CASE WHEN grid THEN u1 ELSE u2 END * sx), 6) AS center_x,
    round(min(y0 + CASE WHEN grid THEN v1 ELSE v2 END * sy), 6) AS center_y, count(*) AS n FROM e GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def _(t):
    return charts.hex_density(t)


@on_titles(
    "family_years",
    f""", top AS (SELECT Platform_Family_CN FROM titles GROUP BY 1 ORDER BY {GS} DESC, 1 LIMIT 6)
    SELECT "Platform_Family_CN", "Year", {GS} AS sales FROM titles WHERE Platform_Family_CN IN (SELECT Platform_Family_CN FROM top) GROUP BY 1, 2""",
)
def _(t):
    return charts.family_years(t)


TRIPLES = f", tr AS (SELECT Platform_Family_CN AS p, Genre AS g, Top_Region_CN AS r, {GS} AS sales FROM titles GROUP BY 1, 2, 3)"


@on_titles(
    "flow_triples",
    TRIPLES + ' SELECT p AS "Platform_Family_CN", g AS "Genre", r AS "Top_Region_CN", sales FROM tr',
)
def _(t):
    return charts.flow_triples(t)


@on_titles(
    "flow_edges_merged",
    TRIPLES + f" SELECT 1 AS level, p AS source, g AS target, {SUM4} AS sales FROM tr GROUP BY 2, 3"
    f" UNION ALL SELECT 2, g, r, {SUM4} FROM tr GROUP BY 2, 3",
)
def _(t):
    return charts.flow_edges(t)


@on_titles(
    "flow_edges_per_triple",
    TRIPLES + " SELECT 1 AS level, p AS source, g AS target, sales FROM tr UNION ALL SELECT 2, g, r, sales FROM tr",
)
def _(t):
    return charts.flow_edges(t, merged=False)


@on_titles(
    "flow_nodes",
    TRIPLES + " SELECT p AS node FROM tr UNION SELECT g FROM tr UNION SELECT r FROM tr",
)
def _(t):
    return charts.flow_nodes(t)


@on_titles(
    "cluster_release_counts",
    'SELECT "Year", ' + ", ".join(f"count(CASE WHEN title_id % 4 = {c} THEN Name END) AS cluster_{c}" for c in range(4))
    + " FROM titles GROUP BY 1",
)
def _(t):
    labelled = t.withColumn("cluster", (F.col("title_id") % 4).cast("int"))
    return charts.count_wide(labelled, "cluster", range(4), prefix="cluster_")


@on_titles(
    "age_cohorts",
    f", b AS (SELECT {tier_case('Age_Years', schema.AGE_BUCKETS)} AS bucket, Global_Sales FROM titles) "
    + " UNION ALL ".join(
        f"SELECT {i} AS step, '{n}' AS bucket, (SELECT {GS} FROM b WHERE bucket = '{n}') AS sales"
        for i, (n, _) in enumerate(schema.AGE_BUCKETS)
    )
    + f" UNION ALL SELECT {len(schema.AGE_BUCKETS)}, 'total', (SELECT {GS} FROM b)",
)
def _(t):
    return charts.age_cohorts(t)


@on_titles(
    "platform_ranks",
    f""", py AS (SELECT Year, Platform_Family_CN, rank() OVER (PARTITION BY Year ORDER BY {GS} DESC) AS rank FROM titles GROUP BY 1, 2),
    k AS (SELECT Platform_Family_CN FROM py GROUP BY 1 HAVING count(*) >= 5)
    SELECT Year AS "Year", Platform_Family_CN AS "Platform_Family_CN", CAST(rank AS INTEGER) AS rank FROM py
    WHERE Platform_Family_CN IN (SELECT Platform_Family_CN FROM k)""",
)
def _(t):
    return charts.platform_ranks(t)


@on_titles(
    "genre_years",
    f""", top AS (SELECT Genre FROM titles GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 8), ys AS (SELECT DISTINCT Year FROM titles)
    SELECT ys.Year AS "Year", top.Genre AS "Genre", (SELECT {GS} FROM titles t WHERE t.Year = ys.Year AND t.Genre = top.Genre) AS sales FROM ys, top""",
)
def _(t):
    return charts.genre_years(t)


@on_titles(
    "score_quadrants",
    f""", v AS (SELECT Composite_Score AS c, Global_Sales AS s, Genre, Global_Sales FROM titles WHERE Composite_Score IS NOT NULL AND Global_Sales > 0),
    top AS (SELECT Genre FROM v GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 6),
    m AS (SELECT quantile_cont(c, 0.5) AS mc, quantile_cont(s, 0.5) AS ms FROM v)
    SELECT CASE WHEN c >= mc THEN 'high_score' ELSE 'low_score' END || '/' || CASE WHEN s >= ms THEN 'high_sales' ELSE 'low_sales' END AS quadrant,
    CASE WHEN Genre IN (SELECT Genre FROM top) THEN Genre ELSE '{schema.UNKNOWN_GENRE}' END AS genre, count(*) AS n FROM v, m GROUP BY 1, 2""",
)
def _(t):
    return charts.score_quadrants(t)


@on_titles(
    "genre_region_mix",
    f", top AS (SELECT Genre FROM titles GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 4), g AS (SELECT Genre, "
    + ", ".join(f"{total(r)} AS {r}" for r in R)
    + " FROM titles WHERE Genre IN (SELECT Genre FROM top) GROUP BY 1) "
    + " UNION ALL ".join(
        f"""SELECT Genre AS "Genre", '{r}' AS region, round({r} / (NA_Sales + EU_Sales + JP_Sales + Other_Sales), 6) AS share FROM g""" for r in R
    ),
)
def _(t):
    return charts.genre_region_mix(t)


@on_titles("yearly_line", f'SELECT "Year", round({GS}, 2) AS sales FROM titles GROUP BY 1')
def _(t):
    return charts.yearly_line(t)


@on_titles(
    "region_stream",
    'SELECT "Year", ' + ", ".join(f'round({total(r)}, 2) AS "{r}"' for r in R) + " FROM titles GROUP BY 1",
)
def _(t):
    return charts.region_stream(t)


@on_titles("genre_bars", f'SELECT "Genre", {GS} AS sales FROM titles GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10')
def _(t):
    return charts.genre_bars(t)


@on_titles(
    "platform_genre_cells",
    f""", p AS (SELECT DISTINCT Platform_Family_CN FROM titles), g AS (SELECT DISTINCT Genre FROM titles)
    SELECT p.Platform_Family_CN AS "Platform_Family_CN", g.Genre AS "Genre", round((SELECT {GS} FROM titles t
    WHERE t.Platform_Family_CN = p.Platform_Family_CN AND t.Genre = g.Genre), 1) AS sales FROM p, g""",
)
def _(t):
    return charts.platform_genre_cells(t)


@on_titles(
    "genre_radar",
    f", top AS (SELECT Genre FROM titles GROUP BY 1 ORDER BY {GS} DESC, Genre LIMIT 5), l AS ("
    + " UNION ALL ".join(
        f"SELECT Genre, '{r}' AS region, {total(r)} AS sales FROM titles WHERE Genre IN (SELECT Genre FROM top) GROUP BY 1" for r in R
    )
    + ') SELECT Genre AS "Genre", region, sales, round(max(sales) OVER (PARTITION BY region) * 1.1, 6) AS axis_max FROM l',
)
def _(t):
    return charts.genre_radar(t)


@on_titles(
    "sunburst",
    f'SELECT "Top_Region_CN", "Platform_Family_CN", {GS} AS sales FROM titles GROUP BY 1, 2',
)
def _(t):
    return charts.sunburst(t)


@on_titles(
    "platform_pie",
    f'SELECT t."Platform_Family", coalesce(any_value(fl.label), t."Platform_Family") AS label,'
    f" round({GS} / (SELECT {GS} FROM titles) * 100, 2) AS percent"
    " FROM titles t LEFT JOIN family_labels fl ON fl.family = t.Platform_Family GROUP BY 1",
)
def _(t):
    return charts.platform_pie(t)


@on_titles(
    "scored_titles",
    'SELECT ingest_id, round(Composite_Score, 6) AS "Composite_Score", "Global_Sales" FROM titles WHERE Composite_Score IS NOT NULL AND Global_Sales > 0',
)
def _(t):
    return t.where(F.col("Composite_Score").isNotNull() & (F.col("Global_Sales") > 0)).select(
        "ingest_id", "Composite_Score", "Global_Sales"
    )


@on_titles(
    "preference_picks",
    ", g AS (SELECT Genre, " + ", ".join(f"{total(r)} AS {r}" for r in R) + " FROM titles GROUP BY 1), a AS (SELECT "
    + ", ".join(f"{total(r)} AS {r}" for r in R) + " FROM titles), l AS ("
    + " UNION ALL ".join(
        f"""SELECT g.Genre AS genre, '{r}' AS region, g.{r} / (g.NA_Sales + g.EU_Sales + g.JP_Sales + g.Other_Sales)
        - a.{r} / (a.NA_Sales + a.EU_Sales + a.JP_Sales + a.Other_Sales) AS p FROM g, a"""
        for r in R
    )
    + ') SELECT genre AS "Genre", region, round(p, 6) AS preference FROM l ORDER BY p DESC, genre, region LIMIT 8',
)
def _(t):
    return market.region_preference(t).orderBy(F.desc("preference"), "Genre", "region").limit(8)
