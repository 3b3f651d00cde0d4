"""The datasets behind the charts; drawing them is left to a plotting tool."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions.sales import exact_sum, tier, tier_order
from salesprism.functions.text import quarter_suffix
from salesprism.operators import market, temporal
from salesprism.operators.lookup import keep_top, map_or, top_keys
from salesprism.operators.ordered import exact_median, exact_quantiles, value_frequencies

SALES = "Global_Sales"
FAMILY = "Platform_Family_CN"
QUARTERS = ("Q1", "Q2", "Q3", "Q4")


def _sales(sales: str = SALES):
    return exact_sum(F.col(sales))


def log_histogram(df: DataFrame, value: str = SALES, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins of log10; the top edge belongs to the last bin."""
    logs = df.where(F.col(value) > 0).select(F.log10(value).alias("v"))
    span = logs.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    width = F.col("s.hi") - F.col("s.lo")
    place = F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("s.lo"), width) * bins), F.lit(0))
    return (
        logs.withColumn("s", span)
        .select(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


def box_statistics(df: DataFrame, key: str = "Genre", value: str = SALES) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count per group.

    Works on distinct values with counts, so a dominant group shrinks before it is shuffled.
    """
    freq = value_frequencies(df, value, [key])
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [key])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        freq.join(quartiles, key)
        .groupBy(key)
        .agg(
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def median_order(df: DataFrame, key: str = "Genre", value: str = SALES) -> DataFrame:
    """Category order for a box plot: medians, largest first."""
    return exact_median(df, value, [key]).orderBy(F.desc("median"), F.asc(key))


def top_publishers(df: DataFrame, k: int = 15) -> DataFrame:
    return market.top_by_sales(df, "Publisher", k)


def region_genre_means(df: DataFrame, k: int = 10, regions: Sequence[str] = schema.REGIONS) -> DataFrame:
    """Mean sales per genre and region of the top ``k`` genres, with a normal 95 % interval."""
    rows = keep_top(df, "Genre", _sales(), k).select("Genre", *regions)
    long = rows.unpivot(["Genre"], list(regions), "region", "sales")
    half = 1.96 * F.stddev_samp("sales") / F.sqrt(F.count("sales"))
    return long.groupBy("Genre", "region").agg(
        F.avg("sales").alias("mean"), (F.avg("sales") - half).alias("low"), (F.avg("sales") + half).alias("high")
    )


def sales_correlations(df: DataFrame, regions: Sequence[str] = schema.REGIONS) -> DataFrame:
    return market.correlation_matrix(df, [*regions, SALES])


def region_fit(df: DataFrame, x: str = "NA_Sales", y: str = "EU_Sales") -> DataFrame:
    """Straight line through two regions' sales."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )


def region_points(df: DataFrame, x: str = "NA_Sales", y: str = "EU_Sales") -> DataFrame:
    """The scatter itself: distinct points with their multiplicity."""
    return df.dropna(subset=[x, y]).groupBy(x, y).agg(F.count("*").alias("n"))


def top_titles(df: DataFrame, k: int = 100, row_id: str = schema.INGEST_ID, key: str = FAMILY) -> DataFrame:
    """Best sellers with a colour code per platform (codes follow the platform name)."""
    from pyspark.sql import Window

    top = (
        df.where(F.col(SALES).isNotNull())
        .select(row_id, "Name", "Year", SALES, key)
        .orderBy(F.desc(SALES), F.asc(row_id))
        .limit(k)
    )
    return top.withColumn("color_code", (F.dense_rank().over(Window.orderBy(key)) - 1).cast("int"))


def release_calendar(df: DataFrame) -> DataFrame:
    """Releases per year and quarter, wide, 0 where there were none."""
    rows = df.where(F.col("Year").isNotNull() & F.col("Release_Quarter").isNotNull())
    counts = rows.groupBy("Year", "Release_Quarter").agg(F.count("Name").alias("n"))
    wide = (
        counts.withColumn("quarter", quarter_suffix(F.col("Release_Quarter")))
        .groupBy("Year")
        .pivot("quarter", list(QUARTERS))
        .agg(F.sum("n"))
    )
    return wide.select("Year", *[F.coalesce(q, F.lit(0)).alias(q) for q in QUARTERS])


def hex_density(
    df: DataFrame, x: str = "Composite_Score", y: str = SALES, columns: int = 35, min_rows: int = 5
) -> DataFrame:
    """Counts in hexagonal cells: the nearer centre of two lattices shifted by half a cell."""
    rows_high = int(columns / math.sqrt(3))
    points = df.dropna(subset=[x, y]).select(F.col(x).alias("x"), F.col(y).alias("y"))
    box = points.agg(
        F.struct(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
        )
    ).scalar()
    sized = points.withColumn("b", box).withColumns(
        {"sx": (F.col("b.x1") - F.col("b.x0")) / columns, "sy": (F.col("b.y1") - F.col("b.y0")) / rows_high}
    )
    u = F.coalesce(F.try_divide(F.col("x") - F.col("b.x0"), F.col("sx")), F.lit(0.0))
    v = F.coalesce(F.try_divide(F.col("y") - F.col("b.y0"), F.col("sy")), F.lit(0.0))
    placed = sized.withColumns({"u": u, "v": v})
    du, dv = F.col("u") - F.rint("u"), F.col("v") - F.rint("v")
    eu = F.col("u") - F.floor("u") - 0.5
    ev = F.col("v") - F.floor("v") - 0.5
    on_grid = du * du + 3.0 * dv * dv < eu * eu + 3.0 * ev * ev
    cells = placed.select(
        F.when(on_grid, F.rint("u")).otherwise(F.floor("u") + 0.5).alias("cell_x"),
        F.when(on_grid, F.rint("v")).otherwise(F.floor("v") + 0.5).alias("cell_y"),
        (F.col("b.x0") + F.when(on_grid, F.rint("u")).otherwise(F.floor("u") + 0.5) * F.col("sx")).alias("center_x"),
        (F.col("b.y0") + F.when(on_grid, F.rint("v")).otherwise(F.floor("v") + 0.5) * F.col("sy")).alias("center_y"),
    )
    return (
        cells.groupBy("cell_x", "cell_y")
        .agg(F.first("center_x").alias("center_x"), F.first("center_y").alias("center_y"), F.count("*").alias("n"))
        .where(F.col("n") >= min_rows)
    )


def family_years(df: DataFrame, k: int = 6, key: str = FAMILY) -> DataFrame:
    """Yearly sales of the ``k`` biggest platform families."""
    per_year = market.sales_by(df, [key, "Year"])
    return keep_top(per_year, key, exact_sum(F.col("sales")), k)


def flow_triples(df: DataFrame, region: str = "Top_Region_CN", key: str = FAMILY) -> DataFrame:
    return market.sales_by(df, [key, "Genre", region])


def flow_edges(
    df: DataFrame, merged: bool = True, region: str = "Top_Region_CN", key: str = FAMILY
) -> DataFrame:
    """Platform to genre to region edges: summed per pair, or one pair of edges per triple."""
    triples = flow_triples(df, region, key)
    first = triples.select(F.lit(1).alias("level"), F.col(key).alias("source"), F.col("Genre").alias("target"), "sales")
    second = triples.select(F.lit(2).alias("level"), F.col("Genre").alias("source"), F.col(region).alias("target"), "sales")
    edges = first.unionByName(second)
    if not merged:
        return edges
    return edges.groupBy("level", "source", "target").agg(exact_sum(F.col("sales")).alias("sales"))


def flow_nodes(df: DataFrame, region: str = "Top_Region_CN", key: str = FAMILY) -> DataFrame:
    """Distinct node names over the three columns of the flow."""
    triples = flow_triples(df, region, key)
    names = [triples.select(F.col(c).alias("node")) for c in (key, "Genre", region)]
    return names[0].union(names[1]).union(names[2]).distinct()


def count_wide(
    df: DataFrame, column: str, values: Sequence[str | int], row: str = "Year", prefix: str = "", rest: str | None = None
) -> DataFrame:
    """Named titles per row key and column value, wide, 0-filled; the values are given.

    Titles of other values are counted in the column ``rest``. Without it they are an error, as
    the rows of the result would not add up to the table.
    """
    rows = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    counts = {f"{prefix}{v}": F.count(F.when(F.col(column) == v, F.col("Name"))) for v in values}
    other = F.count(F.when(~F.col(column).isin(*values), F.col("Name")))
    wide = rows.groupBy(row).agg(*[n.alias(name) for name, n in counts.items()], other.alias(rest or "_rest"))
    if rest:
        return wide
    told = F.raise_error(F.lit(f"{column} has values that are not listed"))
    first = next(iter(counts))
    return wide.withColumn(first, F.when(F.col("_rest") > 0, told).otherwise(F.col(first))).drop("_rest")


def age_cohorts(df: DataFrame) -> DataFrame:
    """Sales per age bucket and in total, every bucket listed."""
    bucket = tier(F.col("Age_Years"), schema.AGE_BUCKETS)
    parts = df.agg(
        *[
            exact_sum(F.when(bucket == name, F.col(SALES))).alias(f"b{i}")
            for i, (name, _) in enumerate(schema.AGE_BUCKETS)
        ],
        _sales().alias("total"),
    )
    cells = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("bucket"), F.col(f"b{i}").alias("sales"))
        for i, (name, _) in enumerate(schema.AGE_BUCKETS)
    ]
    cells.append(F.struct(F.lit(len(cells)).alias("step"), F.lit("total").alias("bucket"), F.col("total").alias("sales")))
    return parts.select(F.inline(F.array(*cells)))


def platform_ranks(df: DataFrame, min_years: int = 5, key: str = FAMILY) -> DataFrame:
    """Rank per year of the long-lived families; ranks are taken before the filter."""
    ranked = temporal.rank_within_year(df, key)
    return temporal.with_min_years(ranked, key, min_years).select("Year", key, "rank")


def genre_years(df: DataFrame, k: int = 8) -> DataFrame:
    """Yearly sales of the top ``k`` genres with 0 for years in which a genre sold nothing."""
    per_year = market.sales_by(df, ["Year", "Genre"])
    kept = keep_top(per_year, "Genre", exact_sum(F.col("sales")), k)
    # Every observed year next to every kept genre: at most k entries per year, no join.
    genres = kept.agg(F.array_sort(F.collect_set("Genre"))).scalar()
    grid = kept.groupBy("Year").agg(F.map_from_entries(F.collect_list(F.struct("Genre", "sales"))).alias("m"))
    return grid.select("Year", "m", F.explode(genres).alias("Genre")).select(
        "Year", "Genre", F.coalesce(F.try_element_at("m", F.col("Genre")), F.lit(0.0)).alias("sales")
    )


def score_quadrants(df: DataFrame, k: int = 6) -> DataFrame:
    """Scored titles around the two medians: counts per quadrant and top genre."""
    valid = df.where(F.col("Composite_Score").isNotNull() & (F.col(SALES) > 0))
    score_mid = exact_median(valid, "Composite_Score").scalar()
    sales_mid = exact_median(valid, SALES).scalar()
    top = F.broadcast(top_keys(valid, "Genre", _sales(), k).select(F.col("Genre").alias("_top")))
    high = F.when(F.col("Composite_Score") >= score_mid, "high_score").otherwise("low_score")
    sold = F.when(F.col(SALES) >= sales_mid, "high_sales").otherwise("low_sales")
    return (
        valid.join(top, F.col("Genre") == F.col("_top"), "left")
        .select(F.concat_ws("/", high, sold).alias("quadrant"), F.coalesce("_top", F.lit(schema.UNKNOWN_GENRE)).alias("genre"))
        .groupBy("quadrant", "genre")
        .agg(F.count("*").alias("n"))
    )


def genre_region_mix(df: DataFrame, k: int = 4, regions: Sequence[str] = schema.REGIONS) -> DataFrame:
    """Regional mix of the top ``k`` genres."""
    rows = keep_top(df, "Genre", _sales(), k)
    sums = rows.groupBy("Genre").agg(*[exact_sum(F.col(c)).alias(c) for c in regions])
    whole = sum((F.col(c) for c in regions[1:]), F.col(regions[0]))
    shares = sums.withColumn("_whole", whole).select(
        "Genre", *[F.try_divide(F.col(c), F.col("_whole")).alias(c) for c in regions]
    )
    return shares.unpivot(["Genre"], list(regions), "region", "share")


def yearly_line(df: DataFrame) -> DataFrame:
    return market.sales_by(df, "Year").withColumn("sales", F.round("sales", 2))


def region_stream(df: DataFrame, regions: Sequence[str] = schema.REGIONS) -> DataFrame:
    sums = [F.round(exact_sum(F.col(c)), 2).alias(c) for c in regions]
    return df.where(F.col("Year").isNotNull()).groupBy("Year").agg(*sums)


def genre_bars(df: DataFrame, k: int = 10) -> DataFrame:
    """Top genres, smallest bar first."""
    return market.top_by_sales(df, "Genre", k).orderBy(F.asc("sales"), F.desc("Genre"))


def platform_genre_cells(df: DataFrame, key: str = FAMILY) -> DataFrame:
    """Sales per platform and genre, one decimal, 0 for pairs that never occur.

    All observed genres stand next to all observed platforms: a few labels each, so a
    platform's cells are one small map.
    """
    sums = market.sales_by(df, [key, "Genre"]).where(F.col(key).isNotNull() & F.col("Genre").isNotNull())
    genres = sums.agg(F.array_sort(F.collect_set("Genre"))).scalar()
    grid = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("Genre", "sales"))).alias("m"))
    return grid.select(key, "m", F.explode(genres).alias("Genre")).select(
        key, "Genre", F.round(F.coalesce(F.try_element_at("m", F.col("Genre")), F.lit(0.0)), 1).alias("sales")
    )


def genre_radar(df: DataFrame, k: int = 5, regions: Sequence[str] = schema.REGIONS) -> DataFrame:
    """Region sums of the top genres with the axis maximum of each region."""
    from pyspark.sql import Window

    rows = keep_top(df, "Genre", _sales(), k)
    sums = rows.groupBy("Genre").agg(*[exact_sum(F.col(c)).alias(c) for c in regions])
    long = sums.unpivot(["Genre"], list(regions), "region", "sales")
    return long.withColumn("axis_max", F.max("sales").over(Window.partitionBy("region")) * 1.1)


def sunburst(df: DataFrame, region: str = "Top_Region_CN", key: str = FAMILY) -> DataFrame:
    return market.sales_by(df, [region, key])


def sunburst_tree(df: DataFrame, region: str = "Top_Region_CN", key: str = FAMILY) -> DataFrame:
    """Nested form for a JSON sink: one row per region with its platforms."""
    leaf = F.struct(F.col(key).alias("name"), F.col("sales").alias("value"))
    return sunburst(df, region, key).groupBy(F.col(region).alias("name")).agg(
        F.array_sort(F.collect_list(leaf)).alias("children")
    )


def platform_pie(df: DataFrame, key: str = "Platform_Family") -> DataFrame:
    """Share in percent per platform family, labelled; unknown families keep their name."""
    shares = market.share_of_total(df, key)
    labelled = map_or(shares, key, schema.FAMILY_LABELS, "label", F.col(key))
    return labelled.select(key, "label", F.round(F.col("share") * 100, 2).alias("percent"))


def tier_positions(df: DataFrame) -> DataFrame:
    return df.withColumn("tier_ord", tier_order(F.col("Sales_Tier"), schema.SALES_TIERS))
