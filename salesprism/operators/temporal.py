"""Metrics over years. Windows without a partition see one row per year, never raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.sales import exact_sum, safe_ratio


def yearly(df: DataFrame, year: str = "Year", sales: str = "Global_Sales") -> DataFrame:
    """Sales and number of named releases per year."""
    return (
        df.where(F.col(year).isNotNull())
        .groupBy(year)
        .agg(exact_sum(F.col(sales)).alias("sales"), F.count("Name").alias("releases"))
    )


def yoy_changes(per_year: DataFrame, year: str = "Year") -> DataFrame:
    """Relative change between consecutive observed years; a zero year counts as missing."""
    order = Window.orderBy(year)
    sales = F.nullif("sales", F.lit(0.0))
    return per_year.select(
        year, "sales", "releases", (F.try_divide(sales, F.lag(sales).over(order)) - 1.0).alias("yoy")
    )


def growth(per_year: DataFrame, year: str = "Year", recent: int = 5) -> DataFrame:
    """CAGR over observed years, volatility of the changes, recent release density."""
    sold = F.col("sales") != 0
    ends = per_year.where(sold).agg(
        F.min_by("sales", year).alias("first"), F.max_by("sales", year).alias("last"), F.count("*").alias("n")
    )
    cagr = ends.select(
        F.when(
            (F.col("n") >= 2) & (F.col("first") > 0),
            F.pow(F.col("last") / F.col("first"), 1.0 / F.greatest(F.col("n") - 1, F.lit(1))) - 1.0,
        ).otherwise(0.0)
    )
    changes = yoy_changes(per_year, year).agg(
        F.when(F.count("yoy") == 0, F.lit(0.0)).otherwise(F.stddev_samp("yoy")).alias("volatility")
    )
    density = per_year.orderBy(F.desc(year)).limit(recent).agg(
        F.coalesce(F.avg("releases"), F.lit(0.0)).alias("release_density")
    )
    return changes.select(cagr.scalar().alias("cagr"), "volatility", density.scalar().alias("release_density"))


def boom_and_bust(per_year: DataFrame, year: str = "Year", booms: int = 3, busts: int = 3) -> DataFrame:
    """Years with the largest and smallest relative change."""
    changes = yoy_changes(per_year, year).where(F.col("yoy").isNotNull()).select(year, "yoy")
    boom = changes.orderBy(F.desc("yoy"), F.asc(year)).limit(booms).withColumn("kind", F.lit("boom"))
    bust = changes.orderBy(F.asc("yoy"), F.asc(year)).limit(busts).withColumn("kind", F.lit("bust"))
    return boom.unionByName(bust).select("kind", year, "yoy")


def lifecycle(
    df: DataFrame, key: str = "Platform_Family_CN", year: str = "Year", sales: str = "Global_Sales"
) -> DataFrame:
    """Momentum and retention per platform from its own last years.

    Rows are summed per (platform, year) first; the span then comes from that small table.
    """
    per_year = df.dropna(subset=[key, year]).groupBy(key, year).agg(exact_sum(F.col(sales)).alias("sales"))
    own = Window.partitionBy(key)
    spans = per_year.withColumns({"_min": F.min(year).over(own), "_max": F.max(year).over(own)})
    recent_from = F.greatest(F.col("_max") - 2, F.col("_min"))
    kept_from = F.greatest(F.col("_max") - 4, F.col("_min"))

    def part(condition) -> F.Column:
        return exact_sum(F.when(condition, F.col("sales")))

    sums = spans.groupBy(key).agg(
        F.min("_min").alias("first_year"),
        F.max("_max").alias("last_year"),
        part(F.col(year) >= recent_from).alias("recent_sales"),
        part(F.col(year).between(recent_from - 3, recent_from - 1)).alias("_prior"),
        part(F.col(year) >= kept_from).alias("_kept"),
        exact_sum(F.col("sales")).alias("total_sales"),
    )
    return sums.select(
        key,
        "first_year",
        "last_year",
        (F.col("recent_sales") / (F.col("_prior") + 1e-6)).alias("momentum"),
        "recent_sales",
        "total_sales",
        safe_ratio(F.col("_kept"), F.col("total_sales")).alias("retention_share"),
    )


def rank_within_year(
    df: DataFrame, key: str = "Platform_Family_CN", year: str = "Year", sales: str = "Global_Sales"
) -> DataFrame:
    """Sales rank of every key within a year; ties share the lowest rank."""
    per_year = df.dropna(subset=[key, year]).groupBy(year, key).agg(exact_sum(F.col(sales)).alias("sales"))
    order = Window.partitionBy(year).orderBy(F.desc("sales"))
    return per_year.withColumn("rank", F.rank().over(order))


def with_min_years(ranked: DataFrame, key: str = "Platform_Family_CN", years: int = 5) -> DataFrame:
    """Keys observed in at least ``years`` years (one input row per key and year)."""
    long_lived = ranked.groupBy(key).agg(F.count("*").alias("_years")).where(F.col("_years") >= years)
    return ranked.join(long_lived.select(key), key, "left_semi")
