"""Market metrics: totals, shares, preferences, tiers, concentration and score quality.

A group is measured against the whole table through a scalar subquery, not a join, and every
category-wide ``limit`` carries a tie key so that results do not depend on task order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions.sales import exact_mean, exact_sum, safe_ratio, tier_order
from salesprism.operators.lookup import top_per_group
from salesprism.operators.ordered import exact_quantiles

SALES = "Global_Sales"


def summary(df: DataFrame, sales: str = SALES) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"),
        F.min("Year").alias("first_year"),
        F.max("Year").alias("last_year"),
        exact_sum(F.col(sales)).alias("total_sales"),
    )


def sales_by(df: DataFrame, keys: str | Sequence[str], sales: str = SALES, out: str = "sales") -> DataFrame:
    """Sum of sales per key; rows with a missing key part belong to no group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    present = df.dropna(subset=keys)
    return present.groupBy(*keys).agg(exact_sum(F.col(sales)).alias(out))


def top_by_sales(
    df: DataFrame, key: str, k: int, sales: str = SALES, ascending: bool = False, digits: int | None = None
) -> DataFrame:
    """Top (or, ``ascending``, bottom) ``k`` keys by sales."""
    order = F.asc("sales") if ascending else F.desc("sales")
    top = sales_by(df, key, sales).orderBy(order, F.asc(key)).limit(k)
    return top if digits is None else top.withColumn("sales", F.round("sales", digits))


def region_totals(df: DataFrame, regions: Sequence[str] = schema.REGIONS) -> DataFrame:
    """Total and share of the regional sum per region; shares are 0 for an empty table."""
    totals = df.agg(*[exact_sum(F.col(c)).alias(c) for c in regions])
    whole = sum((F.col(c) for c in regions[1:]), F.col(regions[0]))
    return (
        totals.withColumn("_whole", whole)
        .unpivot(["_whole"], list(regions), "region", "total")
        .select("region", "total", F.coalesce(safe_ratio(F.col("total"), F.col("_whole")), F.lit(0.0)).alias("share"))
    )


def named_groups(grouped: DataFrame, key: str, count: str) -> DataFrame:
    """The groups that have a key.

    The filter asks for the group's count too, so it stays above the aggregate: the groups and
    the total over all of them then come from one scan and one shuffle.
    """
    return grouped.where(F.when(F.col(count) > 0, F.col(key).isNotNull()))


def share_of_total(df: DataFrame, key: str, sales: str = SALES) -> DataFrame:
    """Sales per key over the sales of the whole table, rows without a key included."""
    groups = df.groupBy(key).agg(exact_sum(F.col(sales)).alias("sales"), F.count("*").alias("_rows"))
    whole = groups.agg(exact_sum(F.col("sales"))).scalar()
    return named_groups(groups, key, "_rows").select(
        key, "sales", F.coalesce(safe_ratio(F.col("sales"), whole), F.lit(0.0)).alias("share")
    )


def region_preference(
    df: DataFrame, key: str = "Genre", regions: Sequence[str] = schema.REGIONS
) -> DataFrame:
    """Regional mix of a group minus the regional mix of the table, one row per pair."""
    sums = [exact_sum(F.col(c)).alias(c) for c in regions]
    groups = df.groupBy(key).agg(*sums, F.count("*").alias("_rows"))
    whole = groups.agg(*sums).select(F.struct(*regions)).scalar()
    group_sum = sum((F.col(c) for c in regions[1:]), F.col(regions[0]))
    table = named_groups(groups, key, "_rows").withColumns({"_sum": group_sum, "_all": whole})
    all_sum = sum((F.col(f"_all.{c}") for c in regions[1:]), F.col(f"_all.{regions[0]}"))
    gaps = table.select(
        key,
        *[
            (F.coalesce(F.try_divide(F.col(c), F.col("_sum")), F.lit(0.0)) - F.try_divide(F.col(f"_all.{c}"), all_sum)).alias(c)
            for c in regions
        ],
    )
    return gaps.unpivot([key], list(regions), "region", "preference")


def entropy(df: DataFrame, value: str) -> DataFrame:
    """Shannon entropy in bits of a share vector given as one row per part.

    With S the total, H = log2 S - sum(x log2 x) / S, so a single aggregate is enough.
    """
    x = F.when(F.col(value) > 0, F.col(value))
    parts = df.agg(F.sum(x).alias("s"), F.sum(x * F.log2(x)).alias("t"))
    return parts.select(
        F.when(F.col("s") > 0, F.log2("s") - F.col("t") / F.col("s")).otherwise(0.0).alias("entropy")
    )


def group_diversity(df: DataFrame, key: str = "Platform_Family", sales: str = SALES) -> DataFrame:
    return entropy(sales_by(df, key, sales), "sales")


def publisher_reach(df: DataFrame, key: str = "Publisher", sales: str = SALES) -> DataFrame:
    """Sales and number of distinct decades per publisher."""
    return (
        df.dropna(subset=[key])
        .groupBy(key)
        .agg(exact_sum(F.col(sales)).alias("sales"), F.count_distinct("Decade").alias("decades"))
    )


def publisher_moat(df: DataFrame, k: int = 5, key: str = "Publisher") -> DataFrame:
    """0.7 relative sales + 0.3 relative decades, top ``k``."""
    reach = publisher_reach(df, key)
    best = reach.agg(F.struct(F.max("sales").alias("sales"), F.max("decades").alias("decades"))).scalar()
    score = 0.7 * F.try_divide(F.col("sales"), F.col("_best.sales")) + 0.3 * F.try_divide(
        F.col("decades"), F.col("_best.decades")
    )
    return (
        reach.withColumn("_best", best)
        .select(key, score.alias("moat_score"))
        .orderBy(F.desc("moat_score"), F.asc(key))
        .limit(k)
    )


def tier_contributions(
    df: DataFrame, tier: str = "Sales_Tier", sales: str = SALES, regions: Sequence[str] = schema.REGIONS
) -> DataFrame:
    """Per tier: sales, the regional mix inside it, mean sales and the lift over the table mean."""
    groups = df.groupBy(tier).agg(
        F.count("*").alias("titles"),
        F.count(F.col(sales)).alias("_sold"),
        exact_sum(F.col(sales)).alias("sales"),
        F.round(exact_mean(F.col(sales)), 4).alias("avg_sales"),
        *[exact_sum(F.col(c)).alias(c) for c in regions],
    )
    mean = groups.agg(F.try_divide(exact_sum(F.col("sales")), F.sum("_sold"))).scalar()
    regional = sum((F.col(c) for c in regions[1:]), F.col(regions[0]))
    return named_groups(groups, tier, "titles").withColumn("_regional", regional).select(
        F.col(tier).alias("tier"),
        tier_order(F.col(tier), schema.SALES_TIERS).alias("tier_ord"),
        "titles",
        "sales",
        *[safe_ratio(F.col(c), F.col("_regional")).alias(f"{c}_share") for c in regions],
        "avg_sales",
        safe_ratio(F.col("avg_sales"), mean).alias("lift"),
    )


def score_sales_matrix(df: DataFrame, sales: str = SALES) -> DataFrame:
    return sales_by(df, ["Score_Tier", "Sales_Tier"], sales).withColumn("sales", F.round("sales", 2))


def regional_resilience(
    df: DataFrame, key: str = "Platform_Family_CN", regions: Sequence[str] = schema.REGIONS
) -> DataFrame:
    """Regional concentration (HHI), entropy and dominant region per group.

    A zero regional total counts as missing; groups without any regional sales are left out.
    """
    totals = (
        df.dropna(subset=[key])
        .groupBy(key)
        .agg(*[F.nullif(exact_sum(F.col(c)), F.lit(0.0)).alias(c) for c in regions])
    )
    whole = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in regions[1:]), F.coalesce(F.col(regions[0]), F.lit(0.0)))
    shares = totals.withColumn("_whole", whole).where(F.col("_whole") != 0)
    shares = shares.select(key, *[(F.col(c) / F.col("_whole")).alias(c) for c in regions])
    hhi = sum((F.coalesce(F.pow(F.col(c), F.lit(2)), F.lit(0.0)) for c in regions), F.lit(0.0))
    bits = sum((F.coalesce(-F.col(c) * F.log2(F.col(c)), F.lit(0.0)) for c in regions), F.lit(0.0))
    top = F.greatest(*[F.col(c) for c in regions])
    dominant = F.lit(None).cast("string")
    for c in reversed(regions):
        dominant = F.when(F.col(c) == top, F.lit(c)).otherwise(dominant)
    return shares.select(key, hhi.alias("hhi"), bits.alias("entropy"), dominant.alias("dominant_region"))


def most_and_least_concentrated(resilience: DataFrame, key: str = "Platform_Family_CN", k: int = 3) -> DataFrame:
    most = resilience.orderBy(F.desc("hhi"), F.asc(key)).limit(k).withColumn("side", F.lit("concentrated"))
    least = resilience.orderBy(F.asc("hhi"), F.asc(key)).limit(k).withColumn("side", F.lit("diversified"))
    return most.unionByName(least).select("side", key, "hhi", "entropy", "dominant_region")


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def score_quartiles(df: DataFrame, score: str = "Composite_Score", approximate: bool = False) -> DataFrame:
    """Score quartiles; the approximate variant trades exactness for a single light pass."""
    if approximate:
        picks = F.percentile_approx(score, list(QUARTILES.values()), 100_000)
        out = df.agg(picks.alias("_q")).select(
            *[F.col("_q")[i].alias(n) for i, n in enumerate(QUARTILES)]
        )
    else:
        out = exact_quantiles(df, score, QUARTILES)
    return out.select(*[F.round(n, 2).alias(n) for n in QUARTILES])


def score_correlation(df: DataFrame, score: str = "Composite_Score", sales: str = SALES) -> DataFrame:
    """Pearson correlation over the rows where both values are present."""
    return df.agg(F.corr(score, sales).alias("correlation"))


def gap_summary(df: DataFrame, gap: str = "Score_Gap") -> DataFrame:
    return df.agg(
        F.avg(gap).alias("mean_gap"),
        F.stddev_samp(gap).alias("std_gap"),
        F.avg((F.col(gap) > 0).cast("double")).alias("share_positive"),
    )


def largest_disagreements(df: DataFrame, k: int = 5, row_id: str = schema.INGEST_ID) -> DataFrame:
    return (
        df.where(F.col("Score_Gap").isNotNull())
        .select(row_id, "Name", "Platform_Family_CN", "Score_Gap", "Global_Sales")
        .orderBy(F.desc(F.abs("Score_Gap")), F.asc(row_id))
        .limit(k)
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations in one aggregate, in long form with both triangles."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [
        F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{i}`").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ((a, b), (b, a))
    ]
    cells += [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("correlation")) for c in columns]
    return row.select(F.inline(F.array(*cells)))


def cluster_summary(
    df: DataFrame,
    label: str = "Regional_Cluster_Label",
    tops: Mapping[str, tuple[str, int]] | None = None,
    sales: str = SALES,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Size, mean sales and the most frequent values per group.

    ``tops`` maps an output name to (column, k); the lists arrive as arrays in rank order.
    """
    tops = tops or {"top_genres": ("Genre", 3), "top_platforms": ("Platform_Family_CN", 3)}
    rows = df.where(F.col(label).isNotNull())
    out = rows.groupBy(label).agg(
        F.count("*").alias("size"),
        exact_mean(F.col(sales)).alias("avg_sales"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    for name, (column, k) in tops.items():
        ranked = top_per_group(rows, [label], column, k)
        listed = ranked.groupBy(label).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", F.col(column).alias("v")))), lambda s: s["v"]
            ).alias(name)
        )
        out = out.join(listed, label, "left")
    return out
