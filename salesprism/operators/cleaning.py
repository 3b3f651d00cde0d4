"""The cleaning steps of the raw listing table, each a DataFrame to DataFrame function."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesprism import schema
from salesprism.functions import dates, sales, text
from salesprism.operators.lookup import map_or, with_lookup

# Rejection rules in the order in which they are tried; a row carries the first that hits it.
NO_YEAR = "no_year"
AGGREGATE_ROW = "aggregate_row"
MISSING_KEY = "missing_key"
INVALID_SALES = "invalid_sales"
YEAR_OUT_OF_RANGE = "year_out_of_range"
DUPLICATE = "duplicate"
REJECTIONS = (NO_YEAR, AGGREGATE_ROW, MISSING_KEY, INVALID_SALES, YEAR_OUT_OF_RANGE, DUPLICATE)
AGGREGATE_PLATFORM = "series"
MODERN_SINCE = 2015
NUMBER = (text.strip, text.plain_decimal, text.finite)  # the steps of ``text.number``


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def null_missing_cells(df: DataFrame) -> DataFrame:
    """Missing markers to NULL in every text column."""
    return text.map_cells(df, [f.name for f in df.schema if isinstance(f.dataType, T.StringType)], text.null_markers)


def trim_text(df: DataFrame, columns: Sequence[str] = schema.TEXT_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return text.map_cells(df, present, text.strip, text.trimmed_markers)


def parse_dates_and_year(
    df: DataFrame, as_of_year: int, zero_year_is_null: bool = False
) -> DataFrame:
    """Typed dates and a clipped integer Year; rows without any year keep NULL here."""
    present = [c for c in ("Release_Date", "Last_Update") if c in df.columns]
    df = text.map_cells(df, present, dates.date_text, dates.date_of)
    missing = F.lit(None).cast("date")
    stated = F.lit(None).cast("double")
    if "Year" in df.columns:
        df = text.map_cells(df, ["Year"], *NUMBER)
        stated = F.col("Year")
    year = dates.known_year(
        stated,
        F.col("Release_Date") if "Release_Date" in present else missing,
        F.col("Last_Update") if "Last_Update" in present else missing,
        zero_year_is_null,
    )
    return df.withColumn("Year", dates.clip_year(year, as_of_year))


def coerce_numbers(df: DataFrame, columns: Sequence[str] = schema.NUMERIC_COLUMNS) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    typed = text.map_cells(df, present, *NUMBER)
    return typed.withColumn("Rank", F.col("Rank").cast("bigint")) if "Rank" in present else typed


def fill_sales(
    df: DataFrame,
    families: Mapping[str, str] = schema.PLATFORM_FAMILIES,
    regions: Sequence[str] = schema.REGIONS,
) -> DataFrame:
    """Platform spelling and family, missing genre, clipped regions, shipped units as sales."""
    regions = [c for c in regions if c in df.columns]
    df = df.withColumn("Platform", text.collapse_spaces(F.col("Platform")))
    df = with_lookup(df, "Platform", families, "_family")
    stated = F.col("Platform_Family") if "Platform_Family" in df.columns else F.lit(None).cast("string")
    genre = F.col("Genre") if "Genre" in df.columns else F.lit(None).cast("string")
    total = F.col("Global_Sales") if "Global_Sales" in df.columns else F.lit(None).cast("double")
    if "Total_Shipped" in df.columns:
        total = sales.backfill_sales(total, F.col("Total_Shipped"))
    df = df.withColumns(
        {
            "Platform_Family": F.coalesce(stated, "_family", F.lit(schema.UNKNOWN_FAMILY)),
            "Genre": F.coalesce(genre, F.lit(schema.UNKNOWN_GENRE)),
            **{c: sales.clip_negative(F.col(c)) for c in regions},
            "Global_Sales": total,
        }
    ).drop("_family")
    return df.withColumn("Regional_Sales_Sum", sales.row_sum(regions))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a projection that filters are not pushed through.

    A filter on a parsed column would else repeat the whole parsing expression for each use.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def rejection_reason(as_of_year: int, first_year: int = 1970) -> Column:
    """The first rule a row breaks, NULL for a row to keep."""
    return (
        F.when(F.col("Year").isNull(), NO_YEAR)
        .when(F.lower("Platform").eqNullSafe(AGGREGATE_PLATFORM), AGGREGATE_ROW)
        .when(
            F.col("Name").isNull() | F.col("Platform").isNull() | F.col("Global_Sales").isNull(),
            MISSING_KEY,
        )
        .when(~(F.col("Global_Sales") > 0), INVALID_SALES)
        .when(~F.col("Year").between(first_year, as_of_year), YEAR_OUT_OF_RANGE)
    )


def label_rejections(df: DataFrame, as_of_year: int, out: str = "rejection") -> DataFrame:
    return df.withColumn(out, rejection_reason(as_of_year))


def accepted(labelled: DataFrame, label: str = "rejection") -> DataFrame:
    return labelled.where(F.col(label).isNull()).drop(label)


def keep_first(
    df: DataFrame,
    key: Sequence[str] = schema.DEDUP_KEY,
    order: str = schema.INGEST_ID,
) -> DataFrame:
    """The row with the smallest ingest id per key; missing key parts equal each other.

    A grouped ``min_by`` rather than a ranking window: copies collapse before the shuffle, so
    a key that holds a third of the table still sends one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    grouped = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    picked = {c: F.col(f"_row.`{c}`") for c in rest}
    return grouped.select(*[picked[c].alias(c) if c in picked else F.col(c) for c in df.columns])


def removal_counts(labelled: DataFrame, key: Sequence[str] = schema.DEDUP_KEY, label: str = "rejection") -> DataFrame:
    """One row: how many rows each rule removes, copies as ``duplicate``, and ``rows`` of all.

    Rows are grouped once, rejected ones by their rule and kept ones by their key, so the table
    is read once and copies are combined before the shuffle.
    """
    kept = F.col(label).isNull()
    parts = [F.when(kept, F.col(k)).alias(f"_key{i}") for i, k in enumerate(key)]
    grouped = labelled.groupBy(F.col(label).alias("_rule"), *parts).agg(F.count("*").alias("n"))
    removed = {rule: F.when(F.col("_rule") == rule, F.col("n")) for rule in REJECTIONS[:-1]}
    removed[DUPLICATE] = F.when(F.col("_rule").isNull(), F.col("n") - 1)
    removed["rows"] = F.col("n")
    return grouped.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(rule) for rule, n in removed.items()])


def filter_audit(labelled: DataFrame, label: str = "rejection") -> DataFrame:
    """Rows removed per rule in rule order, every rule listed; one pass, no per-step count."""
    by_rule = removal_counts(labelled, label=label).unpivot([], list(REJECTIONS), "rule", "removed")
    position = sales.tier_order(F.col("rule"), [(rule, None) for rule in REJECTIONS])
    return by_rule.select(position.alias("step"), "rule", F.col("removed").cast("bigint").alias("removed"))


def retention(labelled: DataFrame, label: str = "rejection") -> DataFrame:
    """Initial and final rows with the retention and deduplication ratios; one pass."""
    totals = removal_counts(labelled, label=label).select(
        F.col("rows").cast("bigint").alias("initial_rows"),
        sum((F.col(rule) for rule in REJECTIONS), F.lit(0)).alias("removed"), F.col(DUPLICATE).alias("duplicates"),
    )
    initial = F.col("initial_rows").cast("double")
    return totals.select(
        "initial_rows",
        (F.col("initial_rows") - F.col("removed")).alias("final_rows"),
        sales.safe_ratio((F.col("initial_rows") - F.col("removed")).cast("double"), initial).alias("retention_rate"),
        sales.safe_ratio(F.col("duplicates").cast("double"), initial).alias("deduplication_rate"),
    )


def engineer_features(
    df: DataFrame,
    as_of_year: int,
    regions: Sequence[str] = schema.REGIONS,
    genre_labels: Mapping[str, str] = schema.GENRE_LABELS,
    family_labels: Mapping[str, str] = schema.FAMILY_LABELS,
    region_labels: Mapping[str, str] = schema.REGION_LABELS,
) -> DataFrame:
    """Labels, shares, tiers, score and date features of the kept rows."""
    regions = [c for c in regions if c in df.columns]
    if genre_labels:
        df = map_or(df, "Genre", genre_labels, "Genre", F.col("Genre"))
    df = map_or(df, "Platform_Family", family_labels, "Platform_Family_CN", F.lit(schema.UNKNOWN_FAMILY_LABEL))
    features: dict[str, Column] = {
        "Decade": dates.decade(F.col("Year")),
        "Age_Years": dates.age(F.col("Year"), as_of_year),
        "Is_Modern_Title": F.col("Year") >= MODERN_SINCE,
        "Sales_Tier": sales.tier(F.col("Global_Sales"), schema.SALES_TIERS),
        "Canonical_Name": text.canonical_name(F.col("Name")),
    }
    if regions:
        top = sales.row_argmax(regions)
        label = F.lit(None).cast("string")
        for name in reversed(regions):
            label = F.when(top == name, F.lit(region_labels.get(name))).otherwise(label)
        features["Top_Region"] = top
        features["Top_Region_CN"] = label
        for name in regions:
            features[f"{name}_Share"] = sales.share(F.col(name), F.nullif("Global_Sales", F.lit(0.0)))
    if "Release_Date" in df.columns:
        features["Release_Quarter"] = dates.quarter_label(F.col("Release_Date"))
    features["Has_Critic_Score"] = F.col("Critic_Score").isNotNull()
    features["Has_User_Score"] = F.col("User_Score").isNotNull()
    return score_features(df.withColumns(features))


def score_features(df: DataFrame) -> DataFrame:
    """Composite score, gap and score tier; applied again after scores were imputed.

    The presence flags stay as they were before imputation.
    """
    composite = sales.mean_of_two(F.col("Critic_Score"), F.col("User_Score"))
    return df.withColumns(
        {
            "Composite_Score": composite,
            "Score_Gap": F.col("Critic_Score") - F.col("User_Score"),
            "Score_Tier": sales.tier(composite, schema.SCORE_TIERS),
        }
    )


def conform(df: DataFrame, contract: T.StructType = schema.CLEAN_SCHEMA) -> DataFrame:
    """Column order and types of the contract; a missing column is an error, not a NULL."""
    missing = [f.name for f in contract if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the cleaned table: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in contract])
