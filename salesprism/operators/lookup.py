"""Dictionary lookups, top-K membership, and groups measured against the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000


def lookup_table(spark: SparkSession, entries: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A dictionary as a two-column table. It is broadcast only while it is small."""
    table = spark.createDataFrame(list(entries.items()), f"`{key}` string, `{value}` string")
    return F.broadcast(table) if len(entries) <= BROADCAST_ROWS else table


def with_lookup(df: DataFrame, column: str, entries: Mapping[str, str], out: str) -> DataFrame:
    """Left lookup of ``column``; ``out`` is NULL where the dictionary has no entry."""
    table = lookup_table(df.sparkSession, entries, "_lookup_key", "_lookup_value")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    joined = df.join(table, F.col(column) == F.col("_lookup_key"), "left")
    return joined.select(*kept, F.col("_lookup_value").alias(out))


def map_or(df: DataFrame, column: str, entries: Mapping[str, str], out: str, default: Column) -> DataFrame:
    """Lookup with a default, e.g. a literal or the column itself."""
    mapped = with_lookup(df, column, entries, "_mapped")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    return mapped.select(*kept, F.coalesce("_mapped", default).alias(out))


def top_keys(df: DataFrame, key: str, measure: Column, k: int) -> DataFrame:
    """The ``k`` keys with the largest measure; ties go to the smaller key."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(measure.alias("_measure"))
        .orderBy(F.desc("_measure"), F.asc(key))
        .limit(k)
    )


def keep_top(df: DataFrame, key: str, measure: Column, k: int) -> DataFrame:
    """Rows whose key is in the top ``k``: a semi join against at most ``k`` rows."""
    return df.join(F.broadcast(top_keys(df, key, measure, k).select(key)), key, "left_semi")


def drop_top(df: DataFrame, key: str, measure: Column, k: int) -> DataFrame:
    """Rows whose key is not in the top ``k``, missing keys included."""
    return df.join(F.broadcast(top_keys(df, key, measure, k).select(key)), key, "left_anti")


def group_rest(
    df: DataFrame, key: str, measure: Column, k: int, other: str, out: str
) -> DataFrame:
    """Keys outside the top ``k`` (and missing ones) become ``other``."""
    top = F.broadcast(top_keys(df, key, measure, k).select(F.col(key).alias("_top")))
    kept = [c for c in df.columns if c.lower() != out.lower()]
    return df.join(top, F.col(key) == F.col("_top"), "left").select(
        *kept, F.coalesce("_top", F.lit(other)).alias(out)
    )


def top_per_group(df: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """Most frequent values per group with their rank; ties go to the smaller value.

    Rows are counted before the window sees them, and the rank limit is applied before the
    shuffle too, so a hot group costs one small row per value.
    """
    from pyspark.sql import Window

    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
