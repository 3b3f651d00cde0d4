"""Feature preparation: fills, standardising, share vectors, splits and anchors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.models.statistics import quantiles


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the column's exact median; a column without values stays missing.

    The medians of all columns come from the same passes, made when this is called.
    """
    medians = quantiles(df, dict.fromkeys(columns, 0.5))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items() if m is not None})


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean 0 and population deviation 1 per column; a constant column becomes 0.

    One aggregate for all columns, joined as a single row when the result is computed.
    """
    facts = df.agg(F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("spread")).alias(c) for c in columns])).scalar()

    def scaled(c: str) -> Column:
        spread = facts[c]["spread"]
        return (F.col(c) - facts[c]["mean"]) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)

    return df.withColumns({c: scaled(c) for c in columns})


def region_vectors(df: DataFrame, regions: Sequence[str] = schema.REGIONS, suffix: str = "_Part") -> DataFrame:
    """Each region's part of the row's regional sum, a missing one counting 0; all 0 for rows that sold nothing."""
    sold = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in regions}
    whole = sum(sold.values(), F.lit(0.0))
    return df.withColumns({c + suffix: F.when(whole > 0, v / whole).otherwise(F.lit(0.0)) for c, v in sold.items()})


def spread_id(id_col: str, modulus: int = 1000) -> Column:
    """A scattered remainder of an integer id: the same on every run and partitioning."""
    return F.pmod(F.pmod(F.col(id_col).cast("long"), F.lit(2147483647)) * 48271 % 2147483647, F.lit(modulus))


def train_test(df: DataFrame, id_col: str, test_share: float = 0.2) -> DataFrame:
    """``part`` is test for about ``test_share`` of the ids, train for the others.

    The choice depends on the id alone, so every stratum is split in about the same share and
    no row changes sides when others are added.
    """
    test = spread_id(id_col) < round(1000 * test_share)
    return df.withColumn("part", F.when(test, "test").otherwise("train"))


def anchors(df: DataFrame, id_col: str, k: int = 10, name: str = "Name", sales: str = "Global_Sales") -> DataFrame:
    """The best row of each of the ``k`` best-selling names; the smaller id wins ties."""
    best = df.groupBy(name).agg(F.max(F.struct(F.col(sales).alias("s"), (-F.col(id_col)).alias("i"))).alias("b"))
    rows = best.select((-F.col("b.i")).alias(id_col), name, F.col("b.s").alias(sales))
    return rows.orderBy(F.desc(sales), id_col).limit(k)
