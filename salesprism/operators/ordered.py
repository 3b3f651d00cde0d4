"""Global order statistics without a global task: running sums, quantiles, Gini, Lorenz.

Everything here rests on one distributed running sum: rows are range-partitioned in the
requested order, each partition sums alone, and the totals of the partitions before it are
added as an offset. Only one row per partition is ever brought together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.sales import limbs, of_limbs
from salesprism.session import cut_lineage

PART = "_part"


def running_sum(
    df: DataFrame,
    order_by: Sequence[Column],
    sums: Mapping[str, Column],
    group_by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Adds, per output name, the running total of a value in the given order.

    ``order_by`` must be total (end it with an id); ``group_by`` restarts the sums per group.
    The partition number of a row is a by-product of sampling, so it is written down with a
    checkpoint before it is used twice; a retried task cannot move a row afterwards.
    """
    spark = df.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(c) for c in group_by], *order_by)
    ranged = ranged.withColumns({f"_in_{n}": v for n, v in sums.items()})
    ranged = cut_lineage(ranged.withColumn(PART, F.spark_partition_id()))

    totals = ranged.groupBy(PART, *group_by).agg(*[F.sum(f"_in_{n}").alias(f"_in_{n}") for n in sums])
    before = Window.partitionBy(*group_by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(PART).alias("_off_part"),
        *[F.col(c).alias(f"_off_{c}") for c in group_by],
        *[F.sum(f"_in_{n}").over(before).alias(f"_off_in_{n}") for n in sums],
        F.lag(F.col(PART)).over(Window.partitionBy(*group_by).orderBy(PART)).alias("_previous"),
    ).where(F.col("_previous").isNotNull())
    # Only a group that reaches over a partition border has an offset, and a border splits at
    # most one group: never more rows than partitions, so this side is safe to broadcast.
    match = F.col(PART) == F.col("_off_part")
    for c in group_by:
        match = match & F.col(c).eqNullSafe(F.col(f"_off_{c}"))
    joined = ranged.join(F.broadcast(offsets), match, "left")

    inside = (
        Window.partitionBy(PART, *group_by)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    added = {
        n: F.sum(f"_in_{n}").over(inside) + F.coalesce(F.col(f"_off_in_{n}"), F.lit(0)) for n in sums
    }
    return joined.select(*df.columns, *[c.alias(n) for n, c in added.items()])


def value_frequencies(df: DataFrame, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts: the lossless form that order statistics need."""
    present = F.col(value).isNotNull()
    for c in group_by:
        present = present & F.col(c).isNotNull()
    return df.where(present).groupBy(*group_by, value).agg(F.count("*").alias("n"))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per probability.

    The built-in exact percentile keeps every distinct value of a group in one buffer. Here
    values are counted first, ranks come from the running sum, and each quantile picks the
    two values around its position.
    """
    freq = value_frequencies(df, value, group_by)
    ranked = running_sum(freq, [F.col(value)], {"_upto": F.col("n")}, group_by)
    if group_by:
        sizes = ranked.groupBy(*group_by).agg(F.max("_upto").alias("_size"))
        ranked = ranked.join(sizes, list(group_by))
    else:
        ranked = ranked.withColumn("_size", ranked.agg(F.max("_upto")).scalar())

    def at(position: Column) -> Column:
        covers = (F.col("_upto") - F.col("n") <= position) & (position < F.col("_upto"))
        return F.max(F.when(covers, F.col(value).cast("double")))

    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("_size") - 1)
        picks += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_w_{name}"),
        ]
    picked = ranked.groupBy(*group_by).agg(*picks)
    return picked.select(
        *group_by,
        *[
            (F.col(f"_lo_{n}") + F.col(f"_w_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n)
            for n in probabilities
        ],
    )


def exact_median(df: DataFrame, value: str, group_by: Sequence[str] = (), out: str = "median") -> DataFrame:
    return exact_quantiles(df, value, {out: 0.5}, group_by)


def gini(df: DataFrame, value: str = "Global_Sales") -> DataFrame:
    """Gini coefficient of the non-negative values; 0 for no rows or an all-zero column."""
    freq = value_frequencies(df.where(F.col(value) >= 0), value)
    ranked = running_sum(freq, [F.col(value)], {"_upto": F.col("n")})
    x, n, upto = F.col(value), F.col("n"), F.col("_upto").cast("double")
    # Equal values share a run of ranks whose sum has a closed form.
    rank_sum = n * (2.0 * upto - n + 1.0) / 2.0
    parts = ranked.agg(
        F.sum(n).cast("double").alias("rows"),
        F.sum(x * n).alias("total"),
        F.sum(x * rank_sum).alias("weighted"),
    )
    formula = 2.0 * F.col("weighted") / (F.col("rows") * F.col("total")) - (F.col("rows") + 1.0) / F.col("rows")
    return parts.select(F.when(F.coalesce("total", F.lit(0.0)) > 0, formula).otherwise(0.0).alias("gini"))


def lorenz_curve(df: DataFrame, value: str = "Global_Sales") -> DataFrame:
    """Cumulative share of rows and of the value, with the (0, 0) point.

    One point per distinct value: between equal values the curve is a straight line, so the
    points describe it completely.
    """
    freq = value_frequencies(df, value)
    parts = {f"_limb{i}": part * F.col("n") for i, part in enumerate(limbs(F.col(value)))}
    ranked = running_sum(freq, [F.col(value)], {"_rows": F.col("n"), **parts})
    whole = of_limbs([F.sum(part) for part in parts.values()])
    total = freq.agg(F.struct(F.sum("n").alias("rows"), whole.alias("sum")).alias("t")).scalar()
    points = ranked.withColumn("_t", total).select(
        (F.col("_rows") / F.col("_t.rows")).alias("row_share"),
        F.try_divide(of_limbs([F.col(name) for name in parts]), F.col("_t.sum")).alias("value_share"),
    )
    origin = df.sparkSession.createDataFrame([(0.0, 0.0)], "row_share double, value_share double")
    return origin.unionByName(points)


def pareto_curve(
    df: DataFrame, value: str = "Global_Sales", row_id: str = "ingest_id", line: float = 0.8
) -> DataFrame:
    """Every row with its rank by falling value, the cumulative share and the 80 % mark."""
    rows = df.where(F.col(value).isNotNull()).select(row_id, value)
    parts = {f"_limb{i}": part for i, part in enumerate(limbs(F.col(value)))}
    ranked = running_sum(rows, [F.desc(value), F.asc(row_id)], {"rank": F.lit(1).cast("bigint"), **parts})
    total = rows.agg(of_limbs([F.sum(part) for part in parts.values()])).scalar()
    share = F.try_divide(of_limbs([F.col(name) for name in parts]), total)
    return ranked.select(row_id, value, "rank", share.alias("cum_share")).withColumn(
        "within_line", F.col("cum_share") <= line
    )
