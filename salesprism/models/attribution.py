"""Exact Shapley values of a model with few features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.functions.text import feature_label
from salesprism.models.supervised import CATEGORICAL, NUMERIC

BACKGROUND = 16
MOST_FEATURES = 8


def shapley_values(rows: DataFrame, background: DataFrame, predict: Callable[[DataFrame], DataFrame],
                   features: Sequence[str] = (*NUMERIC, *CATEGORICAL), predicted: str = "predicted") -> DataFrame:
    """(features, rows, base, predicted, phi array) of each distinct combination of features in ``rows``.

    The value of a coalition is the mean prediction with its features from the row and the others
    from each row of ``background``, a handful that is broadcast. A row becomes 2^features *
    background predictions; equal rows are evaluated once. The values sum to the row's
    prediction less the mean prediction of the background.
    """
    features, m = list(features), len(features)
    if m > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    distinct = rows.groupBy(*features).agg(F.count("*").alias("rows"))
    others = F.broadcast(background.select(*[F.col(f).alias(f"_b_{f}") for f in features]))
    mixed = distinct.crossJoin(others).withColumn("_in", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
    own = mixed.withColumns({f"_x_{f}": F.col(f) for f in features})
    filled = own.withColumns({
        f: F.when(F.col("_in").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"_x_{f}")).otherwise(F.col(f"_b_{f}")) for i, f in enumerate(features)
    })
    keys = [f"_x_{f}" for f in features]
    value = {f"v{s}": F.avg(F.when(F.col("_in") == s, F.col(predicted))) for s in range(1 << m)}
    values = predict(filled).groupBy(*keys, "rows").agg(*[v.alias(n) for n, v in value.items()])

    def phi(i: int):
        total = F.lit(0.0)
        for s in range(1 << m):
            if not s >> i & 1:
                size = s.bit_count()
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                total = total + weight * (F.col(f"v{s | 1 << i}") - F.col(f"v{s}"))
        return total

    return values.select(
        *[F.col(k).alias(f) for k, f in zip(keys, features, strict=True)], "rows", F.col("v0").alias("base"),
        F.col(f"v{(1 << m) - 1}").alias(predicted), F.array(*[phi(i) for i in range(m)]).alias("phi"),
    )


def mean_attribution(values: DataFrame, features: Sequence[str] = (*NUMERIC, *CATEGORICAL), k: int = 15) -> DataFrame:
    """(feature, attribution): the mean absolute value over all rows, largest first."""
    cells = F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("name"), F.col("phi").alias("phi"))).alias("cell")
    each = values.select("rows", cells).select("rows", F.col("cell.name").alias("name"), F.abs(F.col("cell.phi")).alias("size"))
    means = each.groupBy("name").agg((F.sum(F.col("size") * F.col("rows")) / F.sum("rows")).alias("attribution"))
    return means.orderBy(F.desc("attribution"), "name").limit(k).select(feature_label(F.col("name")).alias("feature"), "attribution")
