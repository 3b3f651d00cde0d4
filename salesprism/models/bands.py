"""Quantile bands per row from the leaves of a regression forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.models.supervised import Encoder, _fitted_rows, fit_encoder

LEVELS = (0.1, 0.5, 0.9)
BUCKETS = 200
TREES = 20
DEPTH = 6


@dataclass
class Bands:
    encoder: Encoder
    model: object
    values: np.ndarray  # of the buckets, rising
    shares: np.ndarray  # (tree, leaf, bucket): what share of a leaf's training rows a bucket has
    levels: tuple[float, ...]

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with p10, p50, p90 (by the levels): quantiles of the rows it shares leaves with."""
        context = df.sparkSession.sparkContext
        shares, values, levels = context.broadcast(self.shares), self.values, np.array(self.levels)
        names = [f"p{round(100 * q)}" for q in self.levels]

        @F.pandas_udf("array<double>")
        def band(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for leaves in parts:
                at = np.array(leaves.tolist(), np.int64).reshape(len(leaves), -1)
                weight = sum(shares.value[t, at[:, t]] for t in range(at.shape[1]))
                upto = np.cumsum(weight, axis=1) / weight.sum(axis=1, keepdims=True)
                yield pd.Series([values[np.argmax(u[None, :] >= levels[:, None] - 1e-12, axis=1)] for u in upto])

        scored = self.model.transform(self.encoder.transform(df))
        scored = scored.withColumn("_band", band(vector_to_array("_leaves"))).drop("features", "prediction", "_leaves")
        return scored.withColumns({n: F.get("_band", F.lit(i)) for i, n in enumerate(names)}).drop("_band")


def fit_bands(df: DataFrame, id_col: str, target: str = "Global_Sales", levels: Sequence[float] = LEVELS,
              trees: int = TREES, depth: int = DEPTH, buckets: int = BUCKETS, seed: int = 42) -> Bands:
    """A forest whose leaves keep the distribution of their training targets.

    A row's distribution is the mean of its leaves'. Targets are counted in ``buckets`` of about
    equal size, so a leaf is a short histogram, all of them at most trees * 2^depth * buckets
    numbers, and no row meets the rows of its leaf.
    """
    rows = _fitted_rows(df.filter(F.col(target).isNotNull()), id_col, F.col(target)).filter("part <> 'test'")
    encoder = fit_encoder(rows)
    data = encoder.transform(rows).select("features", "label")
    forest = RandomForestRegressor(labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=20, leafCol="_leaves",
                                   maxBins=max(32, encoder.widest), featureSubsetStrategy="onethird", seed=seed)
    model = forest.fit(data)
    edges = sorted(set(data.approxQuantile("label", [i / buckets for i in range(1, buckets)], 0.1 / buckets)))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("label")))
    # The bucket is found before a row is repeated per tree.
    placed = model.transform(data.withColumn("bucket", bucket)).select("bucket", "label", F.posexplode(vector_to_array("_leaves")).alias("tree", "leaf"))
    counted = placed.groupBy("tree", F.col("leaf").cast("int").alias("leaf"), "bucket").agg(F.count("*").alias("n"), F.sum("label").alias("y")).toPandas()
    shares = np.zeros((trees, int(counted["leaf"].max()) + 1, len(edges) + 1))
    shares[counted["tree"], counted["leaf"], counted["bucket"]] = counted["n"]
    shares /= np.maximum(shares.sum(axis=2, keepdims=True), 1)
    sums = counted[counted["tree"] == 0].groupby("bucket")[["y", "n"]].sum()
    values = np.full(len(edges) + 1, np.nan)
    values[sums.index] = sums["y"] / sums["n"]
    values = pd.Series(values).ffill().bfill().to_numpy()
    return Bands(encoder, model, values, shares, tuple(levels))
