"""Soft behaviour segments: a Gaussian mixture over principal components."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions.sales import exact_sum
from salesprism.models.clusters import Projection, fit_projection
from salesprism.models.statistics import linear
from salesprism.operators.cleaning import settled
from salesprism.operators.market import cluster_summary
from salesprism.operators.ordered import exact_median
from salesprism.session import cut_lineage, written_once

EXTRAS = ("Age_Years", "Composite_Score", "Global_Sales")
FEWEST_ROWS = 60
RESTARTS = 3
BLOCK_ROWS = 1 << 14
EPSILON = float(np.finfo(float).eps)


@dataclass
class Mixture:
    """Weights, means and covariances of Gaussian components."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def forms(self) -> list[tuple[np.ndarray, float]]:
        """Per component the matrix that whitens it and the logarithm of its density at the mean.

        Directions without spread count neither for the distance nor for the determinant.
        """
        out = []
        for covariance in self.covariances:
            values, vectors = np.linalg.eigh(covariance)
            some = values > EPSILON * values.max() * len(values)
            root = np.where(some, 1 / np.sqrt(np.where(some, values, 1.0)), 0.0)
            out.append((root[:, None] * vectors.T, -0.5 * (len(values) * np.log(2 * np.pi) + np.log(values[some]).sum())))
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What a step needs of points, the columns of ``x``: their log-likelihood, then per component weight, sums and products."""
        shares = np.empty((len(self.weights), x.shape[1]))
        for share, weight, mean, (root, top) in zip(shares, self.weights, self.means, self.forms(), strict=True):
            apart = root @ (x - mean[:, None])
            share[:] = EPSILON + weight * np.exp(top - 0.5 * (apart * apart).sum(axis=0))
        whole = shares.sum(axis=0)
        shares /= whole
        products = [(x * share) @ x.T for share in shares]
        return np.concatenate([[np.log(whole).sum()], shares.sum(axis=1), (shares @ x.T).ravel(), np.ravel(products)])

    def stepped(self, sums: np.ndarray) -> Mixture:
        """The mixture of the next step from the ``sums`` of all points."""
        k, d = self.means.shape
        weights, means, products = np.split(sums[1:], [k, k + k * d])
        means = means.reshape(k, d) / weights[:, None]
        covariances = products.reshape(k, d, d) / weights[:, None, None] - means[:, :, None] * means[:, None, :]
        return Mixture(weights / fsum(weights), means, covariances)


@dataclass
class Segments:
    """A fitted mixture, components by falling weight."""

    features: list[str]
    projection: Projection
    mixture: Mixture
    order: list[int]
    likelihoods: list[float]
    rows: int

    @property
    def parameters(self) -> int:
        k, d = len(self.order), self.projection.loadings.shape[1]
        return k - 1 + k * d + k * d * (d + 1) // 2

    @property
    def bic(self) -> float:
        from math import log

        return self.parameters * log(self.rows) - 2 * max(self.likelihoods)

    @property
    def aic(self) -> float:
        return 2 * self.parameters - 2 * max(self.likelihoods)

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with behavior_cluster and cluster_probs, an array that sums to one."""
        filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features})
        names = [f"_c{i}" for i in range(self.projection.loadings.shape[1])]
        scored = filled.withColumns(dict(zip(names, self.projection.scores(), strict=True)))
        parts = [f"_p{i}" for i in range(len(self.order))]
        forms = self.mixture.forms()
        densities = []
        for i in self.order:
            root, top = forms[i]
            apart = [linear(names, row, 0.0, self.mixture.means[i]) for row in root]
            density = F.exp(F.lit(float(top)) - sum((a * a for a in apart), F.lit(0.0)) / 2)
            densities.append(F.lit(EPSILON) + F.lit(float(self.mixture.weights[i])) * density)
        scored = scored.withColumns(dict(zip(parts, densities, strict=True)))
        scored = scored.withColumn("_whole", sum((F.col(p) for p in parts), F.lit(0.0)))
        scored = scored.withColumn("cluster_probs", F.array(*[F.col(p) / F.col("_whole") for p in parts]))
        likely = F.array_position("cluster_probs", F.array_max("cluster_probs")) - 1
        scored = scored.withColumn("behavior_cluster", likely.cast("int"))
        # Settled: a filter on the segment would else repeat all densities for each use.
        return settled(scored.drop(*[f"_f_{c}" for c in self.features], *names, *parts, "_whole"))


def _vectors(df: DataFrame, projection: Projection) -> DataFrame:
    names = [f"_c{i}" for i in range(projection.loadings.shape[1])]
    scored = df.withColumns(dict(zip(names, projection.scores(), strict=True)))
    return VectorAssembler(inputCols=names, outputCol="features").transform(scored).drop(*names)


def fit_segments(df: DataFrame, regions: Sequence[str] = schema.REGIONS, extras: Sequence[str] = EXTRAS, k: int | None = None,
                 restarts: int = RESTARTS, seed: int = 42, steps: int = 60) -> Segments | None:
    """The mixture of highest likelihood over ``restarts`` seeds; None for tiny tables.

    Features are standardised and projected on three components in one aggregate, missing values
    counting as 0. The seeds start from points that are drawn from a checkpoint of the scores. A
    step of all seeds that have not ended is one pass over blocks of the scores.
    """
    features = [c for c in (*regions, *extras) if c in df.columns]
    filled = cut_lineage(df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{c}") for c in features]))
    rows = filled.count()
    if len(features) < 3 or rows < FEWEST_ROWS:
        return None
    projection = fit_projection(filled, [f"_f_{c}" for c in features], min(3, len(features)))
    points = cut_lineage(_vectors(filled, projection).select("features"))
    k = k or min(5, max(2, rows // 250))
    starts = [drawn(points, k, s) for s in range(seed, seed + restarts)]
    scores = filled.select(*[s.alias(f"_c{i}") for i, s in enumerate(projection.scores())])
    blocks = written_once(scores.mapInArrow(_packed, "points binary"))
    ended = climb(blocks, starts, steps, 0.001 * rows)
    likelihoods = [likelihood for _, likelihood in ended]
    best = ended[max(range(restarts), key=lambda i: (likelihoods[i], -i))][0]
    order = sorted(range(k), key=lambda i: (-best.weights[i], i))
    return Segments(features, projection, best, order, likelihoods, rows)


def drawn(points: DataFrame, k: int, seed: int) -> Mixture:
    """The start of a seed: each component from a few points drawn anew."""
    start = GaussianMixture(k=k, seed=seed, maxIter=0).fit(points)
    found = start.gaussiansDF.collect()
    return Mixture(np.array(start.weights), np.array([g["mean"].toArray() for g in found]), np.array([g["cov"].toArray() for g in found]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of points: their first coordinates, then their second ones and so on."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            block = np.stack([c.slice(at, BLOCK_ROWS).to_numpy(zero_copy_only=False) for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([block.astype("<f8").tobytes()], pa.binary())], ["points"])


def climb(blocks: DataFrame, starts: Sequence[Mixture], steps: int, tolerance: float) -> list[tuple[Mixture, float]]:
    """Expectation maximisation from each start: the mixture after its last step, and the likelihood before that.

    A start ends after ``steps``, or when its likelihood changes by no more than ``tolerance``.
    """
    mixtures, likelihoods, before = list(starts), [-np.finfo(float).max] * len(starts), [0.0] * len(starts)
    for _ in range(steps):
        going = [i for i in range(len(mixtures)) if abs(likelihoods[i] - before[i]) > tolerance]
        if not going:
            break
        now = [mixtures[i] for i in going]

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            wide = now[0].means.shape[1]
            found: list[list[np.ndarray]] = []
            for batch in batches:
                for cell in batch.column(0):
                    x = np.frombuffer(cell.as_py(), "<f8").reshape(wide, -1)
                    found.append([m.sums(x) for m in now])
            if found:
                sums = np.array([[fsum(column) for column in zip(*one, strict=True)] for one in zip(*found, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        parts = [np.frombuffer(r["sums"]).reshape(len(going), -1) for r in blocks.mapInArrow(run, "sums binary").collect()]
        for n, i in enumerate(going):
            sums = np.array([fsum(column) for column in zip(*[p[n] for p in parts], strict=True)])
            mixtures[i], before[i], likelihoods[i] = mixtures[i].stepped(sums), likelihoods[i], float(sums[0])
    return list(zip(mixtures, likelihoods, strict=True))


def segment_profiles(df: DataFrame, regions: Sequence[str] = schema.REGIONS, label: str = "behavior_cluster",
                     names: Mapping[str, str] = schema.REGION_LABELS) -> DataFrame:
    """Per segment: size, mean sales and age, median score, purity, top genres and families, region profile.

    Purity is the mean probability of a row's own segment.
    """
    own = F.avg(F.get("cluster_probs", F.col(label)))
    extra = {"avg_age": F.coalesce(F.avg("Age_Years"), F.lit(0.0)), "purity": own}
    extra |= {f"{r}_sum": exact_sum(F.col(r)) for r in regions}
    out = cluster_summary(df, label, {"top_genres": ("Genre", 3), "top_platforms": ("Platform_Family", 2)}, extra=extra)
    whole = sum((F.col(f"{r}_sum") for r in regions), F.lit(0.0))
    shares = {names.get(r, r): F.round(F.try_divide(F.col(f"{r}_sum"), whole), 4) for r in regions}
    medians = exact_median(df, "Composite_Score", [label], "score_median")
    return (
        out.withColumns(shares).drop(*[f"{r}_sum" for r in regions])
        .join(medians, label, "left").withColumn("score_median", F.coalesce("score_median", F.lit(0.0)))
    )


def tagged_segments(regional: DataFrame, behavior: DataFrame) -> DataFrame:
    """Both kinds of segments in one table; columns that one kind lacks are missing there."""
    regional = regional.withColumnRenamed("Regional_Cluster", "cluster").withColumn("segment_type", F.lit("regional"))
    behavior = behavior.withColumnRenamed("behavior_cluster", "cluster").withColumn("segment_type", F.lit("behavior"))
    return regional.unionByName(behavior, allowMissingColumns=True)
