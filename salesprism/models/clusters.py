"""Region clusters: principal components of the region mix, K-Means, labels from the centres."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.models.statistics import Moments, linear, moments
from salesprism.operators.market import cluster_summary
from salesprism.operators.preparation import region_vectors
from salesprism.session import cut_lineage

RESTARTS = 5
SUFFIX = "_Part"


@dataclass
class Projection:
    """Principal components of standardised columns."""

    columns: list[str]
    mean: np.ndarray
    spread: np.ndarray
    loadings: np.ndarray
    variance_ratio: np.ndarray

    def scores(self) -> list[Column]:
        return [linear(self.columns, w / self.spread, 0.0, self.mean) for w in self.loadings.T]

    def restore(self, points: np.ndarray) -> np.ndarray:
        """Points of the component space as values of the columns."""
        return points @ self.loadings.T * self.spread + self.mean


def fit_projection(df: DataFrame, columns: Sequence[str], k: int) -> Projection:
    """The first ``k`` components, from one aggregate; each loads its largest weight positively."""
    columns = list(columns)
    whole = moments(df, columns).get((), Moments(0, np.zeros(len(columns)), np.zeros((len(columns),) * 2), np.zeros(len(columns))))
    scaled = whole.covariance / np.outer(whole.spread, whole.spread)
    values, vectors = np.linalg.eigh(scaled)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(columns))])
    total = values.sum() or 1.0
    return Projection(columns, whole.mean, whole.spread, (vectors * signs)[:, :k], (values / total)[:k])


def nearest(features: Sequence[str], centres: np.ndarray) -> Column:
    """Number of the nearest centre; the first of equally near ones."""
    def distance(centre):
        return sum(((F.col(f) - float(v)) * (F.col(f) - float(v)) for f, v in zip(features, centre, strict=True)), F.lit(0.0))

    apart = F.array(*[distance(c) for c in centres])
    return (F.array_position(apart, F.array_min(apart)) - 1).cast("int")


def fit_centres(points: DataFrame, features: Sequence[str], k: int, restarts: int = RESTARTS, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Centres of least cost over ``restarts`` seeds, largest cluster first, and the costs so far.

    ``points`` is read once per step of every restart: hand in a narrow checkpoint.
    """
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(points).select("features")
    best, costs = None, []
    for s in range(seed, seed + restarts):
        model = KMeans(k=k, seed=s, maxIter=40, tol=1e-6).fit(vectors)
        if best is None or model.summary.trainingCost < costs[-1]:
            sizes = model.summary.clusterSizes
            centres = [tuple(c) for c in model.clusterCenters()]
            order = sorted(range(len(centres)), key=lambda i: (-sizes[i], centres[i]))
            best = np.array([centres[i] for i in order])
        costs.append(min([model.summary.trainingCost, *costs[-1:]]))
    return best, costs


def clusters_for(rows: int, distinct: int) -> int:
    """Number of clusters of a table; 0 where it is too small to have any."""
    k = min(4 if rows >= 400 else 3 if rows >= 150 else 2, distinct)
    return k if rows >= 20 and k >= 2 else 0


@dataclass
class RegionClusters:
    """A fitted clustering; ``assign`` is a projection of any table with the region columns."""

    regions: list[str]
    projection: Projection
    centres: np.ndarray
    costs: list[float]

    @property
    def profiles(self) -> np.ndarray:
        """The centres as region shares."""
        return self.projection.restore(self.centres)

    def labels(self, names: Mapping[str, str] = schema.REGION_LABELS) -> list[str]:
        leading = [self.regions[int(i)] for i in self.profiles.argmax(axis=1)]
        return [names.get(r, r) + schema.CLUSTER_LABEL_SUFFIX for r in leading]

    def assign(self, df: DataFrame) -> DataFrame:
        parts = [r + SUFFIX for r in self.regions]
        names = [f"PCA_Region_{i + 1}" for i in range(self.centres.shape[1])]
        out = region_vectors(df, self.regions, SUFFIX).withColumns(dict(zip(names, self.projection.scores(), strict=True)))
        out = out.withColumn("Regional_Cluster", nearest(names, self.centres))
        label = F.element_at(F.array(*[F.lit(x) for x in self.labels()]), F.col("Regional_Cluster") + 1)
        return out.withColumn("Regional_Cluster_Label", label).drop(*parts)


def fit_region_clusters(df: DataFrame, regions: Sequence[str] = schema.REGIONS, k: int | None = None,
                        components: int = 2, restarts: int = RESTARTS, seed: int = 42) -> RegionClusters | None:
    """Clusters of the rows' region mix; None for tables too small to have any.

    The mix is standardised and projected on two components in one aggregate; the component
    scores are checkpointed for the restarts. Clusters are numbered by falling size.
    """
    regions = [r for r in regions if r in df.columns]
    names = [r + SUFFIX for r in regions]
    parts = cut_lineage(region_vectors(df.select(*regions), regions, SUFFIX).select(*names))
    if k is None:
        k = clusters_for(parts.count(), parts.select(*names).distinct().limit(4).count())
    if not k or not regions:
        return None
    projection = fit_projection(parts, names, min(components, len(regions)))
    scores = [f"c{i}" for i in range(projection.loadings.shape[1])]
    points = cut_lineage(parts.select(*[s.alias(n) for s, n in zip(projection.scores(), scores, strict=True)]))
    centres, costs = fit_centres(points, scores, k, restarts, seed)
    return RegionClusters(regions, projection, centres, costs)


def cluster_regions(df: DataFrame, **options) -> DataFrame:
    """``df`` with PCA_Region_1, PCA_Region_2, Regional_Cluster and its label; missing in tiny tables."""
    fitted = fit_region_clusters(df, **options)
    if fitted is None:
        return df.withColumns({
            "PCA_Region_1": F.lit(None).cast("double"), "PCA_Region_2": F.lit(None).cast("double"),
            "Regional_Cluster": F.lit(None).cast("int"), "Regional_Cluster_Label": F.lit(None).cast("string"),
        })
    return fitted.assign(df)


def region_segments(df: DataFrame, label: str = "Regional_Cluster", regions: Sequence[str] = schema.REGIONS,
                    names: Mapping[str, str] = schema.REGION_LABELS) -> DataFrame:
    """Per cluster: size, mean sales, the two top genres and families, mean region shares, dominant region."""
    shared = region_vectors(df, regions, SUFFIX)
    means = {f"{r}_mean": F.avg(r + SUFFIX) for r in regions}
    tops = {"top_genres": ("Genre", 2), "top_platforms": ("Platform_Family", 2)}
    out = cluster_summary(shared, label, tops, extra=means)
    return out.withColumn("dominant_region", dominant([F.col(m) for m in means], regions, names))


def dominant(values: Sequence[Column], regions: Sequence[str], names: Mapping[str, str]) -> Column:
    """The name of the region of the largest value; the first of equal ones, none if all are missing."""
    shares = F.array(*[F.coalesce(v, F.lit(-1.0)) for v in values])
    at = F.array_position(shares, F.array_max(shares)).cast("int")
    return F.when(F.array_max(shares) >= 0, F.element_at(F.array(*[F.lit(names.get(r, r)) for r in regions]), at))
