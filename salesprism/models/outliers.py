"""Isolation forest: bounded samples, trees grown in parallel, all rows scored."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.models.statistics import quantiles
from salesprism.session import cut_lineage

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
PRESENT_SHARE = 0.3
EULER = 0.5772156649015329
EXTRA = 1.5
NODE = "tree int, node int, feature int, split double, left int, length double"
UNIT = 1 << 30


def mean_path(m: np.ndarray | float) -> np.ndarray:
    """Mean depth at which a search among ``m`` rows ends: what an unsplit leaf adds."""
    m = np.asarray(m, float)
    more = np.maximum(m, 3)
    return np.where(m > 2, 2 * (np.log(more - 1) + EULER) - 2 * (more - 1) / more, np.where(m == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, float]]:
    """Nodes (feature, split, left child, path length); children stand together, a leaf has feature -1."""
    deepest = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple[int, float, int, float]] = [(-1, 0.0, -1, 0.0)]
    waiting = [(0, np.arange(len(x)), 0)]
    while waiting:
        at, rows, depth = waiting.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (0.0, 0.0)
        varied = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(varied):
            nodes[at] = (-1, 0.0, -1, depth + float(mean_path(len(rows))))
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        right = x[rows, feature] > split
        nodes[at] = (feature, split, len(nodes), 0.0)
        for part in (rows[~right], rows[right]):
            waiting.append((len(nodes), part, depth + 1))
            nodes.append((-1, 0.0, -1, 0.0))
    return nodes


class Forest:
    """All trees as arrays, at most ``TREES * (2 * SAMPLE - 1)`` nodes."""

    def __init__(self, nodes: pd.DataFrame, sample: int):
        nodes = nodes.sort_values(["tree", "node"])
        sizes = nodes.groupby("tree").size().to_numpy()
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        self.feature = nodes["feature"].to_numpy()
        self.split = nodes["split"].to_numpy()
        self.length = nodes["length"].to_numpy()
        # A leaf is its own child, so rows that arrived stay where they are.
        child = nodes["left"].to_numpy() + np.repeat(self.roots, sizes)
        leaf = self.feature < 0
        self.left = np.where(leaf, np.arange(len(nodes)), child)
        self.step = (~leaf).astype(np.int64)
        self.feature = np.maximum(self.feature, 0)
        self.depth = int(np.ceil(np.log2(max(sample, 2))))
        self.typical = float(mean_path(sample)) or 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Minus the anomaly score of each row, in (-1, 0): low for what is soon isolated."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.split[at]
                at = self.left[at] + self.step[at] * right
            total += self.length[at]
        return -np.exp2(-total / len(self.roots) / self.typical)


def detection_columns(
    df: DataFrame, scores: Sequence[str] = ("Critic_Score", "User_Score"), regions: Sequence[str] = schema.REGIONS
) -> list[str]:
    """Sales, year, the scores that more than 30 % of the rows have, and the first two regions."""
    scores = [c for c in scores if c in df.columns]
    counts = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in scores]).first()
    full = [c for c in scores if counts[c] > counts["rows"] * PRESENT_SHARE]
    return ["Global_Sales", "Year", *full, *[c for c in regions if c in df.columns][:2]]


def fit_forest(df: DataFrame, id_col: str, columns: Sequence[str], fills: Mapping[str, float], rows: int,
               trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    """Each tree from the ``sample`` rows of smallest draw among those drawn for it.

    A draw is a hash of seed, tree and id, so a tree's rows do not depend on the partitioning. About
    ``EXTRA * sample`` rows per tree leave the scan. Where a tree's share of all rows is
    small, one draw first decides whether a row is in any tree at all.
    """
    share = min(1.0, EXTRA * sample / max(rows, 1))
    pool = min(1.0, 2 * trees * share)
    x = [F.coalesce(F.col(c).cast("double"), F.lit(float(fills[c]))) for c in columns]
    name = F.col(id_col)
    drawn = df.filter(F.pmod(F.xxhash64(F.lit(seed), name), F.lit(UNIT)) < int(pool * UNIT))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.pmod(F.xxhash64(F.lit(seed + 1), t, name), F.lit(UNIT)).alias("draw")),
    )
    chosen = F.filter(draws, lambda d: d["draw"] < int(share / pool * UNIT) + 1)
    rows_of = drawn.select(F.array(*x).alias("x"), name.cast("string").alias("name"), F.explode(chosen).alias("d"))

    def tree(key, part):
        part = part.sort_values(["draw", "name"]).head(sample)
        nodes = grow(np.array(part["x"].tolist()), np.random.default_rng([seed, int(key[0])]))
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "length"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", int(key[0]))
        return out

    nodes = rows_of.select("x", "name", "d.*").groupBy("tree").applyInPandas(tree, NODE).toPandas()
    return Forest(nodes, min(sample, rows))


def flag_outliers(df: DataFrame, id_col: str = schema.INGEST_ID, columns: Sequence[str] | None = None,
                  contamination: float = CONTAMINATION, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``df`` with Is_Outlier and Outlier_Score, negative for outliers.

    The score of a row is minus its anomaly score less the exact ``contamination`` quantile of all
    rows' scores. Outliers are rows strictly below that quantile, so rows tied with it are
    not flagged and the share is ``contamination`` at most. Missing features are filled with the
    median. An empty table stays empty; rows without any variation all score zero.

    Splits are uniform between a node's extremes, so scaling a feature changes nothing and none is
    scaled. The scored rows are checkpointed once: quantile and flags see the same scores.
    """
    columns = list(columns) if columns is not None else detection_columns(df)
    read = cut_lineage(df.select(id_col, *columns))
    medians = quantiles(read, dict.fromkeys(columns, 0.5))
    columns = [c for c in columns if medians[c] is not None]
    rows = read.count()
    if not rows or not columns:
        return df.withColumns({"Is_Outlier": F.lit(False), "Outlier_Score": F.lit(0.0)})
    forest = df.sparkSession.sparkContext.broadcast(fit_forest(read, id_col, columns, medians, rows, trees, sample, seed))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(forest.value.scores(np.array(x.tolist(), float).reshape(len(x), -1)))

    x = [F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c]))) for c in columns]
    scored = cut_lineage(df.withColumn("Outlier_Score", score(F.array(*x))))
    offset = quantiles(scored, {"Outlier_Score": contamination})["Outlier_Score"]
    shifted = F.col("Outlier_Score") - F.lit(offset)
    return scored.withColumns({"Is_Outlier": shifted < 0, "Outlier_Score": shifted})
