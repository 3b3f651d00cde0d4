"""Chained imputation: each column with gaps is predicted from all others, round after round."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.models.statistics import Moments, moments, quantiles
from salesprism.session import cut_lineage

ROUNDS = 10
DIGITS = 2
PRIOR = 1e-6
FEWEST_ROWS = 5


def ridge(n: float, mean: np.ndarray, covariance: np.ndarray, steps: int = 300, tolerance: float = 1e-3) -> tuple[float, np.ndarray]:
    """Start and weights of the last variable on the others, from their mean and covariance.

    Bayesian ridge: the strengths of noise and weights are set by evidence iteration.
    """
    xx, xy, yy = covariance[:-1, :-1] * n, covariance[:-1, -1] * n, covariance[-1, -1] * n
    values = np.maximum(np.linalg.eigvalsh(xx), 0) if len(xx) else np.zeros(0)
    noise, strength = 1 / (covariance[-1, -1] + np.finfo(float).eps), 1.0
    weights = None
    for _ in range(steps):
        last, weights = weights, np.linalg.solve(xx + strength / noise * np.eye(len(xx)), xy)
        error = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        used = (noise * values / (strength + noise * values)).sum()
        strength = (used + 2 * PRIOR) / (weights @ weights + 2 * PRIOR)
        noise = (n - used + 2 * PRIOR) / (error + 2 * PRIOR)
        if last is not None and np.abs(last - weights).sum() < tolerance:
            break
    weights = np.linalg.solve(xx + strength / noise * np.eye(len(xx)), xy)
    return float(mean[-1] - mean[:-1] @ weights), weights


def chain(patterns: dict[tuple, Moments], rounds: int = ROUNDS) -> dict[tuple, np.ndarray]:
    """Per pattern of present columns the rows of affine maps from present to filled values.

    A filled value is an affine function of the row's present values: the median at first, then a
    prediction from values that are themselves affine. So the rounds need no rows, only each
    pattern's moments. Columns are filled in the order of their gaps, fewest first.
    """
    width = len(next(iter(patterns)))
    total = sum(m.n for m in patterns.values())
    gaps = [sum(m.n for p, m in patterns.items() if not p[j]) for j in range(width)]
    maps, raw = {}, {}
    for p, m in patterns.items():
        maps[p] = np.diag([1.0, *map(float, p)])
        raw[p] = np.block([[np.array([[m.n]]), m.sums[None, :]], [m.sums[:, None], m.products]])
    for _ in range(rounds):
        for t in sorted((j for j in range(width) if 0 < gaps[j] < total), key=lambda j: (gaps[j], j)):
            full = sum(maps[p] @ raw[p] @ maps[p].T for p in patterns if p[t])
            others = [j for j in range(width) if j != t]
            order = np.array([*others, t]) + 1
            n = full[0, 0]
            mean = full[0, order] / n
            start, weights = ridge(n, mean, full[np.ix_(order, order)] / n - np.outer(mean, mean))
            for p in patterns:
                if not p[t]:
                    maps[p][t + 1] = weights @ maps[p][[j + 1 for j in others]]
                    maps[p][t + 1, 0] += start
    return maps


def impute_scores(
    df: DataFrame,
    targets: Sequence[str] = schema.SCORES,
    helpers: Sequence[str] = ("Global_Sales", "Year"),
    rounds: int = ROUNDS,
    digits: int = DIGITS,
    low: float = 0.0,
) -> DataFrame:
    """``df`` with the gaps of ``targets`` filled; all their values are then clipped and rounded.

    The columns are read and written once, then passed two or three times whatever the number of
    rounds: medians, then the moments of each pattern of present columns, at most 2^columns rows. Filling is a projection. A column without
    any value stays missing. Without gaps, or with fewer than five rows, nothing changes.
    """
    targets = [c for c in targets if c in df.columns]
    columns = [*targets, *[c for c in helpers if c in df.columns]]
    read = cut_lineage(df.select(*columns))
    medians = quantiles(read, dict.fromkeys(columns, 0.5))
    columns = [c for c in columns if medians[c] is not None]
    targets = [c for c in targets if c in columns]
    if not targets or len(columns) == len(targets):
        return df
    has = {f"_has_{i}": F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for i, c in enumerate(columns)}
    centre = {c: medians[c] for c in columns}
    clean = read.select(*[F.when(h, F.col(c).cast("double")).alias(c) for c, h in zip(columns, has.values(), strict=True)], *[h.alias(n) for n, h in has.items()])
    patterns = moments(clean, columns, list(has), centre)
    if sum(m.n for m in patterns.values()) < FEWEST_ROWS or all(all(p[: len(targets)]) for p in patterns):
        return df
    maps = chain(patterns, rounds)
    middle = [centre[c] for c in columns]
    # Per pattern, for each target its start and weights, or none where the target is present.
    entries = [F.lit(0), F.lit(None).cast("array<array<double>>")]
    for p, m in maps.items():
        if not all(p[: len(targets)]):
            numbers = [[m[t + 1, 0] + middle[t], *(m[t + 1, 1:] * np.array(p))] for t in range(len(targets))]
            rows = [F.lit(None).cast("array<double>") if p[t] else F.array(*[F.lit(float(w)) for w in row]) for t, row in enumerate(numbers)]
            entries += [F.lit(1 + sum(1 << i for i, present in enumerate(p) if present)), F.array(*rows)]
    pattern = sum((F.when(h, 1 << i).otherwise(0) for i, h in enumerate(has.values())), F.lit(1))

    def predicted(weights):
        parts = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, middle, strict=True)]
        return sum((F.when(h, weights[i] * x).otherwise(0.0) for i, (h, x) in enumerate(zip(has.values(), parts, strict=True), 1)), weights[0])

    name = "_predicted"
    while name in df.columns:
        name += "_"
    filled = {}
    for t, target in enumerate(targets):
        value = F.coalesce(F.col(name)[t], F.col(target).cast("double"))
        filled[target] = F.round(F.greatest(value, F.lit(low)), digits)
    # One expression for all patterns and targets: written out for each, the method is too long to be compiled.
    predictions = F.transform(F.element_at(F.create_map(*entries), pattern), predicted)
    return df.withColumn(name, predictions).withColumns(filled).drop(name)
