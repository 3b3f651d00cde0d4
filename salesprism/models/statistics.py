"""Statistics the models are fitted from, for many columns in one or two aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000
MOST_VALUES = 100_000
SUM_TYPE = "decimal(38,12)"
# Terms up to LARGEST are summed as ten-thousandths and the 1e8th parts of these, both bigints:
# 2^31 rows fit. Larger terms are summed as decimals.
UPPER, LOWER = 10_000, 100_000_000
LARGEST = float(1 << 18)


def quantiles(df: DataFrame, wanted: Mapping[str, float], most: int = MOST_VALUES) -> dict[str, float | None]:
    """Exact quantiles of several columns, linear between neighbouring ranks; None without values.

    Approximate quantiles bracket each rank; then the values inside the brackets are counted, with
    one count of what lies below, and no more than ``most`` distinct values come to the driver.
    Brackets that hold more are narrowed again. NaN counts as missing.
    """
    values = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    sizes = df.agg(*[F.count(v).alias(c) for c, v in values.items()]).first().asDict()
    low = {c: -math.inf for c in wanted}
    high = {c: math.inf for c in wanted}
    below = dict.fromkeys(wanted, 0)
    inside = dict(sizes)
    rank = {c: p * (sizes[c] - 1) for c, p in wanted.items()}
    open_ = {c for c in wanted if sizes[c]}
    out: dict[str, float | None] = dict.fromkeys(wanted)
    slack = 4 / ACCURACY
    while open_:
        narrow = [c for c in open_ if inside[c] * len(open_) > most]
        if narrow:
            picks = []
            for c in narrow:
                p = (rank[c] - below[c]) / inside[c]
                part = F.when(values[c].between(low[c], high[c]), values[c])
                ends = [F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))]
                picks.append(F.percentile_approx(part, F.array(*ends), ACCURACY).alias(c))
            found = df.agg(*picks).first()
            for c in narrow:
                low[c], high[c] = found[c]
        cells = [
            F.struct(F.lit(c).alias("column"), F.when(values[c] >= low[c], values[c]).alias("value"), (values[c] <= high[c]).alias("in"))
            for c in sorted(open_)
        ]
        counted = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").filter("`in`").groupBy("column", "value").count()
        rows = counted.limit(most + len(open_) + 1).collect()
        if len(rows) > most + len(open_):
            for c in narrow:
                below[c], inside[c] = df.agg(F.count_if(values[c] < low[c]), F.count_if(values[c].between(low[c], high[c]))).first()
            most = most if any(inside[c] < sizes[c] for c in narrow) else most * 2
            continue
        for c in list(open_):
            own = sorted((r.value, r["count"]) for r in rows if r.column == c and r.value is not None)
            start = sum(r["count"] for r in rows if r.column == c and r.value is None)
            upto = start + np.cumsum([n for _, n in own])
            at = [int(np.searchsorted(upto, k, side="right")) for k in (math.floor(rank[c]), math.ceil(rank[c]))]
            a, b = (own[i][0] for i in at)
            out[c] = a + (b - a) * (rank[c] - math.floor(rank[c]))
            open_.discard(c)
    return out


@dataclass
class Moments:
    """Count, sums and sums of products of columns, less a centre that keeps them small."""

    n: int
    sums: np.ndarray
    products: np.ndarray
    centre: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.sums / max(self.n, 1)

    @property
    def covariance(self) -> np.ndarray:
        """Divisor n."""
        mean = self.sums / max(self.n, 1)
        return self.products / max(self.n, 1) - np.outer(mean, mean)

    @property
    def spread(self) -> np.ndarray:
        """Population deviation; 1 for a constant column."""
        deviation = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        return np.where(deviation > 1e-9, deviation, 1.0)


def moments(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), centre: Mapping[str, float] | None = None
) -> dict[tuple, Moments]:
    """``Moments`` per value of ``by`` from one aggregate; a missing value adds nothing.

    Terms are summed to twelve decimals as whole numbers, so the sums do not depend on their order.
    """
    centre = centre or {}
    middle = np.array([float(centre.get(c) or 0.0) for c in columns])
    x = [F.coalesce(F.col(c).cast("double") - F.lit(float(m)), F.lit(0.0)) for c, m in zip(columns, middle, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    terms = {f"s{i}": v for i, v in enumerate(x)} | {f"p{i}_{j}": x[i] * x[j] for i, j in pairs}
    out = {}
    for row in _summed(df, by, terms):
        p = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            p[i, j] = p[j, i] = row[f"p{i}_{j}"]
        s = np.array([row[f"s{i}"] for i in range(len(columns))])
        out[tuple(row[b] for b in by)] = Moments(row["rows"], s, p, middle)
    return out


def _summed(df: DataFrame, by: Sequence[str], terms: Mapping[str, Column]) -> list[dict]:
    """The keys, rows and sums of ``terms`` per value of ``by``; in decimals if any term is large or no number."""
    parts, large = [], F.lit(False)
    for name, v in terms.items():
        fits = F.abs(v) <= LARGEST
        scaled = F.when(fits, v) * UPPER
        upper = F.rint(scaled)
        parts += [
            F.sum(upper.cast("bigint")).alias(f"{name}_upper"),
            F.sum(F.rint((scaled - upper) * LOWER).cast("bigint")).alias(f"{name}_lower"),
        ]
        large = large | ~fits
    rows = [r.asDict() for r in df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(large).alias("large"), *parts).collect()]
    if any(row["large"] for row in rows):
        sums = [F.sum(v.cast(SUM_TYPE)).cast("double").alias(name) for name, v in terms.items()]
        rows = [r.asDict() for r in df.groupBy(*by).agg(F.count("*").alias("rows"), *sums).collect()]
        return [{**row, **{name: row[name] or 0.0 for name in terms}} for row in rows]
    whole = {name: (f"{name}_upper", f"{name}_lower") for name in terms}
    return [{**row, **{name: ((row[u] or 0) * LOWER + (row[d] or 0)) / (UPPER * LOWER) for name, (u, d) in whole.items()}} for row in rows]


def linear(columns: Sequence[str], weights: Sequence[float], start: float = 0.0, centre: Sequence[float] | None = None):
    """The column ``start`` + sum of weight * (column - centre)."""
    middle = centre if centre is not None else [0.0] * len(columns)
    total = F.lit(float(start))
    for c, w, m in zip(columns, weights, middle, strict=True):
        if w:
            total = total + F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(m)))
    return total
