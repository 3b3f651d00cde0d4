"""Whitening of embeddings: exact integer moments, spectrum slicing, projected rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import private_names, read, written
from salesprism.llm.spectrum import leading

COMPONENTS = 16
SCALE = 64
OFFSET = 1_000_000
EXACT_DOUBLE = 1 << 53
BLOCK_ROWS = 8192


def vectors_of(column: pa.ListArray, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(table: DataFrame, column: str, d: int, slots: Callable[[np.ndarray], list], kind: str) -> dict[int, object]:
    """Sums over all vectors of what ``slots`` makes of a block: a few numbers from each task.

    Whole numbers stay exact in any order (``kind`` decimal(38,0)), so the result does not
    depend on the partitioning.
    """
    whole = kind != "double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            x = vectors_of(batch.column(0), d)
            for at in range(0, len(x), BLOCK_ROWS):
                part = slots(x[at : at + BLOCK_ROWS])
                sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if sums is not None:
            values = pa.array([Decimal(int(v)) for v in sums], pa.decimal128(38, 0)) if whole else pa.array(sums, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), values], ["slot", "value"])

    parts = table.select(column).mapInArrow(partial, f"slot int, value {kind}")
    number = int if whole else float
    return {r.slot: number(r.value) for r in parts.groupBy("slot").agg(F.sum("value").alias("value")).collect()}


def _products(y: np.ndarray) -> list[int]:
    """The upper triangle of yᵀy as whole numbers; doubles are used only where they are exact."""
    upper = np.triu_indices(y.shape[1])
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT_DOUBLE:
        f = y.astype(np.float64)
        return (f.T @ f)[upper].astype(np.int64).tolist()
    exact = y.astype(object)
    return (exact.T @ exact)[upper].tolist()


class Moments:
    """Count, sums and covariance of the distinct vectors, all from exact whole numbers."""

    def __init__(self, fit: DataFrame, column: str, d: int):
        def sums(x: np.ndarray) -> list[int]:
            safe = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            return [len(x), *(x if safe else x.astype(object)).sum(axis=0).tolist()]

        total = _totals(fit, column, d, sums, "decimal(38,0)")
        self.n = total.get(0, 0)
        self.sums = [total.get(j + 1, 0) for j in range(d)]
        # The whole number next to the mean: what is left of the mean in y = x - near is below one.
        self.near = np.array([(2 * s + self.n) // (2 * self.n) if self.n else 0 for s in self.sums], np.int64)
        self.left = [s - self.n * int(m) for s, m in zip(self.sums, self.near, strict=True)]

    def covariance(self, fit: DataFrame, column: str) -> np.ndarray:
        """Centred products over n, rounded to double once."""
        n, left, near, d = self.n, self.left, self.near, len(self.near)
        products = _totals(fit, column, d, lambda x: _products(x - near), "decimal(38,0)")
        v = np.zeros((d, d))
        for slot, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
            v[i, j] = v[j, i] = (n * products[slot] - left[i] * left[j]) / (n * n)
        return v


def whitened(
    table: DataFrame,
    vec_col: str = "embedding",
    keep: Sequence[str] = ("vec_id",),
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """For each usable row and component: ``keep``, component, n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry) + offset. Count n, sums S and covariance are those of the
    distinct x vectors. ``deviation`` is the sum over dimensions of (n * x - S)², exact;
    ``whitened`` the row's projection on the component over the root of its eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``identity_error`` how far the covariance
    of the whitened fit vectors, taken in a pass over them, is from the identity.

    Rows whose vector is null, holds null or non-finite entries or entries beyond 2^52 / scale
    are left out, and so are rows with another length than most (of equally frequent lengths
    the largest). Null or repeated ids keep a result per row. Only components with an eigenvalue
    above rounding exist: one distinct vector, or equal entries everywhere, or an empty table,
    give no row. ``keep`` may hold any columns but the new ones' names.

    Only the distinct vectors are shuffled, combined before, so copies of one vector are one row
    per task. Sums go to the driver as d * (d + 1) / 2 whole numbers, d the dimension.
    """
    _ = private_names(table)
    vec, x_col = F.col(f"`{vec_col}`"), _("x")
    most = float((1 << 52) // scale)
    usable = F.forall(vec, lambda c: F.coalesce(F.abs(c.cast("double")) < most, F.lit(False)))
    x = F.transform(vec, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))
    rows = table.filter(usable).select(*[F.col(f"`{c}`") for c in keep], x.alias(x_col))
    lengths = rows.groupBy(F.size(x_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths.d if lengths else 0
    rows = rows.filter(F.size(x_col) == d)
    fit = written(rows.select(x_col).distinct(), "fit")
    moments = Moments(fit, x_col, d)
    n = moments.n
    v = moments.covariance(fit, x_col) if n and d else np.zeros((d, d))
    values, q = leading(v, components) if d else (np.zeros(0), np.zeros((0, 0)))
    k, near, left = len(values), moments.near, moments.left
    weights = q / np.sqrt(values)
    rest = np.array([s / n for s in left]) if n else np.zeros(d)
    explained = values / np.trace(v) if k else values

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - near) - rest) @ weights

    def second(x: np.ndarray) -> list[float]:
        z = project(x)
        return [*(z.T @ z)[np.triu_indices(k)].tolist(), *z.sum(axis=0).tolist()]

    error = _identity_error(_totals(fit, x_col, d, second, "double"), n, k) if k else 0.0
    far = max((abs(s) for s in left), default=0)

    def deviations(x: np.ndarray) -> pa.Array:
        y = x - near
        reach = n * int(np.abs(y).max(initial=0)) + far
        if d * reach * reach < 1 << 63:
            total = ((n * y - np.array(left, np.int64)) ** 2).sum(axis=1)
        else:
            total = ((n * y.astype(object) - np.array(left, object)) ** 2).sum(axis=1)
        return pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = vectors_of(part.column(part.num_columns - 1), d)
                row = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column(c).take(row) for c in range(part.num_columns - 1)]
                columns += [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), n, np.int64)),
                    deviations(x).take(row),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(row), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    added = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    names = [*keep, *(c.split()[0] for c in added.split(", "))]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in keep]).schema)
    return rows.mapInArrow(score, f"{kept}, {added}" if kept else added)


def _identity_error(total: dict[int, object], n: int, k: int) -> float:
    upper = np.triu_indices(k)
    slots = np.array([total[s] for s in range(len(total))]) / n
    mean = slots[len(upper[0]) :]
    return float(np.abs(slots[: len(upper[0])] - np.outer(mean, mean)[upper] - np.eye(k)[upper]).max())


def op13_whitening(spark, sf_dir):
    out = whitened(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
