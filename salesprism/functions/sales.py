"""Sales arithmetic: exact sums, safe ratios, bins, shares and row-wise maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


LIMB = 1e6


def limbs(col: Column) -> list[Column]:
    """A double as whole units, millionths and millionths of these: bigints that add up in any order."""
    units = F.floor(col)
    millionths = (col - units) * LIMB
    upper = F.floor(millionths)
    return [units.cast("bigint"), upper.cast("bigint"), F.rint((millionths - upper) * LIMB).cast("bigint")]


def of_limbs(parts: Sequence[Column]) -> Column:
    units, upper, lower = parts
    return units + (upper + lower / F.lit(LIMB)) / F.lit(LIMB)


def exact_sum(col: Column) -> Column:
    """Sum of doubles to twelve decimals, 0 for no rows.

    Adding whole numbers is associative, so the result does not depend on the partitioning or
    on a retried task, and bigint sums stay in primitive codegen (wide decimals do not).
    """
    return of_limbs([F.coalesce(F.sum(part), F.lit(0)) for part in limbs(col)])


def exact_mean(col: Column) -> Column:
    return F.try_divide(exact_sum(col), F.count(col))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """0 when the denominator is 0; a missing operand stays missing."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.try_divide(numerator, denominator))


def clip_negative(col: Column) -> Column:
    return F.when(col < 0, F.lit(0.0)).otherwise(col)


def backfill_sales(sales: Column, shipped: Column) -> Column:
    """Shipped units stand in for missing or zero sales; 0 stays 0 when there is nothing."""
    return F.coalesce(F.nullif(sales, F.lit(0.0)), F.nullif(shipped, F.lit(0.0)), sales)


def sales_or_shipped(total: Column, shipped: Column) -> Column:
    return F.when(total > 0, total).otherwise(shipped)


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over columns with missing cells as 0."""
    total = F.lit(0.0)
    for name in columns:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return total


def row_argmax(columns: Sequence[str]) -> Column:
    """Name of the largest column; the first one wins ties, all missing gives NULL."""
    best = F.greatest(*[F.col(c) for c in columns]) if len(columns) > 1 else F.col(columns[0])
    out = F.lit(None).cast("string")
    for name in reversed(columns):
        out = F.when(F.col(name) == best, F.lit(name)).otherwise(out)
    return out


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.try_divide(part, whole), digits)


def mean_of_two(a: Column, b: Column) -> Column:
    """Row mean that skips missing values."""
    return F.coalesce((a + b) / 2.0, a, b)


def tier(col: Column, tiers: Sequence[tuple[str, float | None]]) -> Column:
    """Right-closed bins: a value on an edge belongs to the lower tier."""
    out = F.lit(None).cast("string")
    for name, edge in reversed(tiers):
        fits = col.isNotNull() if edge is None else col <= edge
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def tier_order(col: Column, tiers: Sequence[tuple[str, float | None]]) -> Column:
    """Position of a tier name, for sorting by size instead of by text."""
    out = F.lit(None).cast("int")
    for position, (name, _) in enumerate(tiers):
        out = F.when(col == name, F.lit(position)).otherwise(out)
    return out
