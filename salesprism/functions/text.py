"""Text cells: missing markers, trimming, and the text-to-number rules of listing pages."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.schema import FEATURE_LABELS

# Fixed values. Markers replaced in every cell, and those replaced after trimming.
CELL_MARKERS = ("", "N/A", "na", "None")
TRIMMED_MARKERS = ("", "nan", "None", "N/A")
# Fixed values. Markers a CSV reader with default missing-value rules already drops.
READER_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def null_markers(col: Column, markers: Iterable[str] = (*CELL_MARKERS, *READER_MARKERS)) -> Column:
    """Whole-cell, case-sensitive missing markers become NULL."""
    return F.when(~col.isin(*dict.fromkeys(markers)), col)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def trimmed_markers(bare: Column) -> Column:
    return null_markers(bare, TRIMMED_MARKERS)


def trimmed(col: Column) -> Column:
    return trimmed_markers(strip(col))


def collapse_spaces(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+", " ")


def canonical_name(col: Column) -> Column:
    """Trade marks dropped, white space collapsed and trimmed."""
    return F.trim(collapse_spaces(F.regexp_replace(col, "[®™©]", "")))


def plain_decimal(bare: Column) -> Column:
    """Text without blanks around it to double where it is a plain decimal number."""
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d{1,3})?$"), bare.try_cast("double"))


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def decimal_text(col: Column) -> Column:
    """Text to double where it is a plain decimal number; no suffixes, no infinities."""
    return plain_decimal(strip(col))


def number(col: Column) -> Column:
    """Text to double, NULL where it does not parse or is not finite."""
    return finite(decimal_text(col))


def map_cells(df: DataFrame, columns: Sequence[str], *steps: Callable[[Column], Column]) -> DataFrame:
    """``df`` with the text of each of ``columns`` put through ``steps``, one after the other.

    The plan holds each step once, whatever the number of columns, and a step reads what the one
    before made. Written out for every column, steps of several expressions give generated
    methods that are too long for the JVM to compile, so that every row is interpreted.
    """
    if not columns:
        return df
    cells = F.array(*[F.col(f"`{c}`").cast("string") for c in columns])
    cells = reduce(lambda made, step: F.transform(made, lambda cell: step(cell)), steps, cells)
    name = "_cells"
    while name in df.columns:
        name += "_"
    at = {c: i for i, c in enumerate(columns)}
    return df.withColumn(name, cells).select(
        *[F.col(name)[at[c]].alias(c) if c in at else F.col(f"`{c}`") for c in df.columns]
    )


def sales_cell(col: Column) -> Column:
    """``1.23m`` to 1.23; blank, dash, bad and missing cells are 0."""
    text = strip(F.regexp_replace(col, "[mM]", ""))
    return F.coalesce(F.round(decimal_text(text), 3), F.lit(0.0))


def score_cell(col: Column) -> Column:
    """A score, or NULL for blank, ``N/A`` in any case and bad text."""
    return F.when(F.upper(col) != "N/A", decimal_text(col))


def rank_cell(col: Column) -> Column:
    """``#12`` to 12, anything unreadable to 0."""
    return F.coalesce(strip(F.regexp_replace(col, "#", "")).try_cast("bigint"), F.lit(0).cast("bigint"))


def release_year(col: Column) -> Column:
    """Two- to four-digit year at the end of a date text; 0 when there is none.

    The pivot of listing pages is 70: 70 to 1899 count from 1900, less counts from 2000.
    """
    text = F.trim(F.regexp_replace(col, "st|nd|rd|th", ""))
    year = F.regexp_extract(text, r"(\d{2,4})$", 1).try_cast("int")
    return F.coalesce(
        F.when(year >= 1900, year).when(year >= 70, year + 1900).otherwise(year + 2000),
        F.lit(0),
    )


def feature_label(col: Column) -> Column:
    """Readable feature name: ``Genre`` or ``Genre_Action`` style, unknown names unchanged."""
    bare = F.regexp_replace(col, r"^.*?__", "")
    out = F.lit(None).cast("string")
    for name, label in FEATURE_LABELS.items():
        out = (
            F.when(bare == name, F.lit(label))
            .when(bare.startswith(name + "_"), F.concat(F.lit(label + ":"), F.substr(bare, F.lit(len(name) + 2))))
            .otherwise(out)
        )
    return F.coalesce(out, bare)


def quarter_suffix(col: Column) -> Column:
    """``2018Q4`` to ``Q4``; text without a quarter stays."""
    return F.when(col.contains("Q"), F.right(col, F.lit(2))).otherwise(col)
