"""Whole jobs: the clean table from raw listing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from salesprism import schema
from salesprism.models.clusters import cluster_regions
from salesprism.models.imputation import impute_scores
from salesprism.models.outliers import flag_outliers
from salesprism.operators import cleaning
from salesprism.session import cut_lineage


def typed_rows(raw: DataFrame, as_of_year: int) -> DataFrame:
    """Raw text rows with missing markers, dates, year and numbers settled."""
    cells = cleaning.trim_text(cleaning.null_missing_cells(cleaning.trim_column_names(raw)))
    return cleaning.settled(cleaning.coerce_numbers(cleaning.parse_dates_and_year(cells, as_of_year)))


def kept_rows(raw: DataFrame, as_of_year: int) -> DataFrame:
    """Rows that no rule rejects, the first of each key."""
    labelled = cleaning.label_rejections(cleaning.fill_sales(typed_rows(raw, as_of_year)), as_of_year)
    return cleaning.keep_first(cleaning.accepted(labelled))


def enriched(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Kept rows with outlier scores, features, imputed scores and region clusters.

    The presence flags tell which scores were there before they were imputed.
    """
    flagged = flag_outliers(rows)
    featured = cut_lineage(cleaning.engineer_features(flagged, as_of_year))
    return cleaning.score_features(cluster_regions(impute_scores(featured)))


def clean_table(raw: DataFrame, as_of_year: int) -> DataFrame:
    """The 43 columns of the clean table.

    Parsing runs once: the kept rows are checkpointed, as every fit reads them.
    """
    rows = cut_lineage(kept_rows(raw, as_of_year))
    return cleaning.conform(enriched(rows, as_of_year), schema.CLEAN_SCHEMA)
