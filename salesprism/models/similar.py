"""Nearest rows of a few anchors by cosine similarity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.operators.preparation import anchors as best_sellers
from salesprism.operators.preparation import fill_median, standardise

NEIGHBOURS = 11
SAME = 1e-5
DIGITS = 9
WEIGHTS = {"Genre": 2.0, "Platform_Family": 1.0, "Publisher_Grouped": 1.0}
NUMERIC = ("Composite_Score", "Year")
MOST_ANCHORS = 1000


def nearest_rows(rows: DataFrame, anchors: DataFrame, similarity: Column, k: int, id_col: str) -> DataFrame:
    """The ``k`` most similar ``rows`` of each anchor with their position; the smaller id wins ties.

    The anchors, at most a thousand, are broadcast and meet every row; each task keeps the best ``k``
    of an anchor before anything is shuffled. Similarities are compared to nine digits.
    """
    if anchors.limit(MOST_ANCHORS + 1).count() > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    pairs = rows.crossJoin(F.broadcast(anchors)).withColumn("similarity", F.round(similarity, DIGITS))
    best = Window.partitionBy("anchor_id").orderBy(F.desc("similarity"), id_col)
    return pairs.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)


def similar_titles(df: DataFrame, id_col: str = schema.INGEST_ID, k: int = NEIGHBOURS, anchors: int = 10,
                   weights: Mapping[str, float] = WEIGHTS, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """For the best row of each of the best-selling names: similar titles of other names.

    A title is its standardised score and year and one weighted place per category. Such vectors
    are never built: equal categories add the square of their weight to the product. Of the
    ``k`` nearest, the anchor's equals and other rows of its name are left out.
    """
    spots = standardise(fill_median(df.withColumns({c: F.col(c).cast("double") for c in numeric}), numeric), numeric)
    square = sum((F.col(c) * F.col(c) for c in numeric), F.lit(0.0))
    square = square + sum((F.when(F.col(c).isNotNull(), w * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    columns = [id_col, "Name", "Global_Sales", *numeric, *weights]
    spots = spots.withColumn("norm", F.sqrt(square)).select(*columns, "norm")
    chosen = best_sellers(df, id_col, anchors).select(F.col(id_col).alias("chosen"))
    starts = spots.join(F.broadcast(chosen), spots[id_col] == F.col("chosen"), "left_semi")
    starts = starts.select(F.col(id_col).alias("anchor_id"), *[F.col(c).alias(f"anchor_{c}") for c in [*columns[1:], "norm"]])
    dot = sum((F.col(c) * F.col(f"anchor_{c}") for c in numeric), F.lit(0.0))
    dot = dot + sum((F.when(F.col(c) == F.col(f"anchor_{c}"), w * w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    similarity = F.coalesce(F.try_divide(dot, F.col("norm") * F.col("anchor_norm")), F.lit(0.0))
    found = nearest_rows(spots, starts, similarity, k, id_col)
    return found.filter((1 - F.col("similarity") >= SAME) & ~F.col("Name").eqNullSafe(F.col("anchor_Name"))).select(
        "anchor_id", F.col("anchor_Name").alias("anchor"), F.col("anchor_Platform_Family").alias("anchor_platform"),
        F.col(id_col).alias("candidate_id"), F.col("Name").alias("candidate"), F.col("Platform_Family").alias("candidate_platform"),
        F.greatest("similarity", F.lit(0.0)).alias("similarity"), F.col("anchor_Global_Sales").alias("anchor_sales"),
        F.col("Global_Sales").alias("candidate_sales"), F.col("Genre").eqNullSafe(F.col("anchor_Genre")).alias("genre_match"),
    )


def similar_vectors(df: DataFrame, anchor_ids: DataFrame, id_col: str, vec_col: str, k: int = NEIGHBOURS) -> DataFrame:
    """(anchor_id, position, id, similarity) of the ``k`` rows nearest to each anchor by an array column.

    Rows without a vector take no part; a zero vector is similar to nothing.
    """
    vec = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, c: s + c * c))
    rows = df.filter(F.col(vec_col).isNotNull()).select(id_col, vec.alias("vec")).withColumn("norm", norm)
    starts = rows.join(F.broadcast(anchor_ids.select(id_col)), id_col, "left_semi")
    starts = starts.select(F.col(id_col).alias("anchor_id"), F.col("vec").alias("anchor_vec"), F.col("norm").alias("anchor_norm"))
    dot = F.aggregate(F.zip_with("vec", "anchor_vec", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    similarity = F.coalesce(F.try_divide(dot, F.col("norm") * F.col("anchor_norm")), F.lit(0.0))
    return nearest_rows(rows, starts, similarity, k, id_col).select("anchor_id", "position", id_col, "similarity")
