"""Boosted trees on the titles: preparation, regression, calibrated classification, importance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism import schema
from salesprism.functions.text import feature_label
from salesprism.models.statistics import quantiles
from salesprism.operators.lookup import group_rest
from salesprism.operators.preparation import spread_id
from salesprism.session import cut_lineage

NUMERIC = ("Year", "Decade")
CATEGORICAL = ("Platform_Family", "Genre", "Publisher_Grouped")
TOP_PUBLISHERS = 30
HIT = 1.0
FEWEST_ROWS = 50
PARTS = ("train", "validation", "test")
SCORE_BINS = 10_000


def prepare_features(df: DataFrame, publishers: int = TOP_PUBLISHERS) -> DataFrame:
    """Publisher_Grouped, and no missing value in any feature.

    The publishers with most titles keep their name, all others and missing ones are grouped;
    missing genre and family get their fixed names, Year and Decade the exact median.
    """
    df = group_rest(df, "Publisher", F.count("*"), publishers, schema.OTHER_PUBLISHER, "Publisher_Grouped")
    medians = quantiles(df, dict.fromkeys(NUMERIC, 0.5))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    return df.withColumns({
        **filled,
        "Genre": F.coalesce("Genre", F.lit(schema.UNKNOWN_GENRE)),
        "Platform_Family": F.coalesce("Platform_Family", F.lit(schema.UNKNOWN_FAMILY)),
    })


def three_parts(id_col: str, test: float = 0.2, validation: float = 0.1) -> Column:
    """train, validation or test, by the id alone: early stopping never sees the test rows."""
    draw = spread_id(id_col)
    return (
        F.when(draw < round(1000 * test), "test")
        .when(draw < round(1000 * (test + validation)), "validation").otherwise("train")
    )


@dataclass
class Encoder:
    """Features as one vector; categories keep their metadata, so trees split them as categories."""

    model: PipelineModel
    columns: list[str]
    widest: int

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop(*[f"_{c}" for c in CATEGORICAL])


def fit_encoder(df: DataFrame, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> Encoder:
    indexers = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep", stringOrderType="frequencyDesc") for c in categorical]
    vector = VectorAssembler(inputCols=[*numeric, *[f"_{c}" for c in categorical]], outputCol="features")
    model = Pipeline(stages=[*indexers, vector]).fit(df)
    widest = max((len(s.labels) + 1 for s in model.stages[:-1]), default=2)
    return Encoder(model, [*numeric, *categorical], widest)


@dataclass
class Regression:
    encoder: Encoder
    model: object

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """``df`` with a prediction on every row; nothing is joined back."""
        scored = self.model.transform(self.encoder.transform(df))
        return scored.withColumn(out, F.col("prediction")).drop("features", "prediction")

    @property
    def trees_used(self) -> int:
        return self.model.getNumTrees

    def importance(self, spark, k: int = 15) -> DataFrame:
        """(feature, importance) of the ``k`` most used features, by their shares of the gain."""
        shares = zip(self.encoder.columns, self.model.featureImportances.toArray().tolist(), strict=True)
        table = spark.createDataFrame(list(shares), "name string, importance double")
        return table.orderBy(F.desc("importance"), "name").limit(k).select(feature_label(F.col("name")).alias("feature"), "importance")


def _fitted_rows(df: DataFrame, id_col: str, label: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Only what a fit reads, written once: every tree scans it several times."""
    columns = [*NUMERIC, *CATEGORICAL]
    return cut_lineage(df.select(id_col, *columns, *keep, label.cast("double").alias("label"), three_parts(id_col).alias("part")))


def fit_regression(df: DataFrame, id_col: str, target: str = "Global_Sales", trees: int = 40, rate: float = 0.1,
                   depth: int = 5, least_rows: int = 20, seed: int = 42) -> Regression | None:
    """Boosted regression of ``target`` on the prepared features; None for tiny or constant tables.

    Boosting stops when the validation rows no longer gain. ``trees`` bounds the serial steps; each
    is distributed over the rows.
    """
    rows = _fitted_rows(df.filter(F.col(target).isNotNull()), id_col, F.col(target))
    facts = rows.agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("varies")).first()
    if facts.n < FEWEST_ROWS or not facts.varies:
        return None
    encoder = fit_encoder(rows.filter("part <> 'test'"))
    fit = encoder.transform(rows.filter("part <> 'test'")).withColumn("validation", F.col("part") == "validation")
    booster = GBTRegressor(labelCol="label", maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=least_rows,
                           maxBins=max(32, encoder.widest), validationIndicatorCol="validation", seed=seed)
    return Regression(encoder, booster.fit(fit.select("features", "label", "validation")))


@dataclass
class Hits:
    """Fold models, each with the calibration learned on the fold it did not see."""

    encoder: Encoder
    folds: list[tuple[object, object]]

    def predict(self, df: DataFrame, out: str = "prob") -> DataFrame:
        """``df`` with the mean calibrated probability, and that of the raw models in ``<out>_raw``."""
        scored = self.encoder.transform(df)
        for i, (model, calibration) in enumerate(self.folds):
            scored = model.transform(scored.drop("rawPrediction", "probability", "prediction"))
            scored = scored.withColumn(f"_raw{i}", _score_of(F.col("probability"))).drop("rawPrediction", "probability", "prediction")
            scored = calibration.transform(scored.withColumn("score", F.col(f"_raw{i}"))).withColumnRenamed("prediction", f"_p{i}").drop("score")
        n = len(self.folds)
        mean = {name: sum((F.col(f"{c}{i}") for i in range(n)), F.lit(0.0)) / n for name, c in ((out, "_p"), (out + "_raw", "_raw"))}
        return scored.withColumns(mean).drop("features", *[f"{c}{i}" for i in range(n) for c in ("_p", "_raw")])


def _score_of(probability: Column) -> Column:
    """Scores on a grid of ten thousandths, so a calibration has bounded many steps."""
    return F.round(vector_to_array(probability)[1] * SCORE_BINS) / SCORE_BINS


def fit_hits(df: DataFrame, id_col: str, target: str = "Global_Sales", hit: float = HIT, folds: int = 3, trees: int = 30,
             rate: float = 0.1, depth: int = 5, seed: int = 42) -> Hits | None:
    """Boosted classification of ``target >= hit``, calibrated isotonically; None if one class is missing.

    Per fold a model is boosted on the others and its scores on the fold are calibrated: counts and
    hit rates per score are pooled until they rise. Test rows take no part.
    """
    label = (F.coalesce(F.col(target), F.lit(0.0)) >= hit).cast("double")
    rows = _fitted_rows(df, id_col, label).filter("part <> 'test'")
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return None
    encoder = fit_encoder(rows)
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(folds))
    data = cut_lineage(encoder.transform(rows).withColumn("fold", fold).select("features", "label", "fold", "part"))
    out = []
    for k in range(folds):
        booster = GBTClassifier(labelCol="label", maxIter=trees, stepSize=rate, maxDepth=depth, minInstancesPerNode=20,
                                maxBins=max(32, encoder.widest), validationIndicatorCol="validation", seed=seed + k)
        others = data.filter(F.col("fold") != k).withColumn("validation", F.col("part") == "validation")
        model = booster.fit(others.select("features", "label", "validation"))
        held = model.transform(data.filter(F.col("fold") == k)).select(_score_of(F.col("probability")).alias("score"), "label")
        steps = cut_lineage(held.groupBy("score").agg(F.avg("label").alias("rate"), F.count("*").cast("double").alias("weight")))
        isotonic = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight")
        out.append((model, isotonic.fit(steps)))
    return Hits(encoder, out)
