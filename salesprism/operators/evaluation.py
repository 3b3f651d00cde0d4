"""Scores of predictions, each in one aggregate over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, actual: str = "y", predicted: str = "p") -> DataFrame:
    """(mae, rmse, r2); r2 is missing where the actual values do not vary."""
    error = F.col(actual) - F.col(predicted)
    square = F.avg(error * error)
    spread = F.var_pop(actual)
    return df.agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(square).alias("rmse"),
        (1 - square / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def _scores(hit: str, false_hit: str, miss: str) -> list[Column]:
    """precision, recall, f1 and support from counts; 0 on division by zero."""
    t, f, m = F.col(hit), F.col(false_hit), F.col(miss)
    return [
        _ratio(t, t + f).alias("precision"), _ratio(t, t + m).alias("recall"),
        _ratio(2 * t, 2 * t + f + m).alias("f1"), (t + m).alias("support"),
    ]


def _counts(df: DataFrame, label: str, probability: str, threshold: float) -> DataFrame:
    real, said = F.col(label) == 1, F.col(probability) >= threshold
    off = F.col(probability) - F.col(label)
    return df.agg(
        F.count_if(real & said).alias("tp"), F.count_if(~real & said).alias("fp"),
        F.count_if(real & ~said).alias("fn"), F.count_if(~real & ~said).alias("tn"), F.avg(off * off).alias("brier"),
    )


def classification_metrics(
    df: DataFrame, label: str = "label", probability: str = "prob", threshold: float = 0.5
) -> DataFrame:
    """(accuracy, precision, recall, f1, support, brier) of the positive class."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    right = F.col("tp") + F.col("tn")
    counts = _counts(df, label, probability, threshold)
    return counts.select(_ratio(right, n).alias("accuracy"), *_scores("tp", "fp", "fn"), "brier")


def classification_report(
    df: DataFrame, label: str = "label", probability: str = "prob", threshold: float = 0.5
) -> DataFrame:
    """(class, precision, recall, f1, support) of both classes, their mean and their weighted mean."""
    counts = _counts(df, label, probability, threshold)
    both = counts.select(F.struct(*_scores("tn", "fn", "fp")).alias("a"), F.struct(*_scores("tp", "fp", "fn")).alias("b"))
    n = F.col("a.support") + F.col("b.support")
    rates = ("precision", "recall", "f1")

    def row(name: str, rate) -> Column:
        support = {"0": F.col("a.support"), "1": F.col("b.support")}.get(name, n)
        return F.struct(F.lit(name).alias("class"), *[rate(r).alias(r) for r in rates], support.alias("support"))

    def weighted(r: str) -> Column:
        return _ratio(F.col(f"a.{r}") * F.col("a.support") + F.col(f"b.{r}") * F.col("b.support"), n)

    rows = [
        row("0", lambda r: F.col(f"a.{r}")), row("1", lambda r: F.col(f"b.{r}")),
        row("macro", lambda r: (F.col(f"a.{r}") + F.col(f"b.{r}")) / 2), row("weighted", weighted),
    ]
    return both.select(F.inline(F.array(*rows)))


def calibration_curve(df: DataFrame, label: str = "label", probability: str = "prob", bins: int = 10) -> DataFrame:
    """(bin, predicted, observed, n) of equal right-closed bins; empty bins do not appear."""
    at = F.greatest(F.ceil(F.col(probability) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(at.alias("bin")).agg(
        F.avg(probability).alias("predicted"), F.avg(F.col(label)).alias("observed"), F.count("*").alias("n")
    )


def likeliest(df: DataFrame, id_col: str, probability: str = "prob", k: int = 25) -> DataFrame:
    """The ``k`` rows of highest probability; the smaller id wins ties."""
    return df.orderBy(F.desc(probability), id_col).limit(k)
