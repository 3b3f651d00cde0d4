"""Evaluation, preparation and files on rows small enough to check by hand."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from salesprism.operators import evaluation, preparation
from salesprism.sources import files


def one(df):
    return df.collect()[0].asDict()


def test_regression_metrics(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double")
    got = one(evaluation.regression_metrics(rows))
    assert got["mae"] == pytest.approx(1 / 3) and got["rmse"] == pytest.approx((1 / 3) ** 0.5)
    assert got["r2"] == pytest.approx(0.5)
    assert one(evaluation.regression_metrics(rows.where("y = 1")))["r2"] is None


def test_classification_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, prob double")
    got = one(evaluation.classification_metrics(rows))
    assert (got["accuracy"], got["precision"], got["recall"], got["f1"], got["support"]) == (0.5, 0.5, 0.5, 0.5, 2)
    assert got["brier"] == pytest.approx((0.01 + 0.36 + 0.36 + 0.01) / 4)
    none = one(evaluation.classification_metrics(rows.where("label = 0 AND prob < 0.5")))
    assert (none["accuracy"], none["precision"], none["recall"], none["f1"]) == (1.0, 0.0, 0.0, 0.0)
    report = {r["class"]: r["support"] for r in evaluation.classification_report(rows).collect()}
    assert report == {"0": 2, "1": 2, "macro": 4, "weighted": 4}


def test_calibration_bins_are_closed_on_the_right(spark):
    rows = spark.createDataFrame([(0, 0.0), (0, 0.1), (1, 0.11), (1, 1.0)], "label int, prob double")
    assert {r["bin"]: r["n"] for r in evaluation.calibration_curve(rows).collect()} == {0: 2, 1: 1, 9: 1}


def test_fill_standardise_and_share(spark):
    rows = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 5.0), (3, 4.0, 5.0)], "id long, a double, b double")
    assert [r.a for r in preparation.fill_median(rows, ["a"]).orderBy("id").collect()] == [1.0, 2.5, 4.0]
    scaled = preparation.standardise(rows, ["a", "b"]).orderBy("id").collect()
    assert [(r.a, r.b) for r in scaled] == [(-1.0, 0.0), (None, 0.0), (1.0, 0.0)]
    parts = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0)], "a double, b double")
    got = preparation.region_vectors(parts, ["a", "b"]).collect()
    assert [(r.a_Part, r.b_Part) for r in got] == [(0.25, 0.75), (0.0, 0.0)]


def test_split_depends_on_the_id_alone(spark):
    ids = spark.range(20000)
    some = {r.id: r.part for r in preparation.train_test(ids.where("id % 7 = 0").repartition(3), "id").collect()}
    everything = {r.id: r.part for r in preparation.train_test(ids, "id").collect()}
    assert all(everything[i] == part for i, part in some.items())
    assert 0.18 < sum(p == "test" for p in everything.values()) / 20000 < 0.22


def test_csv_keeps_quotes_nulls_and_bad_rows(spark, tmp_path):
    path = str(tmp_path / "cells")
    given = [(1, 'a "b", c', 1.5), (2, None, None), (3, " x ", 0.0), (4, "", 2.0)]
    rows = spark.createDataFrame(given, "id long, name string, v double")
    files.write_csv(rows.coalesce(1), path)
    back = files.read_csv(spark, path, rows.schema).orderBy("id").collect()
    assert [tuple(r)[:3] for r in back] == given and not any(r["_corrupt_record"] for r in back)
    (tmp_path / "bad.csv").write_text("id,name,v\n1,a,2.5\nx,b,3\n")
    bad = files.read_csv(spark, str(tmp_path / "bad.csv"), rows.schema).collect()
    assert [r.name for r in bad] == ["a", "b"] and bad[1]["_corrupt_record"] == "x,b,3"


def test_absent_sources(spark, tmp_path):
    columns = T.StructType([T.StructField("k", T.StringType())])
    with pytest.raises(AnalysisException):
        files.first_found([lambda: files.read_csv(spark, str(tmp_path / "none"), columns)])
    assert files.read_lookup(spark, str(tmp_path / "none.json"), "k", "v").count() == 0
