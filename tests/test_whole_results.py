"""Nothing is lost to a grid, a list of values or one partition read back."""

import pytest
from pyspark.sql import functions as F

from salesprism.functions.sales import exact_mean, exact_sum
from salesprism.operators import charts, cleaning, ordered


def test_tiny_and_large_sales_add_up(spark):
    df = spark.createDataFrame([(0.00004,), (1e9,), (0.1,), (-0.3,), (None,)], "x double").repartition(3)
    total = df.agg(exact_sum(F.col("x")).alias("s"), exact_mean(F.col("x")).alias("m")).first()
    assert total.s == pytest.approx(1e9 + 0.1 - 0.3 + 0.00004, abs=3e-7) and total.m == pytest.approx(total.s / 4)
    small = spark.createDataFrame([(0.00004,), (0.00008,)], "x double")
    assert small.agg(exact_sum(F.col("x"))).first()[0] == pytest.approx(0.00012, rel=1e-6)
    assert df.limit(0).agg(exact_sum(F.col("x"))).first()[0] == 0


def test_curves_of_tiny_values(spark):
    df = spark.createDataFrame([(1, 0.00001), (2, 0.00003)], "ingest_id long, Global_Sales double")
    assert [r.value_share for r in ordered.lorenz_curve(df).orderBy("row_share").collect()] == pytest.approx([0, 0.25, 1])
    assert [r.cum_share for r in ordered.pareto_curve(df).orderBy("rank").collect()] == pytest.approx([0.75, 1])


def test_values_that_are_not_listed(spark):
    df = spark.createDataFrame([(2000, "a", "x"), (2000, "b", "x"), (2001, "c", "x"), (2001, "a", None)], "Year int, k string, Name string")
    wide = charts.count_wide(df, "k", ["a", "b"], rest="others").orderBy("Year").collect()
    assert [tuple(r) for r in wide] == [(2000, 1, 1, 0), (2001, 0, 0, 1)]
    assert charts.count_wide(df.filter("k <> 'c'"), "k", ["a", "b"]).columns == ["Year", "a", "b"]
    with pytest.raises(Exception, match="not listed"):
        charts.count_wide(df, "k", ["a", "b"]).collect()


def test_audit_closes(spark):
    key = "Name string, Platform string, Year int, Publisher string, rejection string"
    rows = [("a", "p", 1, None, None)] * 3 + [("b", "p", 1, "q", None), ("c", None, 1, None, "missing_key"), (None, None, None, None, "no_year")]
    labelled = spark.createDataFrame(rows, key)
    audit = {r.rule: r.removed for r in cleaning.filter_audit(labelled).collect()}
    assert audit == {"no_year": 1, "aggregate_row": 0, "missing_key": 1, "invalid_sales": 0, "year_out_of_range": 0, "duplicate": 2}
    r = cleaning.retention(labelled).first()
    assert (r.initial_rows, r.final_rows) == (6, 2) and r.deduplication_rate == pytest.approx(2 / 6)
    assert cleaning.retention(labelled.limit(0)).first().initial_rows == 0


def test_shares_come_from_one_scan(spark, tmp_path):
    from salesprism.operators import market

    rows = [("a", "<1M", 1.0, 2.0), ("b", "<1M", 3.0, 0.0), (None, None, 4.0, 2.0), ("a", "20M+", None, 0.0)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "Genre string, Sales_Tier string, Global_Sales double, NA_Sales double").write.parquet(path)
    t = spark.read.parquet(path)
    shares = market.share_of_total(t, "Genre")
    assert {tuple(r) for r in shares.collect()} == {("a", 1.0, 0.125), ("b", 3.0, 0.375)}
    tiers = market.tier_contributions(t, regions=["NA_Sales"])
    assert {(r.tier, r.titles, r.avg_sales, r.lift) for r in tiers.collect()} == {("<1M", 2, 2.0, 0.75), ("20M+", 1, None, None)}
    preference = market.region_preference(t, regions=["NA_Sales"])
    assert {r.preference for r in preference.collect()} == {0.0, -1.0}
    for df in (shares, tiers, preference):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("Initial Plan")[0] if "Initial Plan" in plan else plan
        assert "ReusedExchange" in final or final.count("FileScan") <= 1
