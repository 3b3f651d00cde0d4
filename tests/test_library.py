"""Cells, dates and a few registered queries against their SQL."""

import datetime
import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from salesprism.functions import dates, text

SMALL = "/root/testdata/sf0.001"


def cells(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("x"))).collect()]


def test_numbers_are_plain_decimals(spark):
    assert cells(spark, text.number, ["1.5", " 7 ", "1d", "2f", "NaN", "Infinity", "-.5", "1e3", ""]) == [
        1.5, 7.0, None, None, None, None, -0.5, 1000.0, None
    ]


def test_sales_and_score_cells(spark):
    assert cells(spark, text.sales_cell, ["1.23m", "", "-", None, "3.5D"]) == [1.23, 0.0, 0.0, 0.0, 0.0]
    assert cells(spark, text.score_cell, ["8.5", "n/a", "", "9f"]) == [8.5, None, None, None]


def test_dates(spark):
    day = datetime.date
    assert cells(spark, dates.parse_date, ["05th Nov 95", "5 March 2001", "2001-03-05", "Mar 05, 2001", "soon", None]) == [
        day(1995, 11, 5), day(2001, 3, 5), day(2001, 3, 5), day(2001, 3, 5), None, None
    ]


def test_unicode_blanks_collapse(spark):
    assert cells(spark, text.collapse_spaces, ["a  b"]) == ["a b"]


def test_filters_do_not_repeat_the_parsing(spark):
    from salesprism.operators import cleaning
    from salesprism.workload import cleaning as work

    def parses(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("gettimestamp")

    typed = work.typed(spark, SMALL)
    assert parses(cleaning.accepted(work.labelled(spark, SMALL))) <= max(parses(typed), 1)


def normal(df):
    rows = [["-" if pd.isna(x) else round(float(x), 5) if isinstance(x, float) else str(x) for x in r] for r in df[sorted(df.columns)].values.tolist()]
    return sorted(map(str, rows))


@pytest.mark.parametrize("name", ["tier_contributions", "filter_audit", "dates_and_year", "pareto_curve", "platform_share"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    assert normal(got) == normal(con.sql(entry.oracle_sql()[name]).df())


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
