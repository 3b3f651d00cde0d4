"""Steps over many columns stay short enough for the JVM to compile, and give what they gave column by column."""

import re

import numpy as np
from pyspark.sql import functions as F

from salesprism import jobs, schema
from salesprism.functions import text
from salesprism.models.imputation import chain, impute_scores
from salesprism.models.statistics import moments, quantiles
from salesprism.plans.titles import dealt

JVM_LIMIT = 8000  # bytes of a method beyond which the JVM interprets it


def longest_method(df):
    """Bytes of the longest method of the plan's generated code, as Spark's own explain states it."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan)), default=0)


def raw_rows(spark):
    cells = {c: "1.5" for c in schema.RAW_COLUMNS} | {"Name": " a ", "Year": "2001", "Release_Date": "3rd May 01", "Last_Update": "nan"}
    odd = {c: None for c in schema.RAW_COLUMNS} | {"Name": "N/A", "Year": "0", "Rank": "7", "Global_Sales": " 2 ", "NA_Sales": "1e999"}
    rows = [tuple(r[c] for c in schema.RAW_COLUMNS) for r in (cells, odd)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ingest_id long, " + ", ".join(f"`{c}` string" for c in schema.RAW_COLUMNS))


def test_parsing_is_compiled(spark):
    typed = jobs.typed_rows(raw_rows(spark), 2002)
    assert longest_method(typed) < JVM_LIMIT
    a, b = typed.orderBy("ingest_id").collect()
    assert (a.Name, a.Year, str(a.Release_Date), a.Last_Update, a.Rank, a.NA_Sales) == ("a", 2001, "2001-05-03", None, 1, 1.5)
    assert (b.Name, b.Year, b.Release_Date, b.Rank, b.Global_Sales, b.NA_Sales) == (None, 1970, None, 7, 2.0, None)


def test_cells_go_through_the_steps_in_order(spark):
    df = spark.createDataFrame([(" 1 ", "x", "y"), (None, None, "z")], "`a.b` string, _cells string, c string")
    out = text.map_cells(df, ["a.b", "c"], text.strip, lambda c: F.concat(c, F.lit("!")))
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [("1!", "x", "y!"), (None, None, "z!")]
    assert text.map_cells(df, []) is df


def test_filled_scores_follow_the_maps_and_are_compiled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(200):
        base = float(rng.uniform(1, 9))
        gaps = [rng.random() < 0.4 for _ in range(3)]
        scores = [(float("nan") if i % 2 else None) if g else base + float(rng.normal()) / 4 for g in gaps]
        rows.append((i, *scores, base if i % 7 else None, 2000 + i % 5))
    columns = [*schema.SCORES, "Global_Sales", "Year"]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in columns[:4]) + ", Year int")
    filled = impute_scores(df)
    assert longest_method(filled) < JVM_LIMIT and filled.columns == df.columns
    has = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in columns]
    medians = quantiles(df, dict.fromkeys(columns, 0.5))
    clean = df.select(*[F.when(h, F.col(c).cast("double")).alias(c) for c, h in zip(columns, has)], *[h.alias(f"h{i}") for i, h in enumerate(has)])
    maps = chain(moments(clean, columns, [f"h{i}" for i in range(5)], medians))
    centre = np.array([medians[c] for c in columns])
    for before, after in zip(rows, filled.orderBy("id").collect()):
        x = np.array([np.nan if v is None else v for v in before[1:]], float)
        present = tuple(bool(b) for b in ~np.isnan(x))
        known = np.concatenate([[1.0], np.where(present, x - centre, 0.0)])
        for t, c in enumerate(schema.SCORES):
            want = x[t] if present[t] else maps[present][t + 1] @ known + centre[t]
            assert abs(after[c] - max(want, 0.0)) < 0.0051


def test_lines_are_dealt_by_their_number(spark):
    lines = spark.range(1000).select(F.col("id").alias("l_orderkey"))
    orders = spark.range(100).select(F.col("id").alias("o_orderkey"))
    assert dealt(lines, orders) == (lines, orders)
    a, b = dealt(lines, orders, most=50)
    joined = a.join(b, F.col("l_orderkey") == F.col("o_orderkey"))
    assert a.rdd.getNumPartitions() == b.rdd.getNumPartitions() == 20 and joined.count() == 100
