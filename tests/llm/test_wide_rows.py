"""Rows of megabytes are written in row groups of a few."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from salesprism.llm.common import WIDE_ROWS, written
from salesprism.llm.decontaminate import build_index, matches


def test_index_has_small_row_groups(spark):
    rng = np.random.default_rng(3)
    # 48 segments of one task, the first ones small: few rows tell little of those that follow.
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 200 if i < 4 else 40_000))) for i in range(48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).localCheckpoint()
    index = build_index(docs, ("doc_id",), "text", 400_000)
    parts = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i).total_byte_size for m in parts for i in range(m.num_row_groups)]
    assert max(groups) <= 10 << 20 < sum(groups) // 2, groups
    items = spark.createDataFrame([("a", " ".join(rows[30][1].split()[500:520]))], "item_id string, text string")
    hits = matches(docs, items, segment_bytes=400_000).filter(F.size("hits") > 0).collect()
    assert [(r["doc_id"], r["hits"], r["items"]) for r in hits] == [(30, list(range(500, 520)), ["a"])]


def test_options_leave_the_rows(spark):
    df = spark.range(300).withColumn("x", F.col("id") % 7)
    assert sorted(written(df, "wide", WIDE_ROWS).collect()) == sorted(written(df, "plain").collect()) == sorted(df.collect())
