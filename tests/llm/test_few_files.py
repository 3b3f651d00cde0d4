"""Small tables are written in few files, however many partitions a shuffle has."""

import glob

import pytest
from salesprism.llm import quality, simhash


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def folders(spark):
    found = spark.sparkContext.getCheckpointDir()
    return set(glob.glob(found.removeprefix("file:") + "/*")) if found else set()


def files(new):
    return [(f.rpartition("/")[2].split("-")[0], len(glob.glob(f + "/part-*"))) for f in new]


def table(spark):
    rows = [(i, " ".join(f"w{(i // 2) * 7 + k}" for k in range(60)), "en", f"s{i % 9}") for i in range(90)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_op8_tables_of_few_rows(spark, many_partitions):
    before = folders(spark)
    got = simhash.simhash_components(table(spark))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i in range(90)}
    assert got.rdd.getNumPartitions() == 1
    written = files(folders(spark) - before)
    assert {"nodes", "cells", "shared", "components"} <= {name for name, _ in written}
    assert all(n <= 1 for name, n in written if name not in ("fingerprints", "pairs"))


def test_op9_tables_of_groups(spark, many_partitions):
    before = folders(spark)
    assert quality.quality_rules(table(spark)).filter("kept").count() == 90
    written = files(folders(spark) - before)
    assert {"scatter", "best", "estimates"} <= {name for name, _ in written}
    assert all(n <= 1 for name, n in written if name in ("scatter", "best", "estimates"))


def test_components_of_a_chain(spark, many_partitions):
    from salesprism.llm.common import connected_components

    before = folders(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src bigint, dst bigint")
    assert {r.node: r.label for r in connected_components(edges).collect()} == dict.fromkeys(range(41), 0)
    written = files(folders(spark) - before)
    assert {n for name, n in written if name == "labels"} == {1}
