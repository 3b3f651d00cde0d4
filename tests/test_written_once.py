"""Rows that several aggregates read are made once."""

from pyspark.sql import functions as F

from salesprism.session import written_once


def test_rows_are_made_once_and_read_by_column(spark):
    made = spark.createDataFrame([(1, "a", None), (1, "a", 2.5), (None, None, 0.0)], "id long, name string, sales double")
    rows = written_once(made.withColumn("draw", F.rand()))
    assert rows.schema.simpleString() == "struct<id:bigint,name:string,sales:double,draw:double>"
    assert sorted(map(str, rows.collect())) == sorted(map(str, rows.collect()))
    assert sorted(map(str, rows.drop("draw").collect())) == sorted(map(str, made.collect()))
    assert rows.inputFiles() and written_once(made.limit(0)).count() == 0
