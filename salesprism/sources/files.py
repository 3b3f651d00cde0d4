"""File sources and sinks; every folder is the caller's path in a store all executors reach."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesprism import schema

# Quotes inside a cell are doubled, blanks around it stay, and empty text is not missing text.
_CSV = {
    "header": True, "escape": '"', "emptyValue": '""', "nullValue": "", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def first_found(readers: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The first reader whose path exists, in the given order; any other error is raised.

    Readers with a given schema look their path up when they are made, so nothing is scanned.
    """
    missing = None
    for reader in readers:
        try:
            return reader()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing = error
    raise missing or ValueError("no source was given")


def read_csv(spark: SparkSession, path: str, columns: T.StructType, multi_line: bool = False) -> DataFrame:
    """Rows of ``columns`` and the text of rows that do not fit it, which are kept.

    The header row names nothing: columns go by their place. Files are split among tasks
    unless ``multi_line`` says that cells hold line ends.
    """
    fields = T.StructType([*columns.fields, T.StructField(schema.CORRUPT_RECORD, T.StringType())])
    options = _CSV | {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": schema.CORRUPT_RECORD, "enforceSchema": True,
        "multiLine": multi_line, "emptyValue": "",
        "nullValue": "\x00",  # cells with nothing in them read as this; as "", quoted empty text would be missing too
    }
    return spark.read.schema(fields).options(**options).csv(path)


def raw_listing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The raw table from the first path that exists, every column as text."""
    return first_found([lambda p=p: read_csv(spark, p, schema.RAW_SCHEMA) for p in paths])


def clean_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The clean table from the first path that exists, typed by its contract."""
    return first_found([lambda p=p: read_csv(spark, p, schema.CLEAN_SCHEMA) for p in paths])


def write_csv(df: DataFrame, path: str) -> None:
    """One file a task, UTF-8 with a header each. Folders that exist are not overwritten."""
    df.write.options(**_CSV).csv(path)


def write_parquet(df: DataFrame, path: str, partition: str = "Decade") -> None:
    """A folder per value of ``partition``; its rows stay spread over the tasks they are in."""
    df.write.partitionBy(partition).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line; missing values are written as null."""
    df.write.option("ignoreNullFields", False).json(path)


def read_lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) from JSON objects with those fields; without rows if there is no such file."""
    columns = T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.StringType())])
    try:
        return spark.read.schema(columns).json(path).where(F.col(key).isNotNull())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)
