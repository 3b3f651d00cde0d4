"""Helpers the operators share: text batches, written tables, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.session import ensure_checkpoint_dir

# The blanks that end a word, as a character class and as a list.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
FILE_ROWS = 1 << 15  # of a table of few narrow rows
# Of a table whose rows hold megabytes. A file is else looked at every 100 rows only, so that many
# would be held as one group and one page, by the task that writes and by the one that reads them.
WIDE_ROWS = {"parquet.block.size": 8 << 20} | {f"parquet.{part}.size.row.check.{end}": 1 for part in ("block", "page") for end in ("min", "max")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def private_names(*tables: DataFrame) -> Callable[[str], str]:
    """Gives a name the prefix of underscores that no column of ``tables`` begins with."""
    prefix = "_"
    while any(c.startswith(prefix) for table in tables for c in table.columns):
        prefix += "_"
    return lambda name: prefix + name


def sealed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under numbered names that no operator uses, and the number of each name."""
    given = {c: f"given_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*given.values()), given


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables in the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: Mapping[str, int] | None = None) -> DataFrame:
    """Written once as Parquet in the shared folder and read again: no lineage, no local copy."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *sent: Broadcast) -> None:
    """Gives back what ended jobs hold on disk: ``sent`` values, and shuffles that no table refers to.

    The context drops a shuffle's files only after the driver's collector has met its plan, which in a
    driver of few objects may be never; until then the shuffles of all steps add up.
    """
    for value in sent:
        value.destroy()
    spark.sparkContext._jvm.System.gc()


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, in a partition for each ``FILE_ROWS`` if a shuffle has more.

    For tables that are small beside the partitions: without a native Hadoop library an executor
    starts a process for every file it creates, which counts with all memory of the executor
    while it starts. The rows are dealt anew, so the tasks that make them stay as many.
    """
    parts = max(1, -(-rows // FILE_ROWS))
    return df.repartition(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def chunks(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths sum to about ``most``; a longer row makes a range of its own."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8 bytes; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (src, dst): label is the smallest node reachable.

    Labels go to neighbours and then to their own label's label, so a chain of n nodes takes
    about log n rounds. Every round is written, in files by the number of edges.
    """
    pairs = edges.filter("src <> dst")
    pairs = written(pairs.union(pairs.select("dst", "src")).distinct(), "pairs")
    most = pairs.count()  # no fewer than nodes

    def kept(df: DataFrame) -> DataFrame:
        return written(in_few(df, most), "labels")

    labels = kept(
        pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
        .select("node", F.least("node", "near").alias("label"))
    )
    while True:
        told = (
            pairs.join(labels, pairs.dst == labels.node)
            .groupBy(F.col("src").alias("node")).agg(F.min("label").alias("told"))
        )
        nearer = kept(
            labels.join(told, "node")
            .select("node", F.col("label").alias("old"), F.least("label", "told").alias("label"))
        )
        target = nearer.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = kept(nearer.join(target, "label").select("node", F.col("next").alias("label"), "old"))
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
