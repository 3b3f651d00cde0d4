"""Whole texts that occur often, settled by their strong digests before any window is looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import written

HEAD_GROUPS = 1 << 18


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def frequent_copies(docs: DataFrame, most: int = HEAD_GROUPS) -> DataFrame:
    """(digest, least): the largest groups of equal texts of ``docs`` (id, row, text), and their least id.

    At most ``most`` groups, so they may be broadcast; whole classes of about equal size are taken.
    Groups that are not among them are left to the windows, which settle them as well.
    """
    groups = written(
        docs.filter("text IS NOT NULL").groupBy(digest_of("text").alias("digest"))
        .agg(F.min("id").alias("least"), F.count("*").alias("f")).filter("f > 1"),
        "copies",
    )
    kind = F.floor(F.log2("f") * 8).cast("int")
    classes = groups.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect()
    total, lowest = 0, None
    for c in classes:
        total += c["count"]
        if total > most:
            break
        lowest = c.kind
    return groups.filter(F.lit(False) if lowest is None else kind >= lowest).select("digest", "least")


def with_copies(docs: DataFrame, most: int = HEAD_GROUPS) -> DataFrame:
    """``docs`` (id, row, text) with ``copied``, whether its text is one of the frequent ones, and its ``least`` id."""
    head = frequent_copies(docs, most).withColumn("copied", F.lit(True))
    joined = docs.withColumn("digest", digest_of("text")).join(F.broadcast(head), "digest", "left")
    return joined.select("id", "row", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "least")


def one_of_each(told: DataFrame) -> DataFrame:
    """(id, row, text) without the copies of frequent texts but those of the least id."""
    return told.filter(~F.col("copied") | F.col("id").eqNullSafe(F.col("least"))).select("id", "row", "text")


def all_gone(told: DataFrame) -> DataFrame:
    """(id, text, spans) of rows all of whose windows occur elsewhere: one span over everything."""
    return told.select("id", "text", F.array(F.lit((1 << 31) - 1).cast("long")).alias("spans"))
