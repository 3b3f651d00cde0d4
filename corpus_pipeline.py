"""A cleaning pipeline over ``documents``: quality, lines, near duplicates, benchmark, packing.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last
return the columns of ``documents``. Rows are told apart by their id and text, so null ids and
ids given twice are handled; a table without rows stays without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesprism.llm.common import read, written
from salesprism.llm.decontaminate import matches
from salesprism.llm.line_dedup import drop_repeated_lines
from salesprism.llm.packing import pack_documents
from salesprism.llm.quality import quality_rules
from salesprism.llm.simhash import simhash_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but the rows whose id and text hash stand in ``rejected`` (doc_id, row)."""
    gone = rejected.select(F.col("doc_id").alias("id_"), F.col("row").alias("row_")).distinct()
    here = docs.doc_id.eqNullSafe(gone.id_) & (F.xxhash64(docs.text) == gone.row_)
    return docs.join(gone, here, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = docs.select(*COLUMNS)
    judged = quality_rules(docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("row"), "text"))
    return _without(docs, judged.filter("NOT kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars counts what is left."""
    left = drop_repeated_lines(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id (null last) and text hash.

    Linked are documents whose fingerprints of word triples differ in two bits or fewer: the shingle
    length and the bits of the operator's contract.
    """
    docs = docs.select(*COLUMNS)
    row = F.xxhash64("text").alias("row")
    name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row).alias("name")
    first = simhash_components(docs.select(name, "text"), "name").select("component_id").distinct().select(
        F.col("component_id.doc_id").alias("id_"), F.col("component_id.row").alias("row_")
    )
    here = docs.doc_id.eqNullSafe(first.id_) & (F.xxhash64(docs.text) == first.row_)
    kept = docs.join(first, here, "left_semi")
    # Rows of the same id and text are one component; only they are still there more than once.
    repeated = docs.groupBy("doc_id", row).count().filter("count > 1")
    return kept if repeated.isEmpty() else kept.withColumn("row", row).dropDuplicates(["doc_id", "row"]).drop("row")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    docs = docs.select(*COLUMNS)
    found = matches(docs.withColumn("row", F.xxhash64("text")), read(spark, sf_dir, "benchmark"), keep=("doc_id", "row"))
    return _without(docs, found.filter(F.size("hits") > 0))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences."""
    return pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", packing),
]
# SQL can express neither the robust estimates nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
