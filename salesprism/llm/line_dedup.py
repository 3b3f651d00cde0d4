"""Line deduplication: explode, hash, count documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import BLANKS, ascii_lower, read, sealed
from salesprism.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_digest(line: Column, min_chars: int) -> Column:
    """128 bits of the line's key; null for keys too short to count."""
    key = line_key(line)
    return F.when(F.char_length(F.btrim(line, F.lit(BLANKS))) >= min_chars, F.unhex(F.md5(key)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the lines that stay in ``text_col`` and new columns n_lines and n_dropped.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points in at least ``min_docs`` documents stays only in the document with
    the largest id that holds it, there with all its lines.

    Null or empty text is one empty line; the result is then the empty text. Rows that share an
    id are one document when documents are counted and each keep their row. A null id counts as
    one document that never has the largest id, unless no other id holds the key. Other columns
    stay, whatever their names, save ``n_lines`` and ``n_dropped``, which are replaced.

    Keys meet as 128-bit digests. A key's documents are distinct per digest before they are
    counted (two-step aggregate, both steps combined before the shuffle), so one line held by
    a third of the documents is no hot task. The text is shuffled once, for the last join.
    """
    docs, given = sealed(docs.drop("n_lines", "n_dropped"))
    id_col, text_name = given[id_col], given[text_col]
    text = F.col(text_name)
    held = docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(text).alias("_text"),
        F.posexplode(F.transform(lines_of(text), lambda x: line_digest(x, min_chars))).alias("_pos", "_key"),
    ).filter("_key IS NOT NULL")
    # count_distinct leaves a null id out; the flag counts it.
    frequent = cut_lineage(
        held.groupBy("_key")
        .agg(F.count_distinct("_id").alias("_n"), F.max("_id").alias("_last"), F.max(F.col("_id").isNull()).alias("_null"))
        .filter(F.col("_n") + F.col("_null").cast("int") >= min_docs)
        .select("_key", "_last")
    )
    dropped = (
        held.join(frequent, "_key")
        .filter(~F.col("_id").eqNullSafe(F.col("_last")))
        .groupBy(F.col("_id").alias("_in"), F.col("_text").alias("_as")).agg(F.collect_set("_pos").alias("_gone"))
    )
    # Rows with one id and other texts have positions of their own.
    joined = docs.withColumns({"_id": F.col(id_col), "_text": F.xxhash64(text)}).join(
        dropped, F.col("_id").eqNullSafe(F.col("_in")) & (F.col("_text") == F.col("_as")), "left"
    )
    lines = F.col("_lines")
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col("_gone").isNull(), lines).otherwise(
        F.transform(F.array_except(places, F.col("_gone")), lambda i: F.get(lines, i))
    )
    out = joined.withColumn("_lines", lines_of(text)).withColumn("_kept", kept)
    columns = {c: F.col(g).alias(c) for c, g in given.items()} | {text_col: F.array_join("_kept", "\n").alias(text_col)}
    return out.select(
        *columns.values(),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.last AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
