"""Exact deduplication by refinement: equal lengths, then equal heads, then equal full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import private_names, read, written

HEAD_CHARS = 256
SIEVE_CELLS = 1 << 20
HEAVY = 1000
WORD_BITS = 64


def sieve(keys: DataFrame, key: str, most_cells: int = SIEVE_CELLS) -> tuple[DataFrame, int]:
    """A table (cell, word) of the values of the long column ``key``, and its number of cells.

    It never misses a value. A bit for each key in at most ``most_cells`` words, about four keys to a word as long as that
    is enough. The bound holds for any input, so the result may be broadcast; beyond it more
    keys pass that do not occur.
    """
    n = keys.count()
    cells = 1
    while cells < min(n // 4, most_cells):
        cells *= 2
    one = F.expr(f"shiftleft(1L, cast(pmod({key} div {cells}, {WORD_BITS}) as int))")
    marked = keys.select(F.expr(f"pmod({key}, {cells}L)").alias("cell"), one.alias("bit"))
    return marked.groupBy("cell").agg(F.bit_or("bit").alias("word")), cells


def sieve_hit(key: str, word: str, cells: int) -> Column:
    return F.expr(f"(shiftright({word}, cast(pmod({key} div {cells}, {WORD_BITS}) as int)) & 1L) = 1L")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_chars: int = HEAD_CHARS,
    sieve_cells: int = SIEVE_CELLS,
    heavy: int = HEAVY,
) -> DataFrame:
    """``docs`` with keep_id, group_size and kept: of equal texts the row with the largest id stays.

    Null text counts as empty, so null and empty texts are equal. A null id is smaller than any
    other; a group of null ids only has a null ``keep_id``. Of rows that share text and the largest
    id one stays, any of them. Other columns stay, whatever their names, save the three new ones,
    which are replaced. A table without rows gives none.

    Byte lengths are counted first, then (length, hash of the head) among lengths that occur twice,
    then SHA-256 of whole texts whose length and head may occur twice. What survives the second
    step reaches the rows as a sieve of bounded size, so no text is shuffled to be hashed; the
    digests alone decide. All counts are combined before their shuffle. Groups with more than
    a ``heavy``-th of all rows, fewer than ``heavy`` of them, are broadcast, and their rows spread
    by id; the others are joined by digest.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    _ = private_names(docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size, head, key, digest = _("size"), _("head"), _("key"), _("digest")

    rows = docs.withColumn(size, F.octet_length(text))
    lengths = written(rows.groupBy(size).agg(F.count("*").alias("rows")), "lengths")
    total = lengths.agg(F.sum("rows")).first()[0] or 0
    shared = lengths.filter("rows > 1").select(size)

    headed = rows.withColumn(head, F.xxhash64(F.substring(text, 1, head_chars)))
    heads = headed.join(shared, size, "left_semi").groupBy(size, head).agg(F.count("*").alias("rows")).filter("rows > 1")
    heads = written(heads.select(F.xxhash64(size, head).alias(key)), "heads")

    marks, cells = sieve(heads, key, sieve_cells)
    hashed = (
        headed.withColumn(key, F.xxhash64(size, head))
        .withColumn(_("cell"), F.expr(f"pmod({key}, {cells}L)"))
        .join(F.broadcast(marks.toDF(_("cell"), _("word"))), _("cell"), "left")
        .withColumn(digest, F.when(sieve_hit(key, _("word"), cells), F.sha2(text, 256)))
    )
    held = (
        hashed.filter(F.col(digest).isNotNull())
        .groupBy(digest, F.col(f"`{id_col}`").alias(_("id"))).agg(F.count("*").alias(_("rows")))
    )
    last = F.max(F.struct(F.col(_("id")).isNotNull(), _("id"), _("rows"))).alias(_("last"))
    groups = held.groupBy(digest).agg(last, F.sum(_("rows")).alias(_("n"))).filter(f"{_('n')} > 1")
    groups = written(
        groups.select(digest, _("n"), F.col(_("last"))[_("id")].alias(_("keep")), F.col(_("last"))[_("rows")].alias(_("times"))),
        "groups",
    )
    return _labelled(docs, hashed, groups, id_col, _, total // heavy)


def _labelled(docs, hashed, groups, id_col, _, bound):
    """The rows with their group, if they have one."""
    digest, group = _("digest"), F.struct(_("n"), _("keep"), _("times"))
    many = groups.filter(F.col(_("n")) > bound).select(digest, group.alias(_("many")))
    few = groups.filter(F.col(_("n")) <= bound).select(F.col(digest).alias(_("at")), group.alias(_("few")))
    # A row without a digest, or of a group already known, goes where no group has its key.
    own = F.concat_ws("-", F.col(_("key")).cast("string"), F.col(f"`{id_col}`").cast("string"))
    rows = hashed.join(F.broadcast(many), digest, "left").withColumn(
        _("at"), F.when(F.col(digest).isNotNull() & F.col(_("many")).isNull(), F.col(digest)).otherwise(own)
    )
    rows = rows.join(few, _("at"), "left").withColumn(_("group"), F.coalesce(_("many"), _("few")))
    found = F.col(_("group"))
    row_id = F.col(f"`{id_col}`")
    stays = found.isNull() | row_id.eqNullSafe(found[_("keep")])
    repeated = F.coalesce(stays & (found[_("times")] > 1), F.lit(False))

    def result(table, kept):
        return table.select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.when(found.isNull(), row_id).otherwise(found[_("keep")]).alias("keep_id"),
            F.coalesce(found[_("n")], F.lit(1)).cast("long").alias("group_size"),
            kept.alias("kept"),
        )

    if groups.filter(F.col(_("times")) > 1).isEmpty():
        return result(rows, stays)
    turn = F.row_number().over(Window.partitionBy(digest).orderBy(F.lit(1)))
    twice = rows.filter(repeated).withColumn(_("turn"), turn)
    return result(rows.filter(~repeated), stays).unionByName(result(twice, F.col(_("turn")) == 1))


def op12_exact_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
