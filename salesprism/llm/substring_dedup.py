"""Substring deduplication: a count-min prefilter, then exact groups of what may be repeated.

Rows whose whole text is one of the frequent ones are settled first, see ``whole_copies``.
First pass: partition sketches of two hash rows count the anchor keys of runs of windows (see
``anchors``) and merge into one of bounded size; a key's count is at least that of each of its
windows.
Second pass: only runs of keys estimated repeated are grouped, by their words. Equal runs settle
each other whole. Where a key has different runs, their windows are grouped one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.anchors import Sketch, build_sketch, gram_hashes, runs
from salesprism.llm.common import chunks, read, utf8, written
from salesprism.llm.whole_copies import HEAD_GROUPS, all_gone, one_of_each, with_copies

WINDOW = 35
DEPTH = 2
SECOND_SEED = 1
PART_BYTES = 2 << 20


def _split(window: int) -> tuple[int, int]:
    """Words of a gram and grams of a window: halves of the window."""
    grams = (window + 1) // 2
    return window - grams + 1, grams


def word_runs(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) of the runs of windows; none if there are fewer words than a window."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    units = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for w in words]), ">u8").astype(np.uint64)
    k, grams = _split(window)
    h = gram_hashes(units, k)
    anchors, first, last = runs(h, grams)
    return h[anchors], first, last


def window_hashes(words: list[bytes], window: int) -> np.ndarray:
    """64 bits of each window, of other hashes of its words than the keys are made of."""
    units = np.frombuffer(b"".join([xxhash.xxh3_64_digest(w, SECOND_SEED) for w in words]), ">u8").astype(np.uint64)
    return gram_hashes(units, window).view(np.int64)


def digest(words: list[bytes]) -> bytes:
    """64 bits of the words; with the key of their run, 128 bits stand for them."""
    return blake2b(b" ".join(words), digest_size=8).digest()


def as_longs(digests: list[bytes]) -> pa.Array:
    return pa.array(np.frombuffer(b"".join(digests), "<i8"))


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to a bounded size of text, with the texts of their third column."""
    for batch in batches:
        texts = utf8(batch.column(2))
        for a, b in chunks(map(len, texts), PART_BYTES):
            yield batch.slice(a, b - a), texts[a:b]


def _found(batches, window: int, wanted: Sketch):
    """(batch, [(row, words, first, last, key)]) of the runs whose key may be repeated."""
    for batch, texts in parts_of(batches):
        out = []
        for i, text in enumerate(texts):
            words = text.split()
            keys, first, last = word_runs(words, window)
            at = np.flatnonzero(wanted.repeated(keys))
            cut = zip(first[at].tolist(), last[at].tolist(), keys[at].view(np.int64).tolist(), strict=True)
            out += [(i, words, a, b, k) for a, b, k in cut]
        yield batch, out


def _occurrences(docs: DataFrame, window: int, sent) -> DataFrame:
    """(id, row, key, run, first, last): candidate runs with the digest of their words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _found(batches, window, sent.value):
            rows = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array([f[4] for f in found], pa.int64()),
                    as_longs([digest(f[1][f[2] : f[3] + window]) for f in found]),
                    pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32()),
                ],
                ["id", "row", "key", "run", "first", "last"],
            )

    kind = docs.dtypes[0][1]
    return docs.mapInArrow(run, f"id {kind}, row bigint, key bigint, run bigint, first int, last int")


def _windows(docs: DataFrame, window: int, sent) -> DataFrame:
    """(key, run, windows): runs whose key may have different runs, with their windows' digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _found(batches, window, sent.value):
            each, of, hashes = [], None, None
            for i, words, first, last, _ in found:
                if i != of:
                    of, hashes = i, window_hashes(words, window)
                each.append(hashes[first : last + 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[4] for f in found], pa.int64()),
                    as_longs([digest(f[1][f[2] : f[3] + window]) for f in found]), pa.array(each, pa.binary()),
                ],
                ["key", "run", "windows"],
            )

    return docs.mapInArrow(run, "key bigint, run bigint, windows binary")


def whole_keys(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows sorted by their first column, in lists of whole keys whose last columns are about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= most and row[0] != held[-1][0]:
                yield held
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
    if held:
        yield held


def places_batch(rows: list[tuple], places: list[np.ndarray]) -> pa.RecordBatch:
    """(key, run, places) of the rows that have places."""
    out = [(r[0], r[1], p.astype(np.int32)) for r, p in zip(rows, places, strict=True) if len(p)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
            pa.array([o[2] for o in out], pa.list_(pa.int32())),
        ],
        ["key", "run", "places"],
    )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, run, places): the places of windows that another run of the key has too."""
    for rows in whole_keys(batches, PART_BYTES):
        each = [np.frombuffer(r[2], "<i8") for r in rows]
        lengths = np.array([len(x) for x in each])
        keys, windows = np.repeat(np.array([r[0] for r in rows], np.int64), lengths), np.concatenate(each)
        order = np.lexsort((windows, keys))
        same = (keys[order[1:]] == keys[order[:-1]]) & (windows[order[1:]] == windows[order[:-1]])
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        yield places_batch(rows, [np.flatnonzero(x) for x in np.split(again, np.cumsum(lengths)[:-1])])


def column_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(who, spans), who being id and row: first and end words of repeated windows, for ``docs`` (id, row, text)."""
    spark = docs.sparkSession

    def keys_of(batch):
        for text in utf8(batch.column(2)):
            yield word_runs(text.split(), window)[0]

    candidates = spark.sparkContext.broadcast(build_sketch(docs, keys_of, depth=DEPTH))
    found = written(_occurrences(docs, window, candidates), "found")
    groups = written(found.groupBy("key", "run").agg((F.count("*") > 1).alias("equal")), "runs")
    mixed = spark.sparkContext.broadcast(build_sketch(groups.select("key"), column_keys, depth=DEPTH))
    distinct = _windows(docs, window, mixed).groupBy("key", "run").agg(F.first("windows").alias("windows"))
    some = written(
        distinct.repartition("key").sortWithinPartitions("key", "run").mapInArrow(_shared, "key bigint, run bigint, places array<int>"),
        "shared",
    )
    settled = written(
        groups.join(some, ["key", "run"], "left").filter("equal OR places IS NOT NULL")
        .select("key", "run", F.when(~F.col("equal"), F.col("places")).alias("places")),
        "settled",
    )
    marks = found.join(settled, ["key", "run"]).select(
        "id", "row", F.coalesce(of_places("places", window), of_run(window)).alias("spans")
    )
    return marks.groupBy(F.struct("id", "row").alias("who")).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def of_run(window: int) -> Column:
    """What a whole run of windows covers."""
    return F.array(span(F.col("first"), F.col("last") + window))


def of_places(places: str, window: int) -> Column:
    """What the windows at some places of a run cover."""
    return F.transform(places, lambda p: span(F.col("first") + p, F.col("first") + p + window))


def span(a: Column, b: Column) -> Column:
    """First and end place in the halves of one long."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def covered(spans: pa.ListScalar, n: int, window: int) -> np.ndarray:
    """Flags of the places inside any span; none if there are too few for a window."""
    step = np.zeros(n + 1, np.int32)
    if spans.is_valid and len(spans) and n >= window:
        ends = spans.values.to_numpy()
        np.add.at(step, ends >> 32, 1)
        np.add.at(step, np.minimum(ends & ((1 << 31) - 1), n), -1)
    return np.cumsum(step[:-1]) > 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): row tells rows of one id and different texts apart, where there are any."""
    ids = docs.select(F.col(id_col).alias("id"))
    unique = ids.groupBy("id").count().filter("count > 1").isEmpty()
    row = F.lit(0).cast("long") if unique else F.xxhash64(text_col)
    return docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))


def with_spans(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, text, spans) of every row; the one shuffle of the text. Null ids within ``who`` are equal."""
    return docs.withColumn("who", F.struct("id", "row")).join(marks, "who", "left").select("id", "text", "spans")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    copy_groups: int = HEAD_GROUPS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): ``text`` is the kept words joined by one space.

    A word goes if a window of ``window`` consecutive words of its document covers it whose words
    also start at another place, in any document; windows are judged on the input. Words end
    at ASCII blanks and are compared as they are. Null, empty and short texts lose nothing.
    Every row is a document, so a repeated row loses what its copy holds; ids may repeat or be
    null. Other columns are not read.

    Rows of the largest groups of equal texts, at most ``copy_groups`` of them and known by SHA-256,
    lose all their windows at once; one of each meets the other texts in their stead.

    The sketches have a fixed size and only overestimate: crowded, they let more runs through to
    the exact groups. Groups are pre-aggregated; joins with the settled runs have plain rows on
    both sides and are split when a run is hot.
    """
    told = with_copies(keyed(docs, id_col, text_col), copy_groups)
    others = told.filter(~F.col("copied")).select("id", "row", "text")
    marked = with_spans(others, repeated_windows(one_of_each(told), window))
    joined = marked.unionByName(all_gone(told.filter("copied")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                words = text.split()
                gone = covered(spans, len(words), window)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "text"],
            )

    kind = dict(docs.dtypes)[id_col]
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def op2_substring_dedup(spark, sf_dir):
    out = remove_repeated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
