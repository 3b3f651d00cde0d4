"""Benchmark decontamination by a distributed positional inverted index.

The index is a written table of segments. A segment holds some documents: their lengths, and
for each term the sorted places where it stands. A phrase is matched in a segment by
intersecting the place lists of its terms, each shifted by the term's offset, from the
segment's rarest term on. The test set visits every segment, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import WIDE_ROWS, chunks, read, utf8, written

WINDOW = 10
BLOCK_BYTES = 4 << 20
SEGMENT_BYTES = 4 << 20
# Bytes of words are 0-9, a-z and all above ASCII; A-Z become a-z, the rest ends a word.
_WORD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Segment:
    """Positional postings over the words of some documents; places count through all of them."""

    def __init__(self, lengths: np.ndarray, terms: pa.Array, counts: np.ndarray, places: np.ndarray):
        self.lengths, self.terms, self.places = lengths, terms, places
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    @classmethod
    def of(cls, texts: list[bytes]) -> Segment:
        terms: dict[bytes, int] = {}
        lengths, ids = [], []
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            ids.append(np.fromiter([terms.setdefault(w, len(terms)) for w in words], np.int32, len(words)))
        ids = np.concatenate([np.zeros(0, np.int32), *ids])
        return cls(
            np.array(lengths, np.int32), pa.array(list(terms), pa.binary()),
            np.bincount(ids, minlength=len(terms)).astype(np.int32), np.argsort(ids, kind="stable").astype(np.int32),
        )

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The segment's numbers of ``terms``; -1 for those it lacks."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def count(self, numbers: np.ndarray) -> np.ndarray:
        return np.where(numbers < 0, 0, self.bounds[numbers + 1] - self.bounds[numbers])

    def postings(self, number: int) -> np.ndarray:
        return self.places[self.bounds[number] : self.bounds[number + 1]] if number >= 0 else self.places[:0]

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")

    def phrase(self, numbers: np.ndarray) -> np.ndarray:
        """(start, end) of the places where the terms stand one after another in one document."""
        order = np.argsort(self.count(numbers), kind="stable")
        starts = self.postings(numbers[order[0]]).astype(np.int64) - order[0]
        for i in order[1:]:
            there = self.postings(numbers[i])
            if not len(starts) or not len(there):
                return np.zeros((0, 2), np.int64)
            at = np.minimum(np.searchsorted(there, starts + i), len(there) - 1)
            starts = starts[there[at] == starts + i]
        ends = starts + len(numbers)
        whole = self.owner(starts) == self.owner(ends - 1)
        return np.stack([starts[whole], ends[whole]], axis=1)

    def near(self, numbers: np.ndarray, slop: int) -> np.ndarray:
        """(start, end) of the places where the terms stand in order with up to ``slop`` words between.

        For each place of the rarest term, every place of the first term within reach is tried.
        Inner terms are taken at their next place, the last one at every place within reach.
        """
        rare = int(np.argmin(self.count(numbers)))
        found = set()
        for anchor in self.postings(numbers[rare]).tolist():
            document = int(self.owner(np.array([anchor]))[0])
            low = max(anchor - rare - slop, int(self.ends[document]) - int(self.lengths[document]))
            firsts = self.postings(numbers[0])
            for first in firsts[np.searchsorted(firsts, low) : np.searchsorted(firsts, anchor, side="right")].tolist():
                place, beyond = first, min(first + len(numbers) + slop, int(self.ends[document]))
                for number in numbers[1:-1]:
                    there = self.postings(number)
                    at = np.searchsorted(there, place, side="right")
                    place = int(there[at]) if at < len(there) else beyond
                    if place >= beyond:
                        break
                last = self.postings(numbers[-1]) if len(numbers) > 1 else np.array([first])
                after = np.searchsorted(last, place, side="right") if len(numbers) > 1 else 0
                found.update((first, int(end) + 1) for end in last[after : np.searchsorted(last, beyond)])
        return np.array(sorted(found), np.int64).reshape(-1, 2)


def build_index(docs: DataFrame, keep: tuple[str, ...], text_col: str, segment_bytes: int) -> DataFrame:
    """The written index: a row for each segment, with the ``keep`` columns of its documents.

    Segments follow the partitions of ``docs``: nothing is shuffled. A longer document is a
    segment of its own. A few segments make a row group, however many a task writes.
    """
    given = docs.select(*[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(text_col).alias("text_"))
    kept = ", ".join(f"{name} array<{kind}>" for name, kind in given.dtypes[:-1])

    def lists(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(len(keep)))
            for a, b in chunks(map(len, texts), segment_bytes):
                s = Segment.of(texts[a:b])
                counts = (s.bounds[1:] - s.bounds[:-1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    lists([batch.column(i).slice(a, b - a) for i in range(len(keep))])
                    + lists([pa.array(s.lengths), s.terms, pa.array(counts)])
                    + [pa.array([s.places.astype("<i4").tobytes()], pa.binary())],
                    [f"keep_{i}" for i in range(len(keep))] + ["lengths", "terms", "counts", "places"],
                )

    schema = f"{kept}, lengths array<int>, terms array<binary>, counts array<int>, places binary"
    return written(given.mapInArrow(run, schema), "index", WIDE_ROWS)


def item_windows(text: bytes, window: int) -> list[tuple[bytes, ...]]:
    """The windows of an item; fewer words, but not none, are one window."""
    words = words_of(text)
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The test set row by row in blocks of about ``most`` bytes; an empty one gives one empty block."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    block, size = [], 0
    for name, text in rows.toLocalIterator():
        data = text.encode()
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append((name, data))
        size += len(data)
    yield block


def _compiled(block: Iterable[tuple[str, bytes]], window: int) -> tuple[list[bytes], dict[int, tuple], list[list[str]]]:
    """Terms, windows by their length as (term numbers, window numbers), and each window's items."""
    terms: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for name, text in block:
        for w in item_windows(text, window):
            windows.setdefault(tuple(terms.setdefault(x, len(terms)) for x in w), set()).add(name)
    by_length: dict[int, tuple[list, list]] = {}
    for number, key in enumerate(windows):
        group = by_length.setdefault(len(key), ([], []))
        group[0].append(key)
        group[1].append(number)
    arrays = {n: (np.array(keys, np.int64), numbers) for n, (keys, numbers) in by_length.items()}
    return list(terms), arrays, [sorted(x) for x in windows.values()]


def _search(segment: Segment, terms: pa.Array, windows: dict[int, tuple], holders: list[list[str]], slop: int):
    """For each document of the segment the hit places, from its start, and the items."""
    numbers = segment.numbers(terms)
    spans, items = [], [set() for _ in segment.lengths]
    for keys, names in windows.values():
        local = numbers[keys]
        for row in np.flatnonzero(segment.count(local).min(axis=1) > 0):
            found = segment.near(local[row], slop) if slop else segment.phrase(local[row])
            if len(found):
                spans.append(found)
                for document in np.unique(segment.owner(found[:, 0])).tolist():
                    items[document].update(holders[names[row]])
    step = np.zeros(int(segment.ends[-1]) + 1 if len(segment.ends) else 1, np.int32)
    for found in spans:
        np.add.at(step, found[:, 0], 1)
        np.add.at(step, found[:, 1], -1)
    hit = np.flatnonzero(np.cumsum(step) > 0)
    starts = segment.ends - segment.lengths
    cuts = np.searchsorted(hit, np.concatenate([starts, segment.ends[-1:]]))
    return [(hit[cuts[i] : cuts[i + 1]] - starts[i]).tolist() for i in range(len(starts))], [sorted(x) for x in items]


def matches(
    docs: DataFrame,
    items: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_bytes: int = BLOCK_BYTES,
    segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """``keep`` of every document with n_words, hits (places of hit words) and items (sorted ids).

    A word of a document is hit if it lies inside an occurrence of a window of an item: an exact
    phrase, or with ``slop`` > 0 the terms in order with up to that many words between them.
    Null and empty texts have no words and no hits. A null item id reads as the empty string;
    rows of one item id are one item. Repeated documents are each judged. An empty test set
    hits nothing, an empty corpus gives no rows. Other columns are not read.

    Documents are neither shuffled nor collected. The test set passes the driver in blocks of
    ``block_bytes``, each broadcast alone; with more than one, the hits meet per document.
    """
    index = build_index(docs, keep, text_col, segment_bytes)
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"keep_{i} {kinds[c]}" for i, c in enumerate(keep))
    schema += ", segment bigint, place int, n_words bigint, hits array<int>, items array<string>"
    index = index.withColumn("segment", F.monotonically_increasing_id())
    names = [f"keep_{i}" for i in range(len(keep))]

    def searched(block):
        sent = spark.sparkContext.broadcast(_compiled(block, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, windows, holders = sent.value
            terms = pa.array(terms, pa.binary())
            for batch in batches:
                for row in range(batch.num_rows):
                    def cell(name, row=row, batch=batch):
                        return batch.column(batch.schema.get_field_index(name))[row]

                    segment = Segment(
                        cell("lengths").values.to_numpy(), cell("terms").values.cast(pa.binary()),
                        cell("counts").values.to_numpy(), np.frombuffer(cell("places").as_py(), "<i4"),
                    )
                    hits, found = _search(segment, terms, windows, holders, slop)
                    n = len(segment.lengths)
                    yield pa.RecordBatch.from_arrays(
                        [cell(name).values for name in names]
                        + [
                            pa.array([cell("segment").as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()),
                            pa.array(segment.lengths.astype(np.int64)), pa.array(hits, pa.list_(pa.int32())),
                            pa.array(found, pa.list_(pa.string())),
                        ],
                        [*names, "segment", "place", "n_words", "hits", "items"],
                    )

        return index.mapInArrow(run, schema)

    parts = [searched(block) for block in item_blocks(items, item_id, item_text, block_bytes)]
    out = parts[0]
    if len(parts) > 1:
        out = reduce(DataFrame.union, parts).groupBy(*names, "segment", "place", "n_words").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "n_words", "hits", "items")


def op3_decontaminate(spark, sf_dir):
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
