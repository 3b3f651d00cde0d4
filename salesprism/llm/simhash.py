"""SimHash near-duplicates: fingerprints, a popcount embedding, a grid join, exact links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesprism.llm.common import connected_components, in_few, read, utf8, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 32  # two bits each: a popcount of 0, 1 or 2
LIGHT = 64  # members of a cell up to which its pairs are listed
MAX_GRIDS = 128
SHARD = 1 << 18  # points of a shard; shards are compared two by two
SPREAD = 8  # shards of smaller tables, so that the comparisons are spread
_BLOCK_ROWS = 1 << 16
_COMPARED = 1 << 17


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 hashes of the word shingles, repeats included, as rows of 8 bytes."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.zeros((0, 8), np.uint8)
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half of the XXH64 hashes of the word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK_ROWS):
        ones += np.unpackbits(hashes[at : at + _BLOCK_ROWS], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row: whole texts, batch by batch, nothing shuffled."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp bigint")


def embedding(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, in the segments' places."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseXOR(high).bitwiseAND(low)
    two = fp.bitwiseAND(high).bitwiseAND(low)
    return one.bitwiseOR(F.shiftleft(two, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Sum of the differences of the segments' popcounts; at most the Hamming distance."""
    def part(x, i):
        return F.shiftrightunsigned(x, 2 * i).bitwiseAND(F.lit(3))

    return sum((F.abs(part(a, i) - part(b, i)) for i in range(SEGMENTS)), F.lit(0))


def _masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of the embedding that leave out ``max_bits`` of ``blocks`` runs of segments."""
    edges = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    runs = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(runs, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def blocks_for(n: int, max_bits: int) -> int:
    """Blocks such that a fingerprint meets a few chance candidates among ``n``.

    Two random popcounts of two bits agree with probability 3/8.
    """
    blocks = max_bits + 2
    while blocks < 16 and n * len(_masks(blocks, max_bits)) * 0.375 ** (SEGMENTS * (1 - max_bits / blocks)) > 4:
        blocks += 1
    return blocks


def grids_serve(n: int, max_bits: int, light: int) -> bool:
    """Whether the grids of ``links`` are few and give a point few chance candidates among ``n``."""
    blocks = blocks_for(n, max_bits)
    grids = comb(blocks, max_bits)
    return max_bits <= 2 or (grids <= MAX_GRIDS and n * grids * 0.375 ** (SEGMENTS * (1 - max_bits / blocks)) <= light)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of the first column, by which they are sorted."""
    held, at = [], None
    for batch in batches:
        cell = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                if held and cell[a] != at:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = int(cell[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of all values at ``max_bits`` or fewer differing bits."""
    step = max(1, _COMPARED // max(1, len(b)))
    xor, bits = np.empty((step, len(b)), np.uint64), np.empty((step, len(b)), np.uint8)
    for at in range(0, len(a), step):
        part = a[at : at + step]
        np.bitwise_xor(part[:, None], b, out=xor[: len(part)])
        np.bitwise_count(xor[: len(part)], out=bits[: len(part)])
        hits = np.flatnonzero(bits[: len(part)] <= max_bits)
        if len(hits):
            yield hits // len(b) + at, hits % len(b)


def close_pairs(points: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(src, dst): all pairs of the column fp of ``points`` within ``max_bits`` bits.

    Exact for any ``max_bits``. The ``n`` points are dealt to shards of bounded size and every two
    shards meet in a cell, so no task holds more than two shards; the work is the square of ``n``.
    Radii of up to two bits, the operator's default, never come here.
    """
    shards = max(-(-n // SHARD), min(SPREAD, -(-n // 4096)), 1)
    own = F.pmod(F.xxhash64("fp"), F.lit(shards))
    dealt = points.select("fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("other")).select(
        (F.least("own", "other") * shards + F.greatest("own", "other")).cast("long").alias("cell"),
        (F.col("own") > F.col("other")).alias("second"), "fp",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _cells(batches):
            second, fp = rows["second"].to_numpy(), rows["fp"].to_numpy()
            within = cell // shards == cell % shards
            left = np.arange(len(fp)) if within else np.flatnonzero(~second)
            right = left if within else np.flatnonzero(second)
            for i, j in _close(fp[left].view(np.uint64), fp[right].view(np.uint64), max_bits):
                some = i < j if within else np.ones(len(i), bool)
                a, b = fp[left[i[some]]], fp[right[j[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])

    parts = min(shards * (shards + 1) // 2, 4096)
    return dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "src bigint, dst bigint")


def links(fps: DataFrame, n: int, max_bits: int = MAX_BITS, light: int = LIGHT) -> DataFrame:
    """Edges (src, dst) that connect exactly the ``fps`` at ``max_bits`` or fewer differing bits.

    ``fps`` holds distinct values in column fp. In the embedding two linked points are within
    Manhattan distance ``max_bits``, so of any ``max_bits + 2`` or more blocks of coordinates
    they share all but ``max_bits``: each combination of blocks is a grid, and linked points
    share a cell of one of them. In a cell of up to ``light`` members the pairs are joined, kept
    by Manhattan distance and verified by the differing bits. Larger cells list no pairs: their
    members meet at the values within one bit of each. Two values are at most two bits apart if
    and only if they share such a value; a value has at most 65 members, chained to the first.
    That holds for two bits: for any other ``max_bits`` the members of larger cells are compared
    in shards of bounded size, and all points are where grids would list too many pairs.
    """
    if not grids_serve(n, max_bits, light):
        return close_pairs(fps, n, max_bits)
    masks = _masks(blocks_for(n, max_bits), max_bits)
    cells = fps.select(
        "fp",
        F.explode(
            F.array(*[
                F.struct(F.lit(i).alias("grid"), embedding(F.col("fp")).bitwiseAND(F.lit(m)).alias("cell"))
                for i, m in enumerate(masks)
            ])
        ).alias("at"),
    ).select("fp", "at.grid", "at.cell")
    several = cells.groupBy("grid", "cell").agg(F.count("*").alias("members")).filter("members > 1")
    sizes = written(in_few(several, n * len(masks) // 2), "cells")
    shared = written(in_few(cells.join(sizes, ["grid", "cell"]), n * len(masks)), "shared")
    small = shared.filter(F.col("members") <= light)
    left = small.select("grid", "cell", F.col("fp").alias("src"))
    right = small.select("grid", "cell", F.col("fp").alias("dst"))
    near = (
        left.join(right, ["grid", "cell"]).filter("src < dst")
        .filter(manhattan(embedding(F.col("src")), embedding(F.col("dst"))) <= max_bits)
        .filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)
        .select("src", "dst").distinct()
    )
    crowded = shared.filter(F.col("members") > light).select("fp").distinct()
    if max_bits != 2:
        crowded = written(crowded, "crowded")
        return near.union(close_pairs(crowded, crowded.count(), max_bits)).distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(64)])
    met = (
        crowded.select("fp", F.explode(flips).alias("centre"))
        .groupBy("centre").agg(F.sort_array(F.collect_list("fp")).alias("members"))
        .filter(F.size("members") > 1)
        .select(F.col("members")[0].alias("src"), F.explode(F.slice("members", 2, 64)).alias("dst"))
        .distinct()
    )
    return near.union(met)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    light: int = LIGHT,
) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over linked rows.

    Texts are lower-cased (A-Z); words end at ASCII blanks. Fewer words than a shingle make one
    shingle; null, empty and blank texts have fingerprint zero and are linked like any other.
    Rows of equal fingerprint are one node however many they are, so a large group of copies
    costs one aggregate row per partition. Repeated rows stay. A null id takes part and is
    never the smallest; if all ids of a component are null so is component_id. Other columns
    of ``docs`` are not read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rows = fps.count()
    nodes = written(in_few(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), rows), "nodes")
    n = nodes.count()
    labels = connected_components(links(nodes.select("fp"), n, max_bits, light))
    grouped = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label")
    )
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    names = written(in_few(grouped.join(smallest, "label").select("fp", "component_id"), n), "components")
    return in_few(fps.join(names, "fp").select("doc_id", "fp", "component_id"), rows)


def op8_simhash(spark, sf_dir):
    out = simhash_components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
