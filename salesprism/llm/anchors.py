"""Anchored runs of windows, and bounded count-min sketches of their keys.

Long windows of a sequence are grouped by an anchor: of the grams a window holds, the leftmost
of least hash. Neighbouring windows mostly share their anchor, so a run of windows is one
record. Equal windows have the same anchor at the same place within them and hence the same
key, so the number of runs with a key is at least the number of times each window occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STRIP = 64
SKETCH_BITS = 27
SKETCH_BLOCKS = 128
_FLUSH = 4_000_000


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive 64-bit units, from those of powers of two."""
    have, power, step, done = units, _ODD, 1, None
    size = 0
    while True:
        if k & step:
            if done is None:
                done, size = have, step
            else:  # what there is, then this power of two behind it
                n = len(units) - size - step + 1
                done = done[:n] * power + have[size : size + n]
                size += step
        if step * 2 > k:
            return mix(done[: len(units) - k + 1])
        have = have[:-step] * power + have[step:]
        with np.errstate(over="ignore"):  # arithmetic modulo 2**64
            power = power * power
        step *= 2


def runs(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the runs of windows that share an anchor.

    A window is ``w`` grams. Windows are taken in strips of 64: within a strip as many low bits of
    a hash as its places need give way to the place, and the least of them is the leftmost anchor.
    """
    n = len(h) - w + 1
    strips = -(-n // _STRIP)
    width = _STRIP + w - 1
    padded = np.full(strips * _STRIP + w - 1, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    low = np.uint64((1 << (width - 1).bit_length()) - 1)
    m = np.lib.stride_tricks.as_strided(padded, (strips, width), (8 * _STRIP, 8))
    m = (m & ~low) | np.arange(width, dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        m = np.minimum(m[:, : m.shape[1] - size], m[:, size:])
        size *= 2
    m = np.minimum(m[:, :_STRIP], m[:, w - size : w - size + _STRIP])
    place = ((m & low).astype(np.int64) + (np.arange(strips) * _STRIP)[:, None]).ravel()[:n]
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    last = np.concatenate([first[1:], [n]]) - 1
    return place[first], first, last


def cells_of(keys: np.ndarray, bits: int, row: int) -> np.ndarray:
    """The cell of each key in a hash row, counted over all rows."""
    own = keys if row == 0 else mix(keys ^ (_ODD * np.uint64(row)))
    return (own >> np.uint64(64 - bits)).astype(np.int64) + (row << bits)


def byte_planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, lowest bytes first: the planes of small numbers are zeros, which compress."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_byte_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Sketch:
    """Which keys are estimated to occur twice or more: a bit for each cell of each hash row.

    The estimate of a key is the least of its cells, one in each row.
    """

    def __init__(self, bits: int, cells: np.ndarray, depth: int):
        self.bits, self.cells, self.depth = bits, cells, depth

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row in range(self.depth):
            cell = cells_of(keys, self.bits, row)
            out &= (self.cells[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        return out


def bits_for(keys: int) -> int:
    """Bits of a sketch for so many keys: 32 cells and more a key, within the size for any number."""
    return min(SKETCH_BITS, max(16, (32 * keys).bit_length()))


def build_sketch(
    rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = SKETCH_BITS,
    blocks: int = SKETCH_BLOCKS, depth: int = 1,
) -> Sketch:
    """The merged sketch of all partitions' keys: ``depth`` rows of 2**bits bits whatever the data.

    A partition's sketch is the cells it counted once and more than once, delta-coded and cut
    into blocks; blocks merge by addition, streamed into one array each. A crowded sketch
    estimates too many keys repeated, and never too few. The merged bits, ``depth`` * 2**bits / 8
    bytes, pass the driver.
    """
    per, blocks = (1 << bits) // blocks, blocks * depth

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sketch(parts):
            cells, counts = np.unique(np.concatenate(parts), return_counts=True)
            edges = np.searchsorted(cells, np.arange(blocks + 1, dtype=np.int64) * per)
            out = []
            for b in range(blocks):
                own, more = cells[edges[b] : edges[b + 1]], counts[edges[b] : edges[b + 1]] > 1
                if len(own):
                    own = own - b * per
                    out.append((b, byte_planes(np.diff(own, prepend=0)), np.packbits(more).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
                ["block", "cells", "more"],
            )

        parts, held = [], 0
        for batch in batches:
            for keys in keys_of(batch):
                parts += [cells_of(keys, bits, row) for row in range(depth)]
                held += len(keys) * depth
                if held >= _FLUSH:
                    yield sketch(parts)
                    parts, held = [], 0
        if parts:
            yield sketch(parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, cells, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.cumsum(from_byte_planes(cells), dtype=np.int64)
                add = 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(at))
                have = seen.setdefault(b, np.zeros(per, np.uint8))
                have[at] = np.minimum(have[at] + add, 2)
        for b, have in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([np.packbits(have > 1).tobytes()], pa.binary())], ["block", "bits"]
            )

    partial = rows.mapInArrow(count, "block int, cells binary, more binary")
    merged = partial.repartition("block").mapInArrow(merge, "block int, bits binary")
    cells = np.zeros((depth << bits) // 8, np.uint8)
    for row in merged.toLocalIterator():
        cells[row.block * per // 8 : (row.block + 1) * per // 8] = np.frombuffer(row.bits, np.uint8)
    return Sketch(bits, cells, depth)
