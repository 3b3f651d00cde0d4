"""Counting pairs of ranked ids by direct address: dense tiles by bincount, the rest as sorted runs."""

from __future__ import annotations

import numpy as np

ID_BITS = 18
TILE_BITS = 9
TILE = 1 << TILE_BITS
# A tile is dense if it gets a pair for every eighth of its cells at least.
DENSE = TILE * TILE // 8


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.append(starts, len(values)))


def count_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``first << ID_BITS | second`` and their counts, each code once.

    Ids are ranks by falling frequency, so most pairs fall into few tiles near the origin; these
    are counted in arrays addressed by the pair itself. Pairs of other tiles are sorted.
    """
    first, second = first.astype(np.int64), second.astype(np.int64)
    tile = (first >> TILE_BITS) << (ID_BITS - TILE_BITS) | second >> TILE_BITS
    crowded = (np.bincount(tile) >= DENSE)[tile] if len(tile) else np.zeros(0, bool)
    low = TILE - 1
    cells = (first & low) << TILE_BITS | second & low
    inside, tiles = cells[crowded], tile[crowded]
    order = np.argsort(tiles, kind="stable")
    inside, tiles = inside[order], tiles[order]
    edges = np.flatnonzero(np.diff(tiles)) + 1
    codes, counts = [], []
    for part, name in zip(np.split(inside, edges), tiles[np.append(0, edges)] if len(tiles) else [], strict=False):
        dense = np.bincount(part, minlength=TILE * TILE)
        cell = np.flatnonzero(dense)
        row = (name >> (ID_BITS - TILE_BITS)) << TILE_BITS | cell >> TILE_BITS
        column = (name & ((1 << (ID_BITS - TILE_BITS)) - 1)) << TILE_BITS | cell & low
        codes.append(row << ID_BITS | column)
        counts.append(dense[cell])
    code, count = _runs(first[~crowded] << ID_BITS | second[~crowded])
    return np.concatenate([*codes, code]), np.concatenate([*counts, count])


def count_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of ids without ranks, and their counts."""
    return _runs(codes)
