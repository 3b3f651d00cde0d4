"""Whitening against numpy's eigendecomposition, and spectrum slicing by itself."""

import math

import numpy as np
import pytest

from salesprism.llm.spectrum import leading, positive_pivots
from salesprism.llm.whitening import whitened

SCHEMA = "vec_id bigint, embedding array<float>, label int, _x string"


def rows():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1]) + 4
    out = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    out += [(500, out[3][1]), (500, out[3][1]), (None, out[4][1])]
    bad = [None, [], [1.0] * 5, [float("nan")] + [0.0] * 5, [float("inf")] + [0.0] * 5, [None] + [0.0] * 5, [1e30] * 6]
    return out, [(900 + i, b) for i, b in enumerate(bad)]


@pytest.mark.parametrize("parts", [1, 7])
def test_op13_whitens(spark, parts):
    good, bad = rows()
    table = spark.createDataFrame([(i, e, 1, "c") for i, e in good + bad], SCHEMA).repartition(parts)
    got = whitened(table, keep=("vec_id", "_x"), components=4).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in e] for _, e in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.float64)
    n = len(fit)
    s = [int(c) for c in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    want = {}
    for (i, _), row in zip(good, x, strict=True):
        deviation = sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))
        z = (np.array(row) - fit.mean(axis=0)) @ q / np.sqrt(e)
        for k in range(4):
            want.setdefault((i, k + 1), []).append((deviation, abs(z[k])))
    assert len(got) == 4 * len(good)
    for r in got:
        assert any(r.deviation == d and math.isclose(abs(r.whitened), z, rel_tol=1e-6, abs_tol=1e-8) for d, z in want[r.vec_id, r.component])
        assert (r.n, r["_x"]) == (n, "c") and r.identity_error < 1e-9
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)


def test_op13_without_variance(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 1, ""), (2, [1.0, 2.0], 1, "")], SCHEMA)
    assert whitened(same).count() == 0
    assert whitened(same.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 1, "") for i in range(9)], SCHEMA)
    assert {(r.component, r.n) for r in whitened(line).collect()} == {(1, 9)}


def test_op13_exact_beyond_64_bits(spark):
    big = [(i, [float(v), float(-v), 1.0]) for i, v in enumerate([0, 2**40, 2**41 + 3, -(2**40)])]
    table = spark.createDataFrame([(i, e, 1, "") for i, e in big], "vec_id bigint, embedding array<double>, label int, _x string")
    x = [[math.floor(64 * c) + 1_000_000 for c in e] for _, e in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((4 * a - b) ** 2 for a, b in zip(row, s, strict=True)) for (i, _), row in zip(big, x, strict=True)}
    assert {r.vec_id: int(r.deviation) for r in whitened(table).collect()} == want


def test_slices_number_close_and_equal_eigenvalues():
    rng = np.random.default_rng(1)
    for turn in range(40):
        d = int(rng.integers(1, 50))
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        w = rng.integers(-1, 4, d) + rng.choice([0, 1e-9, 1e-7, 0.1], d)
        v = q @ np.diag(w) @ q.T
        v = (v + v.T) / 2
        shift = float(rng.choice(w)) + 1e-3
        assert positive_pivots(v - shift * np.eye(d)) == (w > shift).sum()
        e, u = leading(v, 16)
        want = np.sort(w[w > 1e-10])[::-1][:16]
        assert len(e) == len(want) and np.allclose(e, want, atol=1e-11)
        assert np.abs(u.T @ u - np.eye(len(e))).max(initial=0) < 1e-10 and np.abs(v @ u - u * e).max(initial=0) < 1e-10
