"""Leading eigenpairs of a small symmetric matrix by spectrum slicing and Rayleigh quotient iteration."""

from __future__ import annotations

import numpy as np

# Bunch and Kaufman's bound on the growth of a step.
ALPHA = (1 + 17**0.5) / 8
NEAR = 1e-6
TIGHT = 1e-14


def positive_pivots(a: np.ndarray) -> int:
    """The number of positive eigenvalues, by Sylvester's law from the pivots of LDLᵀ."""
    a, positive = a.copy(), 0
    while a.size:
        column = np.abs(a[1:, 0])
        largest = column.max(initial=0.0)
        width = 1
        if abs(a[0, 0]) < ALPHA * largest:
            r = 1 + int(column.argmax())
            row = np.abs(a[r])
            row[r] = 0
            if abs(a[0, 0]) * row.max() < ALPHA * largest**2:
                width = 1 if abs(a[r, r]) >= ALPHA * row.max() else 2
                order = np.arange(len(a))
                order[[width - 1, r]] = r, width - 1
                a = a[np.ix_(order, order)]
        if width == 1:
            positive += bool(a[0, 0] > 0)
            rest = a[1:, :1]
            a = a[1:, 1:] - rest * (rest.T / a[0, 0]) if a[0, 0] else a[1:, 1:]
        else:  # a block of two has a pivot of each sign
            positive += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        a = (a + a.T) / 2
    return positive


class Slices:
    """Counts of eigenvalues above shifts, kept to bracket each eigenvalue by its number."""

    def __init__(self, v: np.ndarray):
        self.v, self.eye = v, np.eye(len(v))
        reach = float(np.abs(v).sum(axis=1).max(initial=0.0))
        self.scale = reach or 1.0
        low, high = -1.01 * self.scale, 1.01 * self.scale
        self.counts = {low: len(v), high: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positive_pivots(self.v - shift * self.eye)
        return self.counts[shift]

    def bracket(self, j: int) -> tuple[float, float]:
        """The narrowest known shifts with the j-th largest eigenvalue between them."""
        low = max(s for s, n in self.counts.items() if n >= j)
        high = min(s for s, n in self.counts.items() if n < j and s > low)
        return low, high

    def value(self, j: int) -> float:
        """The j-th largest eigenvalue, converged inside a bracket that holds no other."""
        while True:
            low, high = self.bracket(j)
            middle = (low + high) / 2
            if high - low <= TIGHT * self.scale or not low < middle < high:
                return middle
            if self.above(low) - self.above(high) == 1:
                found = self.rayleigh(low, high)
                if found is not None:
                    return found
            self.above(middle)

    def rayleigh(self, low: float, high: float) -> float | None:
        """The Rayleigh quotient the iteration settles at, None if it leaves the bracket."""
        x = np.random.default_rng(len(self.v)).standard_normal(len(self.v))
        shift, last = (low + high) / 2, np.inf
        for turn in range(30):
            try:
                x = np.linalg.solve(self.v - shift * self.eye, x)
            except np.linalg.LinAlgError:
                return shift if turn > 2 else None
            x /= np.linalg.norm(x)
            quotient = float(x @ self.v @ x)
            residual = float(np.linalg.norm(self.v @ x - quotient * x))
            if turn > 1:  # the first steps keep the middle as their shift
                if not low < quotient < high:
                    return None
                if residual <= TIGHT * self.scale or (turn > 6 and residual >= last / 2):
                    return quotient if residual <= NEAR**2 * self.scale else None
                shift = quotient
            last = residual
        return None

    def vectors(self, values: list[float]) -> tuple[list[float], np.ndarray]:
        """Orthonormal vectors of neighbouring eigenvalues: block inverse iteration and Ritz values."""
        shift = float(np.mean(values)) + TIGHT * self.scale
        q = np.random.default_rng(len(values)).standard_normal((len(self.v), len(values)))
        for _ in range(8):
            try:
                q = np.linalg.qr(np.linalg.solve(self.v - shift * self.eye, q))[0]
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                shift += TIGHT * self.scale
        ritz, turn = np.linalg.eigh(q.T @ self.v @ q)
        return ritz[::-1].tolist(), (q @ turn)[:, ::-1]


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues above rounding, falling, and their unit vectors as columns.

    LDLᵀ counts bracket each eigenvalue by its number before the iteration may converge to it, and
    counts on both sides of each result confirm the number. Eigenvalues nearer than a millionth of
    the largest are solved together, so their vectors are orthogonal. The largest entry of
    each vector is positive.
    """
    d = len(v)
    slices = Slices(v)
    k = min(k, slices.above(d * np.finfo(float).eps * slices.scale))
    if not k:
        return np.zeros(0), np.zeros((d, 0))
    values: list[float] = []
    # One value beyond the last, or all of its near neighbours, shows which belong together.
    while len(values) < d and (len(values) <= k or values[-2] - values[-1] <= NEAR * values[0]):
        values.append(slices.value(len(values) + 1))
    found, columns, start = [], [], 0
    for end in range(1, len(values) + 1):
        if end == len(values) or values[end - 1] - values[end] > NEAR * values[0]:
            e, q = slices.vectors(values[start:end])
            found += e
            columns.append(q)
            start = end
    found = np.array(found[:k])
    q = np.hstack(columns)[:, :k]
    for j, e in enumerate(found, 1):
        slack = 1e-11 * slices.scale
        if not slices.above(e + slack) < j <= slices.above(e - slack):
            raise ArithmeticError(f"eigenvalue {j} is not confirmed by the counts")
    signs = np.sign(q[np.abs(q).argmax(axis=0), np.arange(k)])
    return found, q * signs
