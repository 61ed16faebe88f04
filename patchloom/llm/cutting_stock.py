"""Cutting stock by column generation: which mixes of piece lengths fill sequences, and how often each mix is used.

Lengths are counted in classes of ``UNIT`` tokens, rounded up, so that the linear program has a fixed number of rows whatever the corpus.
The master program covers the demand of each class with as few sequences as possible; its duals price a new pattern by an unbounded
knapsack over the capacity. Counts are rounded down and what is left over is packed best fit, largest class first.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

#: The linear program ends when its value is within this share of Farley's lower bound.
GAP = 5e-4


@dataclass
class Basis:
    """The optimal basis: one column of class counts for each row of ``classes``; surplus columns are negative units."""

    classes: np.ndarray
    inverse: np.ndarray
    columns: np.ndarray
    is_pattern: np.ndarray
    rounds: int


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most value that fits, with repeats, and how many of each."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, c, side="right"))
        best[c] = best[c - 1]
        if n:
            got = values[:n] + best[c - sizes[:n]]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], took[c] = got[k], k
    counts = np.zeros(len(sizes))
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """Inverse by elimination with pivoting. The library's own routine starts threads, which was seen to hang in a driver."""
    n = len(a)
    both = np.concatenate([a, np.eye(n)], axis=1)
    for k in range(n):
        row = k + int(np.abs(both[k:, k]).argmax())
        if row != k:
            both[[k, row]] = both[[row, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k][None, :]
    return both[:, n:]


def solve(demand: dict[int, int], capacity: int, most: int = 4000) -> Basis:
    """Column generation with a revised simplex; ``demand`` maps a class (its size in units) to a count."""
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), dtype=np.int64)
    d = np.array([demand[int(c)] for c in sizes], dtype=np.float64)
    m = len(sizes)
    columns = np.diag((capacity // sizes).astype(np.float64)) if m else np.zeros((0, 0))
    inverse = np.diag(1 / np.diag(columns)) if m else np.zeros((0, 0))
    cost, x = np.ones(m), (inverse @ d if m else np.zeros(0))
    rounds = 0
    while m and rounds < most:
        rounds += 1
        y = np.einsum("i,ij->j", cost, inverse)
        low = int(y.argmin())
        if y[low] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[low] = -1
        else:
            y = np.maximum(y, 0)
            value, column = knapsack(y, sizes, capacity)
            price = 1.0
            if value <= 1 + 1e-9 or (y @ d) / value >= (1 - GAP) * (cost @ x):
                break
        u = np.einsum("ij,j->i", inverse, column)
        rows = np.flatnonzero(u > 1e-9)
        if not len(rows):
            break
        ratio = x[rows] / u[rows]
        out = int(rows[ratio.argmin()])
        step = max(0.0, float(ratio.min()))
        x = np.maximum(x - step * u, 0)
        x[out] = step
        columns[:, out], cost[out] = column, price
        if rounds % 64:
            row = inverse[out] / u[out]
            inverse = inverse - np.outer(u, row)
            inverse[out] = row
        else:  # against rounding errors
            inverse = inverted(columns)
            x = np.maximum(np.einsum("ij,j->i", inverse, d), 0)
    return Basis(sizes, inverse, columns, cost > 0, rounds)


def round_patterns(basis: Basis, demand: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (class to count) and how often each is used, together covering ``demand``: rounded down, the rest best fit decreasing."""
    left = Counter({c: n for c, n in demand.items() if n > 0})
    out: list[tuple[dict[int, int], int]] = []
    if len(basis.classes):
        d = np.array([left.get(int(c), 0) for c in basis.classes], dtype=np.float64)
        x = np.floor(np.maximum(np.einsum("ij,j->i", basis.inverse, d), 0) + 1e-6).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            pattern = {int(basis.classes[i]): int(basis.columns[i, k]) for i in np.flatnonzero(basis.columns[:, k] > 0)}
            if basis.is_pattern[k] and pattern and (n := min([int(x[k]), *(left[c] // a for c, a in pattern.items())])) > 0:
                out.append((pattern, n))
                for c, a in pattern.items():
                    left[c] -= a * n
    open_bins: dict[int, list[Counter]] = {}  # by room
    for c in sorted((c for c, n in left.items() if n > 0), reverse=True):
        for _ in range(left[c]):
            room = next((r for r in range(c, capacity + 1) if open_bins.get(r)), None)
            content = open_bins[room].pop() if room is not None else Counter()
            content[c] += 1
            open_bins.setdefault((room if room is not None else capacity) - c, []).append(content)
    rest = Counter(tuple(sorted(b.items(), reverse=True)) for bins in open_bins.values() for b in bins)
    return out + [(dict(k), n) for k, n in sorted(rest.items())]
