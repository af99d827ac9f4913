"""Eigenpairs of a symmetric matrix by contour integration, with inertia counts.

The integral of the resolvent around an interval projects onto the eigenvectors whose values lie in
it. A quadrature turns it into a few complex shifted solves; a Rayleigh-Ritz step in the projected
space gives the pairs, and both repeat until the residuals are at the level of rounding. How many
pairs there must be follows from the inertia of two shifted matrices, so a missed one is noticed.
"""

from __future__ import annotations

import math

import numpy as np

QUADRATURE = 8  # points of the upper half circle
MAX_ROUNDS = 40
SEED = 13
CLUSTER_GAP = 2.0**-36  # of the norm: eigenvalues nearer than this share a contour


class MissedPairs(ArithmeticError):
    """Fewer or more pairs than the inertia of the shifted matrices says."""


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, side diagonal) of an orthogonally similar matrix, by reflections."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
    return np.diag(a).copy(), (np.diag(a, 1) + np.diag(a, -1)) / 2


def count_below(form: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues are smaller than each shift: the negative pivots of the shifted matrix, which
    by Sylvester's law are as many in its tridiagonal form."""
    diagonal, side = form
    least = np.finfo(float).tiny * max(1.0, float((side**2).max(initial=0.0)))
    below = np.zeros(len(shifts), dtype=np.int64)
    pivot = np.ones(len(shifts))
    for k, value in enumerate(diagonal):
        pivot = value - shifts - (side[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        below += pivot < 0
    return below


def brackets(form: tuple[np.ndarray, np.ndarray], bound: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends, at most ``width`` apart, around every eigenvalue, largest first."""
    n = len(form[0])
    low, high = np.full(n, -bound), np.full(n, bound)
    number = np.arange(1, n + 1)
    for _ in range(max(1, math.ceil(math.log2(2 * bound / width)))):
        middle = (low + high) / 2
        above = n - count_below(form, middle) >= number
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low, high


def interval_pairs(matrix: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of all eigenvalues in [low, high), falling; ends must lie apart from eigenvalues."""
    n = len(matrix)
    below = count_below(tridiagonal(matrix), np.array([low, high]))
    wanted = int(below[1] - below[0])
    if not wanted:
        return np.zeros(0), np.zeros((n, 0))
    scale = float(np.abs(matrix).sum(axis=1).max())
    # More columns than pairs speed up convergence.
    columns = min(n, wanted + max(4, wanted // 2))
    basis = np.linalg.qr(np.random.default_rng(SEED).normal(size=(n, columns)))[0]
    nodes, weights = np.polynomial.legendre.leggauss(QUADRATURE)
    centre, radius = (low + high) / 2, (high - low) / 2
    turns = radius * np.exp(1j * np.pi * (nodes + 1) / 2)
    best = math.inf
    for _ in range(MAX_ROUNDS):
        projected = np.zeros((n, columns))
        for turn, weight in zip(turns, weights):
            solved = np.linalg.solve((centre + turn) * np.eye(n) - matrix, basis.astype(complex))
            projected += weight / 2 * np.real(turn * solved)
        basis = np.linalg.qr(projected)[0]
        values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ turned
        inside = np.flatnonzero((values >= low) & (values < high))[::-1]
        pairs = values[inside], basis[:, inside]
        if len(inside) == wanted:
            worst = float(np.linalg.norm(matrix @ pairs[1] - pairs[1] * pairs[0], axis=0).max())
            if worst <= 8 * np.finfo(float).eps * scale or worst >= best and worst <= 1e-11 * scale:
                return pairs
            best = worst
    raise MissedPairs(f"{wanted} eigenvalues lie in [{low}, {high})")


def largest_pairs(matrix: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors) of the ``number`` largest eigenvalues, falling; all, if there are fewer.

    Inertia counts bracket the eigenvalues. Those that lie apart get a contour each, which cuts the
    gaps around them; those that do not share one, so equal eigenvalues are never parted.
    """
    n = len(matrix)
    number = min(number, n)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if not number or not scale:
        return np.zeros(number), np.eye(n)[:, :number]
    width = scale * 2.0**-46
    low, high = brackets(tridiagonal(matrix), scale * (1 + 2.0**-20), width)
    gaps = low[:-1] - high[1:]  # below each eigenvalue but the last
    ends = [*(np.flatnonzero(gaps > CLUSTER_GAP * scale) + 1).tolist(), n]
    values, vectors, first = [], [], 0
    for end in ends:
        if first >= number:
            break
        apart = min(gaps[first - 1] if first else scale, gaps[end - 1] if end < n else scale) / 2
        found = interval_pairs(matrix, low[end - 1] - apart, high[first] + apart)
        if len(found[0]) != end - first:
            raise MissedPairs(f"{len(found[0])} of {end - first} pairs")
        values.append(found[0])
        vectors.append(found[1])
        first = end
    # Contours leave errors of rounding between their vectors; one last small problem removes them.
    basis = np.linalg.qr(np.concatenate(vectors, axis=1))[0]
    final, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    return final[::-1][:number], (basis @ turned)[:, ::-1][:, :number]
