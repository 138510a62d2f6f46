"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, bisection by Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this part of the norm share a cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
ROUNDS = 5


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of the tridiagonal matrix that is similar to ``matrix``."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length > 0 and np.abs(v[1:]).max() > 0:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        else:
            v[:] = 0
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def restored(reflectors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Columns of the tridiagonal basis in the basis of the matrix."""
    out = vectors.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each of ``at``: negative terms of the Sturm sequence."""
    least = np.finfo(np.float64).tiny / EPS * max(1.0, float((off**2).max(initial=0)))
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - at - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected until the interval can't shrink."""
    d = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    edge = EPS * max(1e-300, float(np.abs(diagonal).max() + reach.max()))
    low = np.full(k, (diagonal - reach).min() - edge)
    high = np.full(k, (diagonal + reach).max() + edge)
    wanted = d - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        above = below(diagonal, off, middle) > wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A column for each shift: the tridiagonal system less the shift, by elimination with row exchanges."""
    d, k = right.shape
    least = EPS * (float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0)
    pivots, first, second, sides = (np.zeros((d, k)) for _ in range(4))

    def away(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) < least, np.copysign(least, x), x)

    a, c, r = diagonal[0] - shifts, np.full(k, off[0] if d > 1 else 0.0), right[0]
    for i in range(d - 1):
        under, own, after = off[i], diagonal[i + 1] - shifts, off[i + 1] if i + 2 < d else 0.0
        swap = np.abs(under) > np.abs(a)
        pivots[i] = away(np.where(swap, under, a))
        first[i], second[i], sides[i] = np.where(swap, own, c), np.where(swap, after, 0.0), np.where(swap, right[i + 1], r)
        by = np.where(swap, a, under) / pivots[i]
        a = np.where(swap, c, own) - by * first[i]
        c = np.where(swap, 0.0, after) - by * second[i]
        r = np.where(swap, r, right[i + 1]) - by * sides[i]
    pivots[d - 1], sides[d - 1] = away(a), r
    out = np.zeros((d, k))
    for i in range(d - 1, -1, -1):
        out[i] = (sides[i] - (first[i] * out[i + 1] if i + 1 < d else 0) - (second[i] * out[i + 2] if i + 2 < d else 0)) / pivots[i]
    return out


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit column for each of the falling ``values``; columns of a cluster are orthogonal to each other."""
    d, k = len(diagonal), len(values)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)) or 1.0
    start = np.zeros(k, dtype=np.int64)
    for j in range(1, k):
        start[j] = start[j - 1] if values[j - 1] - values[j] <= CLUSTER * norm else j
    x = np.random.default_rng(0).standard_normal((d, k))
    for _ in range(ROUNDS):
        x = _solved(diagonal, off, values, x / np.abs(x).max(axis=0))
        x /= np.abs(x).max(axis=0)
        for j in range(k):
            own, others = x[:, j], x[:, start[j] : j]
            for _ in range(2):  # once more, since the first pass may leave next to nothing
                own = own - others @ (others.T @ own)
                own = own / np.linalg.norm(own)
            x[:, j] = own
    return x


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as rows.

    The entry of a vector that is largest in size is positive.
    """
    d = len(matrix)
    k = min(k, d)
    if not k:
        return np.zeros(0), np.zeros((0, d))
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, off, reflectors = householder(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = restored(reflectors, tridiagonal_vectors(diagonal, off, values)).T
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    at = np.abs(vectors).argmax(axis=1)
    return values * scale, vectors * np.where(vectors[np.arange(k), at] < 0, -1.0, 1.0)[:, None]
