"""Leading eigenvalues of a symmetric matrix by spectrum slicing.

The matrix is brought to tridiagonal form by reflections, which keep its spectrum. The pivots of LDLᵀ of the shifted matrix give its
inertia: as many are negative as there are eigenvalues under the shift. Halving intervals by such counts isolates every leading
eigenvalue; Rayleigh quotient iteration from within its interval then converges cubically; counts on both sides of what it found
certify its number. Eigenvalues that counts can't tell apart are one cluster: its vectors are found together, as a basis.
"""

from __future__ import annotations

import numpy as np

TOLERANCE = 1e-8  # of the spectrum's width: intervals are halved down to this
CLUSTER = 1e-6  # eigenvalues nearer than this, of the width, are found together


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of QᵀMQ, and Q."""
    a, n = np.array(matrix, dtype=np.float64), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v /= size
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each shift: negative pivots of LDLᵀ of the shifted matrix."""
    least = np.finfo(np.float64).tiny / np.finfo(np.float64).eps
    count, pivot = np.zeros(len(shifts), dtype=np.int64), np.ones(len(shifts))
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def isolated(diagonal: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """For each of the k largest, falling, an interval that holds it, narrowed by counts; and the spectrum's width."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    least, most = (diagonal - reach).min(), (diagonal + reach).max()
    width = max(most - least, abs(most), abs(least))
    lo, hi = np.full(k, least - 1e-6 * width), np.full(k, most + 1e-6 * width)
    number = n - np.arange(k)  # as many eigenvalues lie under the interval's end
    while width and (hi - lo).max() > TOLERANCE * width:
        mid = (lo + hi) / 2
        over = below(diagonal, off, mid) >= number
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
    return lo, hi, width


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray, width: float) -> np.ndarray:
    for nudge in (0.0, 1e-15, 1e-14, 1e-13):
        try:
            out = np.linalg.solve(matrix - (shift + nudge * width) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    raise ArithmeticError("a shifted matrix can't be solved")


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns."""
    n = len(matrix)
    k = min(k, n)
    if not k or not np.any(matrix):
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, q = tridiagonal(matrix)
    lo, hi, width = isolated(diagonal, off, k)
    flat = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    start = np.random.default_rng(1).normal(size=(n, n))
    values, vectors = [], np.zeros((n, 0))
    while len(values) < k:
        first = len(values)
        top, bottom = hi[first] + CLUSTER * width / 2, lo[first] - CLUSTER * width
        last = first + 1
        while last < k and hi[last] > bottom:
            bottom = lo[last] - CLUSTER * width
            last += 1
        bottom = lo[last - 1] - CLUSTER * width / 2
        size = int(n - below(diagonal, off, np.array([bottom]))[0]) - first  # a cluster may go on beyond k
        x = np.linalg.qr(start[:, first : first + size])[0]
        shift = (lo[first] + hi[last - 1]) / 2
        near = False
        for _ in range(14):
            x = _solved(flat, shift, x, width)
            x -= vectors @ (vectors.T @ x)
            x = np.linalg.qr(x)[0]
            inner = x.T @ flat @ x
            value, turn = np.linalg.eigh(inner) if size > 1 else (inner[0], np.eye(1))
            x = (x @ turn)[:, ::-1]
            value = value[::-1]
            if near:  # one step more than asked for
                break
            near = np.abs(flat @ x - x * value).max() <= 4 * n * np.finfo(np.float64).eps * width
            if size == 1:
                shift = float(value[0])  # the Rayleigh quotient
        else:
            raise ArithmeticError("an eigenvector doesn't converge")
        above = n - below(diagonal, off, np.array([top, bottom]))
        if above[0] != first or above[1] != first + size or value.max() > top or value.min() < bottom:
            raise ArithmeticError("counts don't certify an eigenvalue's number")
        values += value.tolist()
        vectors = np.concatenate([vectors, x], axis=1)
    out = q @ vectors
    return np.array(values[:k]), (out / np.linalg.norm(out, axis=0))[:, :k]
