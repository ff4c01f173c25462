"""Leading eigenpairs of a symmetric matrix by spectrum slicing, in NumPy on one small matrix.

The inertia of A - s I, read off an LDL^T factorisation with 1x1 and 2x2 pivots, counts the eigenvalues above
s. Bisection with these counts isolates each leading eigenvalue; Rayleigh quotient iteration from the middle of
its interval then converges cubically, and two more counts, just above and just below, certify its number. A
cluster that bisection cannot part down to rounding is taken as one invariant subspace: inverse iteration on
a block of its size, then Rayleigh-Ritz within the block.
"""

from __future__ import annotations

import numpy as np

_BK = (1 + 17 ** 0.5) / 8  # bound of growth of Bunch-Kaufman pivoting


def inertia(a: np.ndarray, shift: float) -> tuple[int, int, int]:
    """How many eigenvalues of symmetric `a` lie above, below and (to rounding) at `shift`."""
    m = np.array(a, float)
    n = len(m)
    m[np.diag_indices(n)] -= shift
    tiny = np.finfo(float).eps * max(np.abs(m).max(initial=0.0), np.finfo(float).tiny)
    above = below = at = k = 0
    while k < n:
        column = np.abs(m[k + 1:, k])
        most = column.max(initial=0.0)
        if max(abs(m[k, k]), most) <= tiny:
            at, k = at + 1, k + 1
            continue
        width = 1
        if abs(m[k, k]) < _BK * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0.0
            sigma = row.max()
            if abs(m[k, k]) * sigma >= _BK * most ** 2:
                pass
            elif abs(m[r, r]) >= _BK * sigma:
                _swap(m, k, r)
            else:
                _swap(m, k + 1, r)
                width = 2
        if width == 1:
            d = m[k, k]
            above, below = above + (d > 0), below + (d < 0)
            c = m[k + 1:, k] / d
            m[k + 1:, k + 1:] -= np.outer(c, m[k, k + 1:])
        else:
            pivot = m[k:k + 2, k:k + 2].copy()
            det, trace = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] ** 2, pivot[0, 0] + pivot[1, 1]
            if det < 0:
                above, below = above + 1, below + 1
            elif trace > 0:
                above += 2
            else:
                below += 2
            rest = m[k + 2:, k:k + 2]
            m[k + 2:, k + 2:] -= rest @ np.linalg.solve(pivot, rest.T)
        k += width
    return above, below, at


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


def _above(a: np.ndarray, shift: float) -> int:
    return inertia(a, shift)[0]


def leading(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and unit eigenvectors as columns (fewer if the matrix is smaller)."""
    a = (np.asarray(a, float) + np.asarray(a, float).T) / 2
    n = len(a)
    count = min(count, n)
    radius = np.abs(a).sum(1).max(initial=0.0)  # Gershgorin: all eigenvalues lie within it
    if count == 0 or radius == 0.0:
        return np.zeros(count), np.eye(n)[:, :count]
    resolution = 64 * np.finfo(float).eps * radius
    values: list[float] = []
    vectors = np.zeros((n, 0))
    while len(values) < count:
        done = len(values)
        # lo has at least one more eigenvalue above it than are known, hi has none more
        lo, hi = -radius - resolution, radius + resolution
        if values:
            hi = min(hi, values[-1] + resolution)
        inside = n - done
        while hi - lo > resolution:
            mid = (lo + hi) / 2
            above = _above(a, mid) - done
            if above <= 0:
                hi = mid
            else:
                lo, inside = mid, above
                if inside == 1 and hi - lo < 1e-3 * radius:
                    break
        if inside == 1:
            value, vector = _rayleigh(a, lo, hi, vectors)
            gap = max(resolution, 1e-9 * abs(value))
            # its own number: `done` eigenvalues above it, done + 1 once it is passed
            if not _above(a, value + gap) <= done < _above(a, value - gap):
                value, vector = _bisected(a, lo, hi, done, resolution, vectors)
            values.append(value)
            vectors = np.column_stack([vectors, vector])
        else:
            found, block = _cluster(a, (lo + hi) / 2, min(inside, n - done), vectors)
            values += found.tolist()
            vectors = np.column_stack([vectors, block])
    order = np.argsort(-np.array(values), kind="stable")[:count]
    return np.array(values)[order], vectors[:, order]


def _freed(v: np.ndarray, from_: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - from_ @ (from_.T @ v)
    return v


def _solved(a: np.ndarray, shift: float, b: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(A - shift I)^-1 b, off the shift by rounding where that is singular; nearly parallel to the eigenvectors sought."""
    n = len(a)
    while True:
        try:
            x = np.linalg.solve(a - shift * np.eye(n), b)
            if np.isfinite(x).all():
                return _freed(x, known)
        except np.linalg.LinAlgError:
            pass
        shift += np.finfo(float).eps * max(np.abs(a).max(), abs(shift))


def _start(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(n).standard_normal((n, width))


def _rayleigh(a, lo, hi, known):
    """Rayleigh quotient iteration kept within [lo, hi]; inverse iteration at the middle first."""
    mid = (lo + hi) / 2
    v = _freed(_start(len(a), 1)[:, 0], known)
    for _ in range(3):
        v = _solved(a, mid, v / np.linalg.norm(v), known)
    v /= np.linalg.norm(v)
    value = float(v @ a @ v)
    for _ in range(12):
        w = _solved(a, value if lo <= value <= hi else mid, v, known)
        w /= np.linalg.norm(w)
        new = float(w @ a @ w)
        still = min(np.abs(w - v).max(), np.abs(w + v).max()) < 1e-14 or abs(new - value) <= np.finfo(float).eps * abs(new)
        v, value = w, new
        if still:
            break
    return value, v


def _bisected(a, lo, hi, done, resolution, known):
    """The eigenvalue of number done + 1 by counts alone, its vector by inverse iteration."""
    while hi - lo > resolution:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _above(a, mid) > done else (lo, mid)
    found, block = _cluster(a, (lo + hi) / 2, 1, known)
    return float(found[0]), block[:, 0]


def _cluster(a, shift, width, known):
    """Orthonormal vectors and values of the `width` eigenvalues that lie at `shift` to rounding."""
    q = np.linalg.qr(_freed(_start(len(a), width), known))[0]
    for _ in range(4):
        q = np.linalg.qr(_solved(a, shift, q, known))[0]
    small = q.T @ a @ q
    # Jacobi rotations part the block, whose entries differ by rounding only
    small, turn = _jacobi((small + small.T) / 2)
    order = np.argsort(-small, kind="stable")
    return small[order], (q @ turn)[:, order]


def _jacobi(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, q = s.copy(), np.eye(len(s))
    for _ in range(30):
        off = np.abs(s - np.diag(np.diag(s))).max(initial=0.0)
        if off <= np.finfo(float).eps * np.abs(s).max(initial=0.0):
            break
        for i in range(len(s)):
            for j in range(i):
                if s[i, j] != 0.0:
                    angle = 0.5 * np.arctan2(2 * s[i, j], s[j, j] - s[i, i])
                    g = np.eye(len(s))
                    g[[i, j], [i, j]], g[i, j], g[j, i] = np.cos(angle), np.sin(angle), -np.sin(angle)
                    s, q = g.T @ s @ g, q @ g
    return np.diag(s).copy(), q
