"""Strongest correlations of each series at every origin, without forming every correlation at every origin.

Windows of consecutive origins share a core of periods. One matrix product over the core bounds the correlations of a
pair at all origins of a group; only pairs whose bound reaches what a series already has are computed, over their common
periods. A series starts from its peers at the origins before. The result is that of all pairs.

The bound. Let M be the core periods that both series of a pair have and Q those of a whole window. Centred over Q and of
length 1, a series is the sum of a part centred over M, of length c, and of something orthogonal to that, of length s. So
with r the correlation over Q and p over M, |r| <= c c' |p| + s s'. A series' c is at least the root of its sum of squares
over M, over that of its own whole window. Given least c and c', `_reach` is the smallest |p| that allows some |r|.
"""

from __future__ import annotations

import numpy as np

TINY = 1e-12
#: Origins that share a core, as a part of the window.
PART = 8
#: Series of a left block, right series of the first and of the largest block, pairs computed at a time, pairs kept waiting.
ROWS, FIRST, LARGEST, PAIRS, WAITING = 256, 64, 2048, 4096, 16384
#: Share of series that have a value at a period of a core.
SHARE = 0.9
#: What rounding adds to a bound: products of unit vectors in single precision, without gaps and with some, and sums.
SLACK, LOOSE, CLOSE = 1e-5, 1e-3, 1e-9
#: Kinds of series: without gaps in the core, with gaps, without a bound.
KINDS = 3


class _Group:
    """Periods of some consecutive origins: all of them, those before and after what the windows share, the core."""

    def __init__(self, x: np.ndarray, y: np.ndarray, at: np.ndarray, k: int):
        first = np.maximum(0, at - k + 1)
        self.at, self.lo, self.hi = at, int(first[0]), int(at[-1]) + 1
        self.left, self.right = int(first[-1]) - self.lo, int(at[0]) + 1 - self.lo
        self.back, self.ahead = self.left - (first - self.lo), at - at[0]
        known = [np.isfinite(v[:, self.lo:self.hi]).mean(axis=0) for v in (x, y)]
        self.usual = [share > 0.5 for share in known]
        self.core = np.minimum(*known) >= SHARE
        self.core[:max(self.left, 0)] = self.core[self.right:] = False

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Sums of each row over the window of each origin; additions only, in the same order for every row."""
        zero = np.zeros((len(v), 1))
        if self.left >= self.right:  # windows without a common period
            return np.stack([v[:, self.left - b:self.right + a].sum(axis=1) for b, a in zip(self.back, self.ahead)], axis=1)
        before = np.hstack([zero, np.cumsum(v[:, :self.left][:, ::-1], axis=1)])
        after = np.hstack([zero, np.cumsum(v[:, self.right:], axis=1)])
        return v[:, self.left:self.right].sum(axis=1)[:, None] + before[:, self.back] + after[:, self.ahead]


class _Side:
    """One side's series in a group: values about their core's mean, core unit vectors and what bounds need of them."""

    def __init__(self, v: np.ndarray, own: int, g: _Group, min_pairs: int):
        v = v[:, g.lo:g.hi]
        known = np.isfinite(v)
        inner = known & g.core
        n = inner.sum(axis=1)
        raw = np.where(inner, v, 0.0)
        some = np.maximum(known.sum(axis=1), 1)
        mean = np.where(n > 0, raw.sum(axis=1) / np.maximum(n, 1), np.where(known, v, 0.0).sum(axis=1) / some)
        self.x, self.m = np.where(known, v - mean[:, None], 0.0), known
        self.full = (known == g.usual[own]).all(axis=1)
        # sums of full series with full ones
        shared = self.x * g.usual[1 - own]
        self.s, sq = g.sums(shared), g.sums(shared * shared)
        self.n = g.sums((g.usual[0] & g.usual[1]).astype(float)[None, :])
        self.v = _deviation(self.n, self.s, sq)
        # over a series' own periods
        count, sq = g.sums(self.m), g.sums(self.x * self.x)
        spread = _deviation(count, g.sums(self.x), sq)
        self.live = (count >= min_pairs) & np.isfinite(spread)

        u, self.inner = np.where(inner, self.x, 0.0)[:, g.core], inner[:, g.core].astype(np.float32)
        size = (u * u).sum(axis=1)
        missing = int(g.core.sum()) - n
        bounded = (size > 1e-9 * (raw * raw).sum(axis=1)) & (n >= 2)
        self.u = np.where(bounded[:, None], u / np.sqrt(np.where(bounded, size, 1.0))[:, None], 0.0).astype(np.float32)
        self.share = np.where(self.live, np.clip(size[:, None] / np.where(self.live, spread, np.inf), 0.0, 1.0), 1.0)
        self.kind = np.where(bounded, np.minimum(missing, 1), 2)


def _deviation(n, s, sq):
    """Sums of squares about the mean, NaN without variation."""
    v = sq - s * s / np.maximum(n, 1.0)
    return np.where(v > TINY * np.maximum(sq, 1e-300), v, np.nan)


def _pairs(x: _Side, y: _Side, g: _Group, min_pairs: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Correlations of pairs at each origin, over the periods that both have."""
    out = np.empty((len(i), len(g.at)))
    plain = x.full[i] & y.full[j]
    for rows in np.array_split(np.flatnonzero(plain), -(-int(plain.sum()) // PAIRS) or 1):
        a, b = i[rows], j[rows]
        c = g.sums(x.x[a] * y.x[b]) - x.s[a] * y.s[b] / np.maximum(x.n, 1.0)
        out[rows] = np.where(x.n >= min_pairs, c / np.sqrt(x.v[a] * y.v[b]), np.nan)
    rest = np.flatnonzero(~plain)
    for rows in np.array_split(rest, -(-len(rest) // PAIRS) or 1):
        a, b, ma, mb = x.x[i[rows]], y.x[j[rows]], x.m[i[rows]], y.m[j[rows]]
        a, b = a * mb, b * ma
        n, sa, sb = g.sums(ma & mb), g.sums(a), g.sums(b)
        c = g.sums(a * b) - sa * sb / np.maximum(n, 1.0)
        out[rows] = np.where(n >= min_pairs, c / np.sqrt(_deviation(n, sa, g.sums(a * a)) * _deviation(n, sb, g.sums(b * b))), np.nan)
    return np.clip(out, -1.0, 1.0)


def _reach(bar, a, b):
    """Smallest |p| for which |r| can be ``bar`` if c^2 is at least ``a`` and c'^2 at least ``b``.

    For angles up to A and B, cos cos' |p| + sin sin' is largest at both ends, or where the larger angle's tangent is the
    other's over |p| if that comes before its end.
    """
    low, high = np.minimum(1.0 - a, 1.0 - b), np.maximum(1.0 - a, 1.0 - b)
    ends = (bar - np.sqrt(low * high)) / np.sqrt(a * b)
    inside = np.sqrt(np.maximum(bar * bar - low, 0.0) / (1.0 - low))
    out = np.where(ends * ends * high * (1.0 - low) <= low * (1.0 - high), ends, inside)
    return np.where(np.isinf(bar), np.inf, np.where((bar <= 0) | (ends <= 0), -1.0, np.nan_to_num(out, nan=-1.0)))


def _core(x: _Side, y: _Side, r, c, u, space):
    """|p| of a left and a right block, and what is left of both sums of squares over the common core periods."""
    p = np.matmul(x.u[r], u.T, out=space[:len(r) * len(c)].reshape(len(r), len(c)))
    if not x.kind[r[0]] and not y.kind[c[0]]:
        return np.abs(p, out=p), None, None
    mx, my = x.inner[r], y.inner[c].T
    n, sx, sy = np.maximum(mx @ my, 1.0), x.u[r] @ my, mx @ u.T
    ex, ey = (x.u[r] ** 2) @ my - sx * sx / n, mx @ (u ** 2).T - sy * sy / n
    few = (ex < 0.05) | (ey < 0.05)  # too little to tell in single precision
    p = np.where(few, 1.0, np.abs(p - sx * sy / n) / np.sqrt(np.maximum(ex, 0.05) * np.maximum(ey, 0.05)))
    return p, np.where(few, 0.0, np.maximum(ex - LOOSE, 0.0)), np.where(few, 0.0, np.maximum(ey - LOOSE, 0.0))


def _merge(best_w, best_j, row, origin, w, j) -> None:
    """Put values of some rows and origins among the strongest, in falling order; ties go to the smaller column."""
    top = best_w.shape[2]
    flat_w, flat_j = best_w.reshape(-1, top), best_j.reshape(-1, top)
    at, code = np.unique(row * best_w.shape[1] + origin, return_inverse=True)
    code = np.concatenate([np.repeat(np.arange(len(at)), top), code.ravel()])
    w, j = np.concatenate([flat_w[at].ravel(), w]), np.concatenate([flat_j[at].ravel(), j])
    order = np.lexsort((j, -np.nan_to_num(np.abs(w), nan=-1.0), code))
    pick = order[np.searchsorted(code[order], np.arange(len(at)))[:, None] + np.arange(top)]
    flat_w[at], flat_j[at] = w[pick], j[pick]


def _blocks(rows: np.ndarray, kind: np.ndarray, first: int, largest: int):
    """(kind, rows) in order, blocks of one kind and of growing size."""
    for d in range(KINDS):
        own, start, size = rows[kind[rows] == d], 0, first
        while start < len(own):
            yield d, own[start:start + size]
            start, size = start + size, min(2 * size, largest)


def _group(x, y, at, k, min_pairs, top, place, gone, before, counts):
    g = _Group(x, y, at, k)
    left, right = _Side(x, 0, g, min_pairs), _Side(y, 1, g, min_pairs)
    best_w, best_j = np.full((len(x), len(at), top), np.nan), np.tile(-1 - np.arange(top), (len(x), len(at), 1))
    fits = right.live & ~gone[:, at]
    live = left.live & fits.any(axis=0)

    def bars(r):
        return np.where(live[r], np.nan_to_num(np.abs(best_w[r, :, -1]), nan=-1.0), np.inf)

    def compute(i, j):
        other = place[i] != j
        i, j = i[other], j[other]
        for s in range(0, len(i), 16 * PAIRS):
            n, m = i[s:s + 16 * PAIRS], j[s:s + 16 * PAIRS]
            counts["computed"] += len(n)
            w = _pairs(left, right, g, min_pairs, n, m)
            w[gone[m][:, at]] = np.nan
            e, o = np.nonzero(np.abs(w) >= bars(n))
            new = (best_j[n[e], o] != m[e][:, None]).all(axis=1)
            if new.any():
                e, o = e[new], o[new]
                _merge(best_w, best_j, n[e], o, w[e, o], m[e])

    # series with much of their deviation in the core first
    columns = np.flatnonzero(fits.any(axis=1))
    columns = columns[np.argsort(-right.share[columns].mean(axis=1), kind="stable")]
    columns = [(b, c, right.u[c], right.share[c].min(axis=0)) for b, c in _blocks(columns, right.kind, FIRST, LARGEST)]
    space = np.empty(ROWS * LARGEST, np.float32)
    waiting = []

    def settle():
        """Compute the waiting pairs that can still be among the strongest."""
        for s in range(0, sum(len(w[0]) for w in waiting), WAITING):
            if not s:
                n, m, p, ex, ey = (np.concatenate(v) for v in zip(*waiting))
            q = slice(s, s + WAITING)
            reach = _reach(bars(n[q]) - CLOSE, left.share[n[q]] * ex[q, None], right.share[m[q]] * ey[q, None])
            near = (p[q, None] >= reach).any(axis=1)
            compute(n[q][near], m[q][near])
        waiting.clear()

    for a, r in _blocks(np.flatnonzero(live.any(axis=1)), left.kind, ROWS, ROWS):
        if before is not None:
            i, o, e = np.nonzero(np.isfinite(before[0][r]))
            compute(*np.divmod(np.unique(r[i] * len(y) + before[1][r[i], o, e]), len(y)))
        has = bars(r) - CLOSE
        for b, c, u, share in columns:
            counts["bounded"] += len(r) * len(c)
            if 2 in (a, b):
                compute(np.repeat(r, len(c)), np.tile(c, len(r)))
                continue
            p, ex, ey = _core(left, right, r, c, u, space)
            if ex is None:
                some = p >= (_reach(has, left.share[r], share).min(axis=1) - SLACK).astype(np.float32)[:, None]
            else:
                q = np.minimum(left.share[r].min(axis=1).astype(np.float32)[:, None] * ex, right.share[c].min(axis=1).astype(np.float32) * ey)
                some = 1.0 - (1.0 - np.minimum(p + LOOSE, 1.0)) * q >= has.min(axis=1)[:, None]
            at_hit = np.flatnonzero(some)
            i, j = np.divmod(at_hit, len(c))
            one = np.ones(len(i)) if ex is None else None
            waiting.append((r[i], c[j], p.ravel()[at_hit] + (SLACK if ex is None else LOOSE),
                            *((one, one) if ex is None else (v.ravel()[at_hit] for v in (ex, ey)))))
            # the first blocks raise the bars most
            if sum(len(w[0]) for w in waiting) >= (WAITING if before is not None else PAIRS):
                settle()
                has = bars(r) - CLOSE
        settle()
    return best_w, best_j


def strongest(x: np.ndarray, y: np.ndarray, *, k: int, min_pairs: int, top: int, place: np.ndarray, gone: np.ndarray, counts: dict | None = None):
    """(period from 0, correlations, right rows) of the ``top`` largest |corr| of each left row at each origin, NaN where there are fewer.

    ``place`` is the right row of the same series, ``gone`` says where a right row is no peer.
    """
    counts = {} if counts is None else counts
    counts |= {"bounded": 0, "computed": 0}
    # a period that the other side never has is in no pair
    x, y = (np.where(np.isfinite(other).any(axis=0), v, np.nan) for v, other in ((x, y), (y, x)))
    t, before = max(min_pairs, 1) - 1, None
    with np.errstate(all="ignore"):
        while t < x.shape[1]:
            at = np.arange(t, min(t + max(1, min(k, t + 1) // PART), x.shape[1]))
            before = _group(x, y, at, k, min_pairs, top, place, gone, before, counts)
            for o, t in enumerate(at):
                yield t, before[0][:, o], before[1][:, o]
            t += 1
