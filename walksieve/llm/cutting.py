"""Cutting stock by column generation: how often to use which pattern of lengths, from a histogram alone.

The linear program has one row per length and one column per pattern (how many pieces of each
length a sequence holds); its basis are first-fit decreasing patterns. Each round prices
patterns with a knapsack dynamic program over the duals and enters those that improve the basis,
until the bound by Farley or by the total length shows the gap to be small. Patterns are rounded
down; what is left is filled pattern by pattern, the longest piece first with the fullest
completion. All of this works on at most `size` numbers, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

Pattern = dict[int, int]


def first_fit(counts: Pattern, size: int) -> list[tuple[Pattern, float, list[int]]]:
    """(pattern, times, lengths that run out): greedy patterns, longest first, each used until a length is gone."""
    left, out = {n: float(c) for n, c in counts.items()}, []
    lengths = sorted((n for n, c in left.items() if c > 0), reverse=True)
    while lengths:
        room, pattern = size, {}
        for n in lengths:
            if n <= room:
                pattern[n] = room // n
                room -= pattern[n] * n
            if room < lengths[-1]:
                break
        times = min(left[n] / k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
        gone = [n for n in pattern if left[n] <= 1e-9 * counts[n]]
        out.append((pattern, times, gone))
        lengths = [n for n in lengths if n not in gone]
    return out


def fill(counts: Pattern, size: int) -> list[tuple[Pattern, int]]:
    """Integer patterns for all of `counts`: the longest piece left with the fullest completion, used while it fits."""
    left, out = Counter({n: c for n, c in counts.items() if c > 0}), []
    while left:
        top = max(left)
        pattern = Counter({top: 1})
        left[top] -= 1
        room = size - top
        reach, steps = 1, []
        mask = (1 << room + 1) - 1
        for n in sorted((n for n, c in left.items() if c > 0 and n <= room), reverse=True):
            k, share = min(left[n], room // n), 1
            while k > 0 and not reach >> room & 1:
                take = min(share, k)
                steps.append((n, take, reach))
                reach |= reach << n * take & mask
                k, share = k - take, share * 2
        at = reach.bit_length() - 1
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                pattern[n] += take
                at -= n * take
        left[top] += 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
        left = +left
        out.append((dict(pattern), times))
    return out


def price(duals: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best dual value within each capacity, and the length taken last (0: none)."""
    worth = np.zeros(size + 1)
    worth[lengths] = np.maximum(duals, 0)
    value, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for s in range(1, size + 1):
        v = value[s - 1::-1] + worth[1:s + 1]
        k = int(v.argmax())
        if v[k] > value[s - 1] + 1e-12:
            value[s], last[s] = v[k], k + 1
        else:
            value[s] = value[s - 1]
    return value, last


def _pattern(last: np.ndarray, capacity: int) -> Pattern:
    out: Counter = Counter()
    while capacity > 0:
        n = int(last[capacity])
        if n == 0:
            capacity -= 1
        else:
            out[n] += 1
            capacity -= n
    return dict(out)


def generate(counts: Pattern, size: int, gap: float = 5e-4, rounds: int = 200) -> tuple[list[tuple[Pattern, float]], dict]:
    """The linear program's patterns with their (fractional) uses, and what the run did."""
    lengths = np.array(sorted((n for n, c in counts.items() if c > 0), reverse=True), np.int64)
    row = {int(n): i for i, n in enumerate(lengths)}
    need = np.array([counts[int(n)] for n in lengths], np.float64)
    m = len(lengths)
    if not m:
        return [], {"rounds": 0, "gap": 0.0}
    # a basis: each greedy pattern stands for a length that it uses up, which no later pattern holds, so the matrix is
    # triangular in the order of their ends; lengths that end together get a pattern of their own, unused so far
    columns: list[Pattern] = [{int(n): size // int(n)} for n in lengths]
    x = np.zeros(m)
    for pattern, times, gone in first_fit(counts, size):
        columns[row[gone[0]]], x[row[gone[0]]] = pattern, times
    matrix = np.zeros((m, m))
    for j, pattern in enumerate(columns):
        for n, k in pattern.items():
            matrix[row[n], j] = k
    inverse = np.linalg.inv(matrix)
    x = np.maximum(inverse @ need, 0)
    material = float((lengths * need).sum()) / size
    bound, done, entered = material, 0, 0

    def enter(pattern: Pattern) -> bool:
        rows, much = np.array([row[n] for n in pattern]), np.array(list(pattern.values()), np.float64)
        if duals[rows] @ much <= 1 + 1e-9:
            return False
        step = inverse[:, rows] @ much
        up = np.flatnonzero(step > 1e-9)
        out = up[np.argmin(x[up] / step[up])]
        t = x[out] / step[out]
        x[:] = np.maximum(x - t * step, 0)
        x[out] = t
        pivot = inverse[out] / step[out]
        step[out] -= 1  # the leaving row keeps its own share as the pivot row
        inverse[:] -= np.outer(step, inverse[out] / (step[out] + 1))
        columns[out] = pattern
        return True

    for done in range(rounds):
        duals = inverse.sum(0)
        total = float(x.sum())
        value, last = price(duals, lengths, size)
        bound = max(bound, total / max(value[size], 1))
        if total <= bound * (1 + gap) or value[size] <= 1 + 1e-9:
            break
        offers = sorted(((duals[row[int(n)]] + value[size - n], int(n)) for n in lengths), reverse=True)[:12]
        for worth, n in offers:
            if worth <= 1 + 1e-9:
                break
            pattern = Counter(_pattern(last, size - n))
            pattern[n] += 1
            if enter(dict(pattern)):
                entered += 1
                duals = inverse.sum(0)
    return [(p, float(v)) for p, v in zip(columns, x) if v > 1e-9], {"rounds": done, "entered": entered, "gap": float(x.sum()) / bound - 1}


def plan(counts: Pattern, size: int, gap: float = 5e-4) -> list[tuple[Pattern, int]]:
    """(pattern, times) that use up the histogram exactly."""
    solved, _ = generate(counts, size, gap)
    left = Counter({n: c for n, c in counts.items() if c > 0})
    used: Counter = Counter()
    for p, v in solved:
        used[tuple(sorted(p.items()))] += int(v + 1e-6)
    out = []
    for p, times in used.items():
        times = min([times, *(left[n] // k for n, k in p)])
        if times > 0:
            out.append((dict(p), times))
            for n, k in p:
                left[n] -= k * times
    return out + fill(left, size)
