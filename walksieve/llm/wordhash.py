"""Hashes of words and word n-grams of many texts at once, in NumPy.

Words are runs of bytes other than space and tab to carriage return; A-Z count as a-z.
A word's hash is a random-table polynomial of its bytes modulo 2**64, read off one running
sum over all texts, then mixed with its length; n-grams mix the hashes of their words.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BYTES[65:91] = _BYTES[97:123]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}

#: Hash of the token that ends a text.
END = _U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its start and its last word."""
    return mix(left * _U(0x2545F4914F6CDD1D) + right)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for k, base in (("up", _STEP), ("down", _BACK)):
            p = np.full(n, base, _U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def chunks(texts: list[bytes], size: int = 1 << 20):
    """Runs of texts of about `size` bytes; a longer text stands alone."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < size):
            held += len(texts[end]) + 1
            end += 1
        yield texts[at:end]
        at = end


def words(texts: list[bytes], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    made = [located(part)[:2] for part in chunks(texts, chunk)]
    return (np.concatenate([np.zeros(0, _U), *(h for h, _ in made)]), np.concatenate([np.zeros(0, np.int64), *(n for _, n in made)]))


def located(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Hashes and counts as `words` has them, the bytes of all texts, and where in them each word starts and stops."""
    joined = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[data]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = turn[::2], turn[1::2]
    up, down = _powers(len(data))
    run = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up, out=run[1:])
    h = mix((run[stop] - run[start]) * down[start] ^ (stop - start).astype(_U) * _U(0xA0761D6478BD642F))
    return h, np.diff(np.searchsorted(start, ends, "right"), prepend=0), joined, start, stop


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = 3) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence; of none, nothing."""
    run = hashes
    for i in range(1, k):
        run = join(run[:len(hashes) - i], hashes[i:]) if len(hashes) > i else np.zeros(0, _U)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(run[at:at + n - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            h = hashes[at]
            for w in hashes[at + 1:at + n]:
                h = join(np.array([h], _U), w)[0]
            out.append(mix(np.array([h], _U) + _U(n)))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out
