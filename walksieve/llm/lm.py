"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of a word given the word before it, of the word
alone, and a uniform share for words never seen:

    p1(w)     = l0 * c(w) / N + (1 - l0) / (V + 1)
    p2(w | h) = l[b] * c(h, w) / c(h) + (1 - l[b]) * p1(w),   b = floor(log2(c(h) + 1))

Weights belong to buckets of the context's frequency. They are learned by expectation
maximisation on counts held out of training: one fold of the training rows is set aside, counts
come from the rest, and the likelihood of the held-out tokens is raised. For a two-part mixture
only the ratio of its parts matters, so held-out tokens enter as counts per bucket and
logarithmic ratio in steps of 1/32 octave; that table is small whatever the corpus. Scores then
use the learned weights with the counts of all training rows. Counts cover the whole corpus and
come back to the blocks of texts as blockcounts has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blockcounts as B
from . import wordhash as H

#: Parts of the corpus: rows that train, training rows whose tokens fit the weights, rows only scored.
TRAIN, FIT, SCORE_ONLY = 0, 1, 2
_STEPS = 32
_WIDTHS = (8, 5)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, of their pairs with the token before, and tokens per text. A text ends with a token
    that also stands before its first word."""
    words, counts = H.words(texts)
    per = counts + 1
    ends = np.cumsum(per) - 1
    all_ = np.empty(len(words) + len(texts), np.uint64)
    is_end = np.zeros(len(all_), bool)
    is_end[ends] = True
    all_[is_end] = H.END
    all_[~is_end] = words
    before = np.concatenate([np.array([H.END], np.uint64), all_[:-1]])[:len(all_)]
    return all_, H.join(before, all_), per


def _extract(t, part):
    words, pairs, _ = tokens(B.texts(t))
    out = []
    for h in (words, pairs):
        keys, counts = np.unique(h, return_counts=True)
        out.append((keys, counts if part != SCORE_ONLY else np.zeros_like(counts)))
    return out


def _bins(ratio: np.ndarray) -> np.ndarray:
    """Step of the ratio's logarithm; the least value stands for 0."""
    with np.errstate(divide="ignore"):
        steps = np.round(_STEPS * np.log2(ratio))
    return np.where(ratio > 0, np.clip(steps, -30000, 30000), -32768).astype(np.int64)


def _ratios(bins: np.ndarray) -> np.ndarray:
    return np.where(bins == -32768, 0.0, np.exp2(bins / _STEPS))


def weight(bins: np.ndarray, counts: np.ndarray, rounds: int = 200) -> float:
    """Mixture weight of the first part, from held-out counts per ratio first : second. One pseudo-token is shared evenly."""
    r, n, w = _ratios(bins), counts.astype(np.float64), 0.5
    for _ in range(rounds):
        w = ((n * (w * r / (w * r + 1 - w))).sum() + 0.5) / (n.sum() + 1)
    return float(w)


def buckets(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(context + 1.0)).astype(np.int64)


def _stat(kind, sums):
    """Of one bucket of words: totals, vocabularies, and held-out tokens per training count."""
    if kind != 0:
        return None
    train, fit = sums[TRAIN], sums[FIT]
    held = fit > 0
    c, where = np.unique(train[held], return_inverse=True)
    per = np.zeros(len(c), np.int64)
    np.add.at(per, where, fit[held])
    head = np.array([train.sum(), (train > 0).sum(), (train + fit).sum(), (train + fit > 0).sum(), len(c)], "<i8")
    return head.tobytes() + _coarse(c, per)


def _coarse(c: np.ndarray, n: np.ndarray) -> bytes:
    """Counts up to 1024 as they are, larger ones by 1/32 octave."""
    step = np.where(c > 1024, np.round(np.exp2(np.round(_STEPS * np.log2(np.maximum(c, 1))) / _STEPS)), c).astype(np.int64)
    u, w = np.unique(step, return_inverse=True)
    s = np.zeros(len(u), np.int64)
    np.add.at(s, w, n)
    return np.concatenate([u, s]).astype("<i8").tobytes()


def _totals(answers: DataFrame) -> dict:
    """Corpus totals and the base weight, from one small row per bucket, summed before they reach the driver."""
    def read(batches):
        for b in batches:
            out: list[tuple] = []
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, "<i8")
                out += [(f"total{i}", 0, int(v[i])) for i in range(4)]
                u, s = v[5:].reshape(2, -1)
                out += [("held", int(c), int(n)) for c, n in zip(u, s)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["what", "c", "n"])

    rows = answers.where("block = -1").select("totals").mapInArrow(read, "what string, c long, n long").groupBy("what", "c").agg(F.sum("n").alias("n")).collect()
    got = {(r["what"], r["c"]): r["n"] for r in rows}
    n_est, v_est, n_all, v_all = (got.get((f"total{i}", 0), 0) for i in range(4))
    held = [(c, n) for (what, c), n in got.items() if what == "held"]
    base = 0.5
    if held and n_est:
        c, n = (np.array(x, np.float64) for x in zip(*held))
        base = weight(_bins(c / n_est * (v_est + 1)), n)
    return {"n_est": n_est, "v_est": v_est, "n": n_all, "v": v_all, "base": base}


def _known(words, pairs, answers, column):
    """Counts of every token, of its pair and of the token before, by the answers' column (or the sum of both)."""
    out = []
    for kind, h in enumerate((words, pairs)):
        keys, where = np.unique(h, return_inverse=True)
        got = B.answered(answers, kind, 2)
        out.append((got.sum(1) if column is None else got[:, column])[where])
    c1, c2 = out
    # a token's context is the token before it; a text's first word follows an end, as does a block's
    end = c1[np.flatnonzero(words == H.END)[0]] if len(words) else 0
    before = np.concatenate([[end], c1[:-1]])[:len(c1)]
    return c1, c2, before


def _unigram(c, n, v, base):
    return base * c / max(n, 1) + (1 - base) / (v + 1)


def fit_weights(blocks: DataFrame, answers: DataFrame, totals: dict) -> np.ndarray:
    """Weight per bucket of context frequency (index), learned on the FIT blocks."""
    n, v, base = totals["n_est"], totals["v_est"], totals["base"]

    def ratios(t, part, got):
        words, pairs, _ = tokens(B.texts(t))
        c1, c2, before = _known(words, pairs, got, TRAIN)
        seen = before > 0
        r = (c2[seen] / before[seen]) / _unigram(c1[seen], n, v, base)
        key, count = np.unique(buckets(before[seen]) * 65536 + _bins(r) + 32768, return_counts=True)
        return pa.table([pa.array(key // 65536), pa.array(key % 65536 - 32768), pa.array(count)], names=["bucket", "bin", "n"])

    fit = blocks.where(F.col("part") == FIT)
    table = B.with_totals(fit, answers.join(fit.select("block"), "block", "left_semi"), ratios, "bucket long, bin long, n long")
    rows = table.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect()
    weights, last = np.zeros(64), 0.0
    for b in range(1, 64):
        own = [(r["bin"], r["n"]) for r in rows if r["bucket"] == b]
        if own:
            bins, counts = (np.array(x) for x in zip(*own))
            last = weight(bins, counts)
        weights[b] = min(last, 1 - 1e-6)
    return weights


def score(df: DataFrame, *, part, key: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of `df`: key, part, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    `part` is a column expression with TRAIN, FIT (training rows that also fit the weights) or SCORE_ONLY per row.
    Null texts are empty and hold the end token alone. Repeated rows train and are scored each time, null keys are
    kept. Without training rows every word is unknown and has the uniform share; base_score is then log10(1) per
    token. Without FIT rows all weights of pairs are 0. Pairs are told apart by 40 bits beside their bucket's.
    """
    blocks = B.pack(df, [key], text, part=part, block_bytes=block_bytes)
    answers = B.totals(blocks, _extract, B.bucket_bits(blocks), _WIDTHS, parts=2, stat=_stat)
    totals = _totals(answers)
    weights = fit_weights(blocks, answers, totals)
    n, v, base = totals["n"], totals["v"], totals["base"]

    def make(t, part_, got):
        words, pairs, per = tokens(B.texts(t))
        c1, c2, before = _known(words, pairs, got, None)
        p1 = _unigram(c1, n, v, base)
        w = weights[buckets(before)]
        p = w * c2 / np.maximum(before, 1) + (1 - w) * p1
        starts = np.cumsum(per) - per
        unigram = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
        sums = [np.add.reduceat(x, starts) for x in ((c1 > 0).astype(np.int64), unigram, np.log10(p))]
        rows = len(per)
        return pa.table([t[key], pa.array([part_] * rows, pa.int32()), pa.array(per), pa.array(sums[0]), pa.array([n] * rows, pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
                        names=[key, "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.with_totals(blocks, answers, make, schema)
