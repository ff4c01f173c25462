"""Embedding whitening: exact fixed-point moments added up by Spark, leading components by spectrum slicing.

Each entry c becomes the integer x = floor(1024 c) + 100000. One scan adds up the rows and, per dimension, the x;
a second adds up products of x less the rounded mean, integers again, so sums are exact (and alike whatever the
order of rows) while they stay below 2**53, and rounded as doubles beyond. The driver keeps one covariance per
vector length, which grows with the dimensions and not with the rows, and finds its components (`spectrum`).
A third scan measures the covariance of the whitened rows, a fourth gives the result. No scan shuffles vectors:
a task sends one row of sums per dimension and block of 64 others.

Vectors of different lengths lie in different spaces: each length has a fit of its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import leading

UNIT, BASE = 1024, 100_000
BLOCK = 64
#: Entries at or above this size times 1/1024 have no exact fixed-point form.
LIMIT = float(2**52)


def usable(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per vector length of a list column: the places of its complete finite vectors and their x, whole numbers as doubles."""
    lens = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (lens > 0) & (wrong[ends] == wrong[ends - lens])
    out = []
    for d in np.unique(lens[good]).tolist():
        at = np.flatnonzero(good & (lens == d))
        x = np.floor(values[(ends[at] - d)[:, None] + np.arange(d)] * UNIT)
        if np.abs(x).max() >= LIMIT:
            raise ValueError(f"entries of vectors must be smaller than {LIMIT / UNIT:g}")
        out.append((at, x + BASE))
    return out


@dataclass(frozen=True)
class Space:
    """The fit of one vector length: rows, exact sums, whole centres and what they miss, components, eigenvalues, trace."""

    n: int
    sums: tuple[int, ...]
    centre: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; NaN along components without variance."""
        moved = ((x - self.centre) - self.rest) @ self.components
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.alive(), moved / np.sqrt(self.values), np.nan)

    def alive(self) -> np.ndarray:
        return self.values > 64 * len(self.centre) * np.finfo(float).eps * self.trace

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; None beyond a long."""
        centre = self.centre.astype(np.int64)
        rest = [s - self.n * int(c) for s, c in zip(self.sums, centre.tolist())]
        y = x.astype(np.int64) - centre
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
        kind = np.int64 if most * most * len(centre) < 2**63 else object
        z = y.astype(kind) * self.n - np.array(rest, dtype=kind)
        return [int(v) if v < 2**63 else None for v in (z * z).sum(axis=1)]


def _totals(df: DataFrame, add, width: int) -> DataFrame:
    """Sums over rows of what `add(length, x)` gives per batch: rows (i, block) of at most `width` doubles."""
    def task(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in usable(batch.column(0)):
                made = add(x)
                d = x.shape[1]
                held[d] = held[d] + made if d in held else made
        for d, m in held.items():
            at = [(i, j) for i in range(m.shape[0]) for j in range(0, m.shape[1], width)]
            parts = [m[i, j:j + width].tolist() for i, j in at]
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()),
                                              pa.array(parts, pa.list_(pa.float64()))], names=["d", "i", "j", "v"])

    rows = df.mapInArrow(task, "d int, i int, j int, v array<double>")
    return rows.groupBy("d", "i", "j").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(width)])


def _matrices(df: DataFrame, add, width: int, shapes) -> dict[int, np.ndarray]:
    """The summed matrix of each vector length: as many values as `shapes(length)` says, whatever the rows."""
    out: dict[int, np.ndarray] = {}
    for r in _totals(df, add, width).collect():
        m = out.setdefault(r["d"], np.zeros(shapes(r["d"])))
        n = min(width, m.shape[1] - r["j"])
        m[r["i"], r["j"]:r["j"] + n] = [r[f"v{k}"] for k in range(n)]
    return out


def _first(vectors: DataFrame) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Per vector length: rows and exact sums of x."""
    def task(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in usable(batch.column(0)):
                own = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
                own[0] += len(x)
                # halves of 26 bits add up without overflow
                whole = x.astype(np.int64)
                own[1] = own[1] + (whole >> 26).sum(axis=0).astype(object) * 2**26 + (whole & (2**26 - 1)).sum(axis=0).astype(object)
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                                              pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["d", "i", "n", "s"])

    found = vectors.mapInArrow(task, "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, list] = {}
    for r in found.collect():  # one row per dimension
        own = out.setdefault(r["d"], [0, [0] * r["d"]])
        own[0], own[1][r["i"]] = r["n"], int(r["s"])
    return {d: (n, tuple(s)) for d, (n, s) in out.items()}


def fit(vectors: DataFrame, *, components: int = 8) -> dict[int, Space]:
    """The fit of each vector length in a table of one list column."""
    first = _first(vectors)
    centres = {d: np.array([(2 * v + n) // (2 * n) for v in s], float) for d, (n, s) in first.items()}

    def products(x):
        y = x - centres[x.shape[1]]
        return np.vstack([y.T @ y, y.sum(axis=0)])

    spaces = {}
    for d, m in _matrices(vectors, products, BLOCK, lambda d: (d + 1, d)).items():
        n, sums = first[d]
        rest = np.array([float(Decimal(s - n * int(c)) / n) for s, c in zip(sums, centres[d].tolist())])
        v = m[:d] / n - np.outer(m[d] / n, m[d] / n)
        values, found = leading(v, components)
        spaces[d] = Space(n, sums, centres[d], rest, found, np.maximum(values, 0.0), float(np.trace(v)))
    return spaces


def identity_errors(vectors: DataFrame, spaces: dict[int, Space]) -> dict[int, float | None]:
    """Largest absolute entry of the whitened rows' measured covariance less the identity, per vector length; None without variance."""
    def products(x):
        w = np.nan_to_num(spaces[x.shape[1]].whitened(x))
        return np.vstack([w.T @ w, w.sum(axis=0)])

    out: dict[int, float | None] = dict.fromkeys(spaces)
    if spaces:
        width = max(len(s.values) for s in spaces.values())
        for d, m in _matrices(vectors, products, width, lambda d: (len(spaces[d].values) + 1, len(spaces[d].values))).items():
            s, k = spaces[d], len(spaces[d].values)
            off = np.abs(m[:k] / s.n - np.outer(m[k] / s.n, m[k] / s.n) - np.eye(k))[np.ix_(s.alive(), s.alive())]
            out[d] = float(off.max()) if off.size else None
    return out


def whiten(df: DataFrame, *, vector: str = "embedding", keep=("vec_id",), components: int = 8) -> DataFrame:
    """Per row with a complete finite vector and component: the `keep` columns, component (from 1), n, deviation, whitened,
    explained and identity_error.

    Null and empty vectors and those with null or non-finite entries give no row and take no part in the fit; a
    null id is kept. Repeated rows count and return each time. Vectors of d < components dimensions have d components.
    whitened is null along a component without variance, explained null where there is no variance at all, deviation
    null beyond a long. Equal eigenvalues share a subspace, of which some orthonormal basis is taken, the same for
    all rows. Entries of 2**42 and more raise an error.
    """
    kept = list(dict.fromkeys(keep))
    vectors = df.select(vector)
    spaces = fit(vectors, components=components)
    errors = identity_errors(vectors, spaces)

    def task(batches):
        for batch in batches:
            for at, x in usable(batch.column(batch.num_columns - 1)):
                s = spaces[x.shape[1]]
                k = len(s.values)
                w, times = s.whitened(x), np.repeat(np.arange(len(x)), k)
                head = batch.select(range(batch.num_columns - 1)).take(pa.array(np.repeat(at, k)))
                explained = s.values / s.trace if s.trace > 0 else np.full(k, np.nan)
                one = len(times)
                yield pa.RecordBatch.from_arrays([
                    *head.columns, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(one, s.n, np.int64)),
                    pa.array(s.deviations(x), pa.int64()).take(pa.array(times)), pa.array(w.ravel(), pa.float64(), from_pandas=True),
                    pa.array(np.tile(explained, len(x)), pa.float64(), from_pandas=True), pa.array([errors[x.shape[1]]] * one, pa.float64())],
                    names=[*kept, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    schema += "component int, n long, deviation long, whitened double, explained double, identity_error double"
    return df.select(*kept, F.col(vector).alias("_vector")).mapInArrow(task, schema)
