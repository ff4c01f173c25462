"""Exact nearest neighbours by inner product with a table of distances to pivots.

For integer vectors q and c, 2 q.c = |q|^2 + |c|^2 - |q - c|^2, and every pivot p gives
|q - c| >= |d(q, p) - d(c, p)|. The largest of these lower bounds over all pivots is an
upper bound of the score. Candidates of a block are evaluated in the order of that bound,
and a query stops as soon as the next bound is below its k-th best score.

Rows are packed into blocks of vectors with their pivot distances. A task gets one block
of queries and a run of candidate blocks; it keeps k results per query over the whole run,
so later blocks start from a tight threshold. Runs are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

_BLOCK = "block long, dim int, n long, ids binary, vectors binary, distances binary"


def integer_vectors(df: DataFrame, *, key: str, vector: str, scale: float) -> DataFrame:
    """key, floor(scale * x) per component as longs; rows with a null key or a null, empty or non-finite vector take no part."""
    v = F.col(vector).cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(v, lambda x: F.floor(x * scale))
    return df.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole).select(F.col(key).cast("long").alias("id"), ints.alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64))


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, p = m.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(_norms(a)[:, None] + _norms(p)[None] - 2 * a @ p.T, 0))


def _pivots(vectors: DataFrame, dim: int, count: int) -> np.ndarray:
    """The `count` vectors of this dimension with the smallest hashed ids: a bounded, repeatable choice."""
    rows = vectors.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id", "v").limit(count).select("v").collect()
    return np.array([r[0] for r in rows], np.int64).reshape(-1, dim)


def _packed(vectors: DataFrame, pivots: dict[int, np.ndarray], rows: int, blocks: int, name: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def pack(key, t):
        block, dim = key[0].as_py(), key[1].as_py()
        t = t.sort_by([("id", "ascending")])
        ids, m = t["id"].to_numpy(), _matrix(t["v"].combine_chunks())
        out = []
        for at in range(0, len(ids), rows):
            part = np.ascontiguousarray(m[at:at + rows])
            d = _distances(part, shared.value[dim]).astype(np.float64)
            out.append((block, dim, len(part), ids[at:at + rows].astype("<i8").tobytes(), part.astype("<i8").tobytes(), d.tobytes()))
        names = ["block", "dim", "n", "ids", "vectors", "distances"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([o[i] for o in out], ty) for i, ty in enumerate(types)], names=names)

    keyed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.size("v").alias("dim"), "id", "v")
    return staged(keyed.groupBy("block", "dim").applyInArrow(pack, _BLOCK), name)


def _read(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["n"]
    return (np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<i8").reshape(n, -1), np.frombuffer(row["distances"]).reshape(n, -1))


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by floats where no sum can leave 53 bits, else by integers."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[-1]
    if most < 1 << 53:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return c @ q
    return np.clip(c.astype(object) @ q.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def search_block(best: list, queries, candidates, k: int, step: int) -> int:
    """Improve `best` (per query: ids and scores) with one block of candidates; returns how many pairs were evaluated."""
    qid, q, qd = queries
    cid, c, cd = candidates
    qn, cn = _norms(q), _norms(c)
    # single precision halves the work on the table; the bound is widened by more than it can err
    kind = np.float32 if max(qd.max(initial=0), cd.max(initial=0)) < 1e15 else np.float64
    table, own = np.ascontiguousarray(cd.T, dtype=kind), qd.astype(kind)
    low, gap, done = np.empty(len(cid), kind), np.empty(len(cid), kind), 0
    exact = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < 1 << 20
    small = c.astype(np.float64) if exact else None
    for i in range(len(qid)):
        low[:] = 0
        for p in range(len(table)):
            np.subtract(table[p], own[i, p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(low, gap, out=low)
        bound = (qn[i] + cn) * (0.5 + 1e-5) + 1e-3
        bound -= low.astype(np.float64) ** 2 / 2
        ids, scores = best[i]
        order = np.flatnonzero(bound >= scores[-1]) if len(scores) == k else np.arange(len(cid))
        order = order[np.argsort(-bound[order])]
        at, size = 0, step
        while at < len(order) and (len(scores) < k or bound[order[at]] >= scores[-1]):
            part = order[at:at + size]
            at, size = at + size, 2 * size  # weak bounds are met by longer looks, at most as many again as needed
            done += len(part)
            part = part[cid[part] != qid[i]]
            got = (small[part] @ q[i].astype(np.float64)).astype(np.int64) if exact else _scores(q[i], c[part])
            if len(scores) == k:
                part, got = part[got >= scores[-1]], got[got >= scores[-1]]
            all_ids, all_scores = np.concatenate([ids, cid[part]]), np.concatenate([scores, got])
            top = np.lexsort((all_ids, -all_scores))[:k]
            ids, scores = all_ids[top], all_scores[top]
        best[i] = (ids, scores)
    return done


def top_k(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, every: int = 20, k: int = 20,
          pivots: int = 16, query_rows: int = 256, block_rows: int = 8192, run_rows: int = 1 << 16, step: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`, candidates all other rows of the same dimension than the
    query's own id. A repeated id counts as one candidate per row, and as one query per row (rows of equal queries
    are merged by rank). Rows with a null id or a null, empty or non-finite vector take no part. Scores beyond
    64 bits are held at the limits. Memory of a task: one block of queries and one of candidates.
    """
    spark = df.sparkSession
    vectors = staged(integer_vectors(df, key=key, vector=vector, scale=scale), "vectors")
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    table = {d: _pivots(vectors, d, pivots) for d in sizes}
    total = sum(sizes.values())
    is_query = F.pmod(F.col("id"), F.lit(every)) == 0
    blocks = max(1, -(-total // block_rows))
    runs = max(1, -(-total // run_rows))
    query_blocks = max(1, -(-total // (every * query_rows)))
    candidates = _packed(vectors, table, block_rows, blocks, "candidates")
    queries = _packed(vectors.where(is_query).dropDuplicates(["id", "v"]), table, query_rows, query_blocks, "queries")

    def search(key_, left, right):
        out: list[list] = [[], [], []]
        blocks_ = sorted(right.to_pylist(), key=lambda r: (r["block"], r["ids"])) if right.num_rows else []
        for row in left.to_pylist():
            qs = _read(row)
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qs[0]]
            for b in blocks_:
                search_block(best, qs, _read(b), k, step)
            for q, (ids, scores) in zip(qs[0], best):
                out[0] += [int(q)] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    # every block of queries meets every run of candidate blocks; blocks are rows, so this is no product of vectors
    left = queries.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    right = candidates.withColumn("run", F.pmod(F.col("block"), F.lit(runs)).cast("int")) \
        .withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    left = left.withColumnRenamed("block", "query_block")
    found = left.groupBy("query_block", "run", "dim").cogroup(right.groupBy("query_block", "run", "dim")) \
        .applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
