"""Counts of n-grams over a whole corpus, without one row per n-gram.

Texts are packed into blocks. A block sends its distinct n-gram hashes, sorted and with
counts, to the buckets that their leading bits name; a bucket adds them up and answers
each block with the totals of the keys it sent, in the order sent. So each block holds
corpus-wide counts of all its n-grams, nothing is broadcast, and a frequent n-gram costs
one key per block. The number of buckets follows the bytes of text, so a bucket's size
does not; within a bucket only the bits after the leading ones are sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, staged

_REQUEST = "kind int, bucket long, block long, part int, keys binary, counts binary"
_ANSWER = "block long, kind int, bucket long, totals binary"


def pack(df: DataFrame, columns, text: str, *, part=None, block_bytes: int = 4 << 20, name: str = "blocks") -> DataFrame:
    """Blocks of about `block_bytes` of text: block, part, n_bytes, payload (compressed Arrow rows of `columns` and the text).

    `part` is an integer column expression (0 if none); rows of different parts go to different blocks. The result is
    written to the shared folder, so a block keeps its number in whatever reads it. A longer text is a block alone.
    """
    names = [*columns, "text"]
    chosen = df.select(*[F.col(c) for c in columns], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                       (F.lit(0) if part is None else part).cast("int").alias("_part"))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        sizes: dict[int, int] = {}

        def block(p):
            nonlocal number
            row = [number, p, sizes[p], _stream(pa.Table.from_batches(held[p]).combine_chunks())]
            number, held[p], sizes[p] = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                                              names=["block", "part", "n_bytes", "payload"])

        for b in batches:
            parts = b.column(len(names)).to_numpy()
            for p in np.unique(parts).tolist():
                own = b.filter(pa.array(parts == p)).select(names)
                for s in slices([own], block_bytes, 1 << 20, "text"):
                    size = pa.compute.sum(pa.compute.binary_length(s.column(len(columns)))).as_py()
                    if sizes.get(p) and sizes[p] + size > block_bytes:
                        yield block(p)
                    held.setdefault(p, []).append(s)
                    sizes[p] = sizes.get(p, 0) + size
        for p in list(held):
            if held[p]:
                yield block(p)

    return staged(chosen.mapInArrow(run, "block long, part int, n_bytes long, payload binary"), name)


def _stream(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def texts(t: pa.Table) -> list[bytes]:
    return t["text"].to_pylist()


def bucket_bits(blocks: DataFrame, bucket_bytes: int = 16 << 20) -> int:
    """Leading bits that name a bucket, so that one gets the n-grams of about bucket_bytes of text, and every core has some."""
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return min(24, math.ceil(math.log2(max(total / bucket_bytes, shuffle_partitions(blocks.sparkSession), 2))))


def _keys(h: np.ndarray, bits: int, width: int) -> bytes:
    kept = h << np.uint64(bits) >> np.uint64(64 - 8 * width) if width < 8 else h
    return np.ascontiguousarray(kept.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _hashes(data: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return raw.view("<u8").ravel()


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _squeeze(a: np.ndarray) -> bytes:
    a = _small(a)
    return bytes([a.itemsize]) + len(a).to_bytes(4, "little") + pa.compress(a.tobytes(), "zstd", asbytes=True)


def _widen(data: bytes) -> np.ndarray:
    size, n = data[0], int.from_bytes(data[1:5], "little")
    return np.frombuffer(pa.decompress(data[5:], size * n, "zstd", asbytes=True), f"<u{size}").astype(np.int64) if n else np.zeros(0, np.int64)


def edges(h: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys begin among sorted hashes; one more entry at the end."""
    limits = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(h, limits), len(h))


def totals(blocks: DataFrame, extract: Callable, bits: int, widths: tuple[int, ...], parts: int = 1, stat: Callable | None = None,
           name: str = "totals") -> DataFrame:
    """Answers for every block: block, kind, bucket, totals (packed, one row of `parts` counts per key).

    extract(table, part) gives, per kind, the sorted distinct hashes of a block and their counts; widths has the bytes of
    a hash that are sent per kind (8: all). Counts of blocks of part p go to the p-th total. stat(kind, totals) may give
    bytes that come as a row of block -1 per bucket.
    """
    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                out: list[list] = [[] for _ in range(6)]
                for kind, (h, n) in enumerate(extract(unpack(row["payload"]), row["part"])):
                    cut = edges(h, bits)
                    for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                        part = slice(cut[k], cut[k + 1])
                        for o, v in zip(out, (kind, k, row["block"], row["part"], _keys(h[part], bits, widths[kind]), _squeeze(n[part]))):
                            o.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    names=["kind", "bucket", "block", "part", "keys", "counts"])

    def add(key, t):
        kind, bucket = key[0].as_py(), key[1].as_py()
        keys = [_hashes(x, widths[kind]) for x in t["keys"].to_pylist()]
        counts = [_widen(x) for x in t["counts"].to_pylist()]
        found, where = np.unique(np.concatenate(keys), return_inverse=True)
        of = t["part"].to_pylist()
        sums = np.zeros((parts, len(found)), np.int64)
        spans = np.cumsum([0, *map(len, keys)])
        for i, c in enumerate(counts):
            if c.any():
                np.add.at(sums[of[i]], where[spans[i]:spans[i + 1]], c)
        blocks_, answers = t["block"].to_pylist(), []
        for i in range(len(keys)):
            answers.append(_squeeze(sums[:, where[spans[i]:spans[i + 1]]].T.ravel()))
        if stat is not None and (more := stat(kind, sums)) is not None:
            blocks_.append(-1)
            answers.append(more)
        n = len(blocks_)
        return pa.table([pa.array(blocks_, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(answers, pa.binary())],
                        names=["block", "kind", "bucket", "totals"])

    sent = blocks.select("block", "part", "payload").mapInArrow(send, _REQUEST)
    return staged(sent.groupBy("kind", "bucket").applyInArrow(add, _ANSWER), name)


def answered(rows: pa.Table, kind: int, parts: int = 1) -> np.ndarray:
    """The totals of one block's keys of a kind, in the order of its sorted hashes: shape (keys, parts)."""
    own = sorted((b, t) for b, k, t in zip(rows["bucket"].to_pylist(), rows["kind"].to_pylist(), rows["totals"].to_pylist()) if k == kind)
    return np.concatenate([np.zeros(0, np.int64), *(_widen(t) for _, t in own)]).reshape(-1, parts)


def with_totals(blocks: DataFrame, answers: DataFrame, make: Callable, schema: str) -> DataFrame:
    """make(block's rows, part, its answers) for every block; gives a table of `schema`."""
    empty = None

    def run(key, left, right):
        made = [make(unpack(r["payload"]), r["part"], right) for r in left.to_pylist()]
        return pa.concat_tables(made) if made else empty

    return blocks.select("block", "part", "payload").groupBy("block") \
        .cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(run, schema)
