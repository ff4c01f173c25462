"""Packing of tokenised documents into sequences by cutting-stock column generation.

Every document is cut into whole sequences and one shorter rest, so only what exceeds a
sequence is cut. The histogram of piece lengths (at most `size` numbers) goes to the driver,
where `cutting.plan` decides how often to use which pattern of lengths. Pieces are ranked
within their length by counts per bucket, so a length that a third of all pieces share is
ranked in many tasks, and a piece's rank names its sequence and place there.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import cutting
from . import wordhash as H
from .common import staged


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


class WordIds:
    """Ids of texts, word by word, for a tokenizer that drops white space, ignores case and never reaches across a space.

    Distinct words, told apart by 64-bit hashes, are encoded once and kept as arrays. Beyond `most` words those used
    least are forgotten, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 1 << 20):
        self.encode, self.most = tokenizer(path).encode_batch_fast, most
        self.keys, self.first, self.size, self.uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        made = [e.ids for at in range(0, len(words), 20_000) for e in self.encode([w.decode() for w in words[at:at + 20_000]], add_special_tokens=False)]
        size = np.array([len(m) for m in made], np.int64)
        keys, size, uses = np.concatenate([self.keys, keys]), np.concatenate([self.size, size]), np.concatenate([self.uses, np.zeros(len(made), np.int64)])
        first = np.concatenate([self.first, len(self.ids) + np.cumsum(size[len(self.keys):]) - size[len(self.keys):]])
        self.ids = np.concatenate([self.ids, np.array([i for m in made for i in m], np.uint32)])
        order = np.argsort(keys)
        self.keys, self.first, self.size, self.uses = keys[order], first[order], size[order], uses[order]

    def _forget(self) -> None:
        if len(self.keys) > self.most:
            stay = np.sort(np.argsort(-self.uses, kind="stable")[:self.most // 2])
            ids = _gather(self.ids, self.first[stay], self.size[stay])
            self.keys, self.size, self.uses, self.ids = self.keys[stay], self.size[stay], self.uses[stay] // 2, ids
            self.first = np.cumsum(self.size) - self.size

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each has."""
        hashes, counts, data, start, stop = H.located(texts)
        own, one, where, uses = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, own)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == own if len(self.keys) else np.zeros(len(own), bool)
        if not known.all():
            self._learn(own[~known], [data[start[i]:stop[i]] for i in one[~known].tolist()])
            at = np.searchsorted(self.keys, own)
        self.uses[at] += uses
        size = self.size[at][where]
        ids = _gather(self.ids, self.first[at][where], size)
        self._forget()
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.cumsum(counts)], prepend=0)


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One store per Python worker, kept from task to task."""
    return WordIds(path)


def _gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def pieces(df: DataFrame, path: str, *, key: str, text: str, size: int, end_id: int) -> DataFrame:
    """One row per piece: key, doc_tokens, start, length, ids_crc32, uid (unique number)."""
    def run(batches):
        encode, uid = word_ids(path), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            took = []
            i = 0
            for texts in H.chunks(b.column(1).to_pylist(), 1 << 21):
                ids, counts = encode(texts)
                for own in np.split(ids, np.cumsum(counts)[:-1]):
                    own = np.append(own, np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), size):
                        part = own[at:at + size]
                        took.append(i)
                        for o, v in zip(out, (len(own), at, len(part), zlib.crc32(part.tobytes()), uid)):
                            o.append(v)
                        uid += 1
                    i += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(took, pa.int64())), *(pa.array(o, pa.int64()) for o in out)],
                                             names=[key, "doc_tokens", "start", "length", "ids_crc32", "uid"])

    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return staged(rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, doc_tokens long, start long, length long, ids_crc32 long, uid long"), "pieces")


def ranked(rows: DataFrame, *, group: str, order: str, bucket_rows: int = 50_000, least: int = 256) -> DataFrame:
    """`rows` with their rank (from 0) within `group`, by buckets of the hashed order column and then by it.

    Rows are ranked within (group, bucket) and shifted by the counts of earlier buckets; no group meets in one task.
    """
    buckets = max(least, -(-rows.count() // bucket_rows))
    at = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = at.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(W.partitionBy(group, "_b").orderBy(order))
    at = at.withColumn("_r", local).join(sizes.select(group, "_b", before.alias("_before")), [group, "_b"])
    return at.withColumn("rank", F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")


def slots(plan: list[tuple[cutting.Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, in order of rank: first rank, pieces per sequence, first sequence, offset of the first piece there."""
    out: dict[int, list] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            out.setdefault(n, []).append((used[n], pattern[n], sequence, offset))
            used[n] += pattern[n] * times
            offset += n * pattern[n]
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in out.items()}


def pack(df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, gap: float = 5e-4) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in a sequence).

    Null texts are empty and have the end id alone. Repeated rows and keys are packed each time, null keys are kept.
    An empty table gives no rows. Whole sequences come from long documents, the others hold several rests. Sequence
    numbers have no gaps. The plan's tables depend on `size` alone: at most `size` patterns of the linear program and
    the patterns of what rounding leaves, which is at most `size` sequences.
    """
    rows = pieces(df, path, key=key, text=text, size=size, end_id=end_id)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(size, 0)
    plan = cutting.plan(counts, size, gap) + ([({size: 1}, whole)] if whole else [])
    shared = df.sparkSession.sparkContext.broadcast(slots(plan))

    def place(batches):
        table = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = length == n
                first, per, begin, start = table[n]
                k = np.searchsorted(first, rank[own], "right") - 1
                at = rank[own] - first[k]
                sequence[own], offset[own] = begin[k] + at // per[k], start[k] + at % per[k] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [key, "start", "length", "ids_crc32", "doc_tokens"]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked(rows, group="length", order="uid").select(*names, "rank").mapInArrow(place, schema)
