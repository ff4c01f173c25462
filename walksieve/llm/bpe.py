"""Byte-level BPE: encode texts with a local rank file through tiktoken and decode ids back to bytes.

Long texts are cut before encoding at places where no match of the pre-splitting
pattern can reach across: between a character that is not white space and a
following space or line feed. Every match of the pattern is at most one leading
space and then no white space, or white space alone, so it ends there in any case,
and no look-ahead of an earlier match sees beyond a character that is not white space.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def load_ranks(path: str, max_bytes: int = 64 << 20) -> bytes:
    """The rank file's content, checked against the size that a broadcast may have."""
    if os.path.getsize(path) > max_bytes:
        raise ValueError(f"{path} is larger than {max_bytes} bytes")
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def pieces(text: str, chunk: int):
    """Parts of about `chunk` characters that can be encoded alone; a text without a safe boundary stays whole."""
    start = 0
    while len(text) - start > chunk:
        cut = _CUT.search(text, start + chunk)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(enc, text: str, chunk: int) -> np.ndarray:
    if len(text) <= chunk:
        return np.array(enc.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), "<u4") for p in pieces(text, chunk)])


def _map(df: DataFrame, schema: str, ranks: bytes, pattern: str, row, keep, source):
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        enc = encoding(shared.value, pattern)
        for b in batches:
            made = [row(enc, v) for v in b.column(b.schema.get_field_index(source)).to_pylist()]
            cols = [b.column(b.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([m[i] for m in made], t) for i, t in enumerate(row.types))], names=[*keep, *names])

    kept = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*dict.fromkeys([*keep, source])).mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def encode(df: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", keep=("doc_id",), chunk: int = 1 << 16) -> DataFrame:
    """One row per row of `df`: the `keep` columns, n_tokens and ids (binary, little-endian unsigned 32-bit).

    Null texts count as empty and give no ids. Special tokens are ordinary text.
    Other columns are not read; repeated rows and keys are encoded one by one.
    """
    def row(enc, v):
        ids = encode_text(enc, v or "", chunk)
        return len(ids), ids.tobytes()

    row.types = (pa.int64(), pa.binary())
    return _map(df, "n_tokens long, ids binary", ranks, pattern, row, keep, text)


def decode(df: DataFrame, ranks: bytes, pattern: str, *, ids: str = "ids", keep=("doc_id",)) -> DataFrame:
    """The raw bytes of packed ids, as column `bytes`; they need not be valid UTF-8. Null ids give null."""
    def row(enc, v):
        return (None if v is None else enc.decode_bytes(np.frombuffer(v, "<u4").tolist()),)

    row.types = (pa.binary(),)
    return _map(df, "bytes binary", ranks, pattern, row, keep, ids)


def round_trip(df: DataFrame, ranks: bytes, pattern: str, *, text: str = "text", keep=("doc_id",), chunk: int = 1 << 16) -> DataFrame:
    """Digests of `encode` then `decode` in one pass over the texts: n_tokens, ids_sha256, decoded_sha256."""
    def row(enc, v):
        ids = encode_text(enc, v or "", chunk)
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest()

    row.types = (pa.int64(), pa.string(), pa.string())
    return _map(df, "n_tokens long, ids_sha256 string, decoded_sha256 string", ranks, pattern, row, keep, text)
