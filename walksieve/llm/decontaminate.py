"""Benchmark decontamination: an Aho-Corasick automaton over the word windows of test items, one scan of every text.

Normalisation lower-cases A-Z and keeps words of digits, letters and characters beyond ASCII. A window is
`size` consecutive words of an item, a shorter item is one window. Windows are distinct sequences of word
numbers; the automaton's alphabet is the items' vocabulary, any other word of a text is number 0 and leads
back to the start. A text is read once: each match marks the words it covers and names its items, and word
numbers lead back to places in the original text.

Pairs of item and window are split by hash into shards of about `shard_pairs`, as many as the items need (one,
for benchmarks of usual size). Only one shard is on the driver or broadcast at a time, so memory is bounded
whatever the size of the benchmark; with several shards their matches are put together per text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

#: Words after lower-casing, on UTF-8: every byte of a character beyond ASCII is at least 0x80.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MATCHES = "words long, spans array<array<long>>, items array<string>"


def words(text: bytes) -> list[bytes]:
    """Normalised words; bytes.lower() changes A-Z alone."""
    return WORD.findall(text.lower())


def windows_of(text: bytes, size: int) -> list[bytes]:
    """Distinct windows, as words joined by spaces, in order."""
    w = words(text)
    if not w:
        return []
    return list(dict.fromkeys(b" ".join(w[i:i + size]) for i in range(max(len(w) - size, 0) + 1)))


def windows(items: DataFrame, *, size: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, window): the distinct windows of each item. Ids are text; a null id counts as empty text."""
    def cut(batches):
        for batch in batches:
            for part in slices([batch], 1 << 20, 4096, "text"):
                ids, made = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    own = windows_of(t or b"", size)
                    ids += [i] * len(own)
                    made += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(made, pa.binary())], names=["item", "window"])

    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "item string, window binary").distinct()


class Automaton:
    """Aho-Corasick automaton over word numbers. `find` gives merged runs [start, end) of covered words and the items met."""

    def __init__(self, table: list[tuple[bytes, list[str]]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.items = [i for _, i in table]
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.lengths = []
        for at, (window, _) in enumerate(table):
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window.split(b" "))
            self.tree.add_word(key, at)
            self.lengths.append(len(key))
        if table:
            self.tree.make_automaton()

    def find(self, text_words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        if not self.lengths or not text_words:
            return [], set()
        number = self.numbers.get
        runs: list[list[int]] = []
        met = set()
        for end, at in self.tree.iter(tuple(number(w, 0) for w in text_words)):
            met.add(at)
            start = end + 1 - self.lengths[at]
            # ends only grow; a longer window may begin before runs found so far
            while runs and runs[-1][0] >= start:
                runs.pop()
            if runs and runs[-1][1] >= start:
                runs[-1][1] = end + 1
            else:
                runs.append([start, end + 1])
        return runs, {i for at in met for i in self.items[at]}


def merged(runs: list[list[int]]) -> list[list[int]]:
    """Overlapping and touching runs as one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def places(text: bytes, runs: list[list[int]]) -> list[list[int]]:
    """Runs of words as [start, end) in characters of the original text."""
    if not runs:
        return []
    bounds = [m.span() for m in WORD.finditer(text.lower())]
    out, at, chars = [], 0, 0
    for a, b in runs:
        ends = []
        for byte in (bounds[a][0], bounds[b - 1][1]):
            chars += len(text[at:byte].decode("utf-8", "replace"))
            at = byte
            ends.append(chars)
        out.append(ends)
    return out


def _scanned(rows: DataFrame, kept: list[str], table: list[tuple[bytes, list[str]]]) -> DataFrame:
    """The kept columns of each row beside its number of words, word runs and items, by one shard's automaton."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(table)
    held: dict[int, Automaton] = {}

    def scan(batches):
        if 0 not in held:
            held[0] = Automaton(sent.value)
        automaton = held[0]
        for part in slices(batches, 4 << 20, 4096, "text"):
            counts, runs, items = [], [], []
            for t in part.column(part.num_columns - 1).cast(pa.binary()).to_pylist():
                w = words(t or b"")
                r, i = automaton.find(w)
                counts.append(len(w))
                runs.append(r)
                items.append(sorted(i))
            made = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*kept, "words", "spans", "items"])

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in kept) + _MATCHES
    return rows.select(*kept, "text").mapInArrow(scan, schema)


def matches(df: DataFrame, items: DataFrame, *, size: int = 10, text: str = "text", keep=("doc_id",), item: str = "item_id", item_text: str = "text",
            shard_pairs: int = 500_000) -> DataFrame:
    """One row per row of `df`: the `keep` columns, words (how many), spans (word runs [start, end) that windows cover, touching
    ones as one) and items (ids, as text, of the items met, sorted).

    Null and empty texts have no words. Items without words have no window; items without an id count as the empty id;
    repeated items and ids count once. Without items nothing matches. Repeated rows are judged each time.
    """
    kept = list(dict.fromkeys(keep))
    table = staged(windows(items, size=size, item=item, text=item_text), "windows")
    shards = max(1, -(-table.count() // shard_pairs))
    shard = F.pmod(F.xxhash64("window", "item"), F.lit(shards))

    def entries(n):  # one shard at a time: its size is bounded by shard_pairs
        own: dict[bytes, list[str]] = {}
        for r in table.where(shard == n).collect():
            own.setdefault(bytes(r["window"]), []).append(r["item"])
        return list(own.items())

    rows = df.select(*kept, F.col(text).alias("text"))
    if shards == 1:
        return _scanned(rows, kept, entries(0))
    # the rows of one text are alike: matches are put together per text and brought to the rows
    marked = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.octet_length(F.coalesce("text", F.lit("")))]
    rows = rows.withColumns({f"_mark{i}": m for i, m in enumerate(marked)})
    marks = [f"_mark{i}" for i in range(len(marked))]
    texts = staged(rows.select(*marks, "text").dropDuplicates(marks), "texts")
    parts = [staged(_scanned(texts, marks, entries(n)).where("size(spans) > 0"), "matches") for n in range(shards)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    flat = F.udf(lambda s: merged([r for part in s for r in part]), "array<array<long>>")
    one = every.groupBy(*marks).agg(flat(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    counted = _scanned(rows, [*kept, *marks], []).select(*kept, *marks, "words")
    found = counted.join(one, marks, "left")
    return found.select(*kept, "words", F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated_spans(df: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, places): for texts with matches, [start, end) in characters of the original text. `key` must be unique in both."""
    @F.udf("array<array<long>>")
    def where(t, spans):
        return places((t or "").encode(), [list(s) for s in spans])

    hit = found.where("size(spans) > 0").select(key, "spans")
    return df.select(key, text).join(hit, key).select(key, where(text, "spans").alias("places"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from `matches`: counts of words, of words hit and of items, hash of the sorted item ids, verdict."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s[1] - s[0])
    return found.select(key, F.col("words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
