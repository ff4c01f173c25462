"""URL allow and block lists as Bloom filter cascades over the corpus's own keys.

A rule is a host and a path prefix; it fits its host and every subdomain. The keys
that a URL can meet are its host's suffixes joined with its path's prefixes of the
lengths that rules have. A cascade over the listed keys L and the universe U of all
keys of the corpus alternates: level 1 holds L, level 2 the keys of U \\ L that pass
level 1, level 3 the keys of L that pass level 2, until none pass. For a key of U the
first level that rejects it decides, without a join and without error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged


@dataclass
class Bloom:
    """Bit words of one level; `level` seeds its hash functions, so levels err independently."""

    words: np.ndarray
    hashes: int
    level: int

    @staticmethod
    def empty(keys: int, fpr: float, level: int) -> "Bloom":
        return Bloom(np.zeros(max(1, math.ceil(-keys * math.log(fpr) / math.log(2) ** 2 / 64)), np.uint64), max(1, round(-math.log2(fpr))), level)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b = (_mix(h ^ np.uint64(0x9E3779B97F4A7C15 * (self.level + 1) % 2**64)) for h in (h1, h2))
        i = np.arange(self.hashes, dtype=np.uint64)
        return (a[:, None] + i * (b[:, None] | np.uint64(1))) % np.uint64(64 * len(self.words))

    def bits(self, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and words that hold the keys' bits."""
        p = np.unique(self.places(h1, h2))
        at, first = np.unique(p >> np.uint64(6), return_index=True)
        ones = np.uint64(1) << (p & np.uint64(63))
        return at.astype(np.int64), np.bitwise_or.reduceat(ones, first) if len(p) else ones

    def has(self, h1, h2) -> np.ndarray:
        p = self.places(h1, h2)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def passed_levels(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """How many levels in a row accept each key; an odd number means listed."""
    depth, alive = np.zeros(len(h1), np.int32), np.ones(len(h1), bool)
    for level in levels:
        alive[alive] = level.has(h1[alive], h2[alive])
        depth += alive
    return depth


def _hashes(key):
    return F.xxhash64(key, F.lit(0)).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")


def _u64(s) -> np.ndarray:
    return np.asarray(s, dtype=np.int64).view(np.uint64)


def _fill(level: Bloom, keys: DataFrame, key: str) -> Bloom:
    def run(batches):
        for b in batches:
            at, words = level.bits(_u64(b.column(0).to_numpy()), _u64(b.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words.view(np.int64))], names=["w", "v"])

    made = keys.select(*_hashes(F.col(key))).mapInArrow(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    words = level.words.copy()
    for w, v in made.toPandas().itertuples(index=False):
        words[w] = np.int64(v).view(np.uint64)
    return Bloom(words, level.hashes, level.level)


def _depth(shared):
    @F.pandas_udf("int")
    def depth(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(passed_levels(shared.value, _u64(h1), _u64(h2)))
    return depth


def build_cascade(listed: DataFrame, universe: DataFrame, *, key: str = "key", fpr: float = 0.01, max_mb: int = 256) -> list[Bloom]:
    """Levels for `listed` over `universe` (each with a column of keys without nulls).

    Levels are built on the executors as bit words combined by OR and gathered on the driver: about
    1.2 bytes per listed key at fpr 0.01, a hundredth of that for the false positives, and so on.
    A cascade above `max_mb` raises rather than being sent to every task.
    """
    spark = listed.sparkSession
    inside = current = listed.select(key).distinct()
    outside = universe.select(key)
    levels: list[Bloom] = []
    while n := current.count():
        level = Bloom.empty(n, fpr, len(levels))
        if sum(x.words.nbytes for x in [*levels, level]) > max_mb << 20:
            raise ValueError(f"the cascade would exceed {max_mb} MB")
        levels.append(_fill(level, current, key))
        depth = _depth(spark.sparkContext.broadcast(list(levels)))
        other = outside if len(levels) % 2 else current_inside
        passing = other.where(depth(*_hashes(F.col(key))) == len(levels))
        if len(levels) == 1:
            passing = passing.join(inside, key, "left_anti").distinct()
        passing = staged(passing, "cascade")
        if len(levels) % 2:
            outside, current_inside = passing, current
        else:
            current_inside = passing
        current = passing
    return levels


def split_url(url) -> tuple:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    bare = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(bare, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1)


def url_keys(lengths, labels_of):
    """Keys of columns host and path, longest first: host suffixes of as many labels as rules have x path prefixes of the rules' lengths.

    So a URL has as many keys as there are shapes of rules, however many labels its host has.
    """
    labels = F.split("host", r"\.")
    count = F.size(labels)
    hosts = F.array_compact(F.array(*[F.when(count >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(labels_of)]))
    paths = [F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths, reverse=True)]
    keys = F.flatten(F.transform(hosts, lambda h: F.array(*[F.concat(h, p) for p in paths])))
    keys = F.filter(keys, lambda k: k.isNotNull())
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.reverse(F.array_sort(keys, _by_length)))


def _by_length(a, b):
    n, m = F.char_length(a), F.char_length(b)
    return F.when(n < m, -1).when(n > m, 1).when(a < b, -1).when(a > b, 1).otherwise(0)


def filter_urls(pages: DataFrame, rules, *, url: str = "url", keep=("page_id",), default: str = "allow", fpr: float = 0.01) -> DataFrame:
    """Judge every URL by the longest fitting rule: the `keep` columns, host, path, rule, verdict.

    rules: (verdict, host, path) rows, verdict `allow` or `block`; a key under both verdicts counts as blocked.
    URLs that no rule fits get a null rule and `default`: the cascades prove that they are on no list. A null
    URL or one without `://` has empty host and path and fits no rule. Repeated rows are judged one by one.
    """
    spark = pages.sparkSession
    at = pages.select(*keep, F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    at = at.select(*keep, host.alias("host"), path.alias("path"))
    lengths = {len(p) for _, _, p in rules} or {0}
    shapes = {h.count(".") + 1 for _, h, _ in rules} or {1}
    universe = at.select("host", "path").distinct().select(F.explode(url_keys(lengths, shapes)).alias("key")).distinct()
    verdicts = {h + p: v for v, h, p in sorted(rules)}  # block comes after allow
    sides = {}
    for side in ("allow", "block"):
        listed = [(k,) for k, v in verdicts.items() if v == side]
        sides[side] = build_cascade(spark.createDataFrame(listed, "key string"), universe, fpr=fpr) if listed else []
    shared = spark.sparkContext.broadcast(sides)

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def judge(keys: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
        sizes = keys.map(len).to_numpy()
        flat1, flat2 = (_u64(np.concatenate([np.zeros(0, np.int64), *h])) for h in (h1, h2))
        hit = {s: passed_levels(lv, flat1, flat2) % 2 == 1 for s, lv in shared.value.items()}
        rule, verdict, at = [], [], 0
        for k, n in zip(keys, sizes):
            block, allow = hit["block"][at:at + n], hit["allow"][at:at + n]
            found = np.flatnonzero(block | allow)
            rule.append(k[found[0]] if len(found) else None)
            verdict.append(default if not len(found) else "block" if block[found[0]] else "allow")
            at += n
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    keyed = at.withColumn("keys", url_keys(lengths, shapes))
    hashed = keyed.select(*keep, "host", "path", "keys",
                          F.transform("keys", lambda k: F.xxhash64(k, F.lit(0))).alias("h1"),
                          F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))).alias("h2"))
    out = hashed.withColumn("j", judge("keys", "h1", "h2"))
    return out.select(*keep, "host", "path", F.col("j.rule").alias("rule"), F.col("j.verdict").alias("verdict"))
