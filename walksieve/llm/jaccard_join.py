"""N-gram Jaccard join: blocked sparse products of document by n-gram incidence.

1. Texts are packed into blocks; every shingle's document count over the corpus comes back
   to the blocks that hold it (blockcounts). Equal sets are one node from here on.
2. A pair with 100 I >= t U shares one of the first n - ceil(t n / 100) + 1 shingles of each
   set in any common order. In the order of counts, rare first, texts whose rare shingles are
   theirs alone have no partner and leave here; the others are grouped by shared prefix shingles.
3. In each group every set is compared with one leader. Jaccard distance is a metric, so members
   linked with the leader are one component, and only members beyond it, with those near enough
   to reach them, remain. These meet in tiles of bounded size: a product of the tile's incidence
   matrices over blocks of columns counts overlaps, and pairs that their sizes or the columns
   left cannot bring to the bound are dropped. A tile gives a spanning forest of its links.
4. Components of these links, with the smallest document id of each.

Every step is exact for any group size: groups are split, never cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blockcounts as B
from . import wordhash as H
from .common import discard, staged
from .components import components


def _class(df: np.ndarray) -> np.ndarray:
    """Rank of a document count in the common order: eighths of an octave, 0 for a count of one."""
    return np.round(8 * np.log2(np.maximum(df, 1))).astype(np.int64)


def need(n, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def profile(df: DataFrame, *, key: str, text: str, k: int, percent: int, keep=()) -> DataFrame:
    """One row per row of `df`: key, the `keep` columns, n (set size), sig (digest of the set), rare (shingles of one document), and for
    rows that can have a partner also items (sorted hashes) and prefix (hashes to meet by)."""
    carried = list(dict.fromkeys([key, *keep]))
    blocks = B.pack(df, carried, text)
    bits = B.bucket_bits(blocks)

    def sets(t):
        return H.shingles(*H.words(B.texts(t)), k)

    def extract(t, part):
        return [np.unique(np.concatenate([np.zeros(0, np.uint64), *sets(t)]), return_counts=True)]

    def make(t, part, answers):
        own = sets(t)
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
        ranks = _class(B.answered(answers, 0)[:, 0])
        n, sig, rare, items, prefix = [], [], [], [], []
        for s in own:
            r = ranks[np.searchsorted(keys, s)]
            length = len(s) - need(len(s), percent) + 1 if len(s) else 0
            alone = int((r == 0).sum())
            n.append(len(s))
            sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
            rare.append(alone)
            if alone < length:
                first = np.lexsort((s, r))[alone:length]
                items.append(s.view(np.int64).tolist())
                prefix.append(s[first].view(np.int64).tolist())
            else:
                items.append(None)
                prefix.append(None)
        longs = pa.list_(pa.int64())
        return pa.table([*(t[c] for c in carried), pa.array(n, pa.int64()), pa.array(sig, pa.string()), pa.array(rare, pa.int64()), pa.array(items, longs), pa.array(prefix, longs)],
                        names=[*carried, "n", "sig", "rare", "items", "prefix"])

    # hashes keep the bucket's bits and four bytes more: a rare collision only makes a shingle look less rare, alike for all
    answers = B.totals(blocks, extract, bits, (4,), name="shingles")
    kept = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in carried)
    schema = f"{kept}n long, sig string, rare long, items array<bigint>, prefix array<bigint>"
    made = staged(B.with_totals(blocks, answers, make, schema), "profiles")
    discard(blocks, answers)
    return made


def tile_links(items: list[np.ndarray], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: positions (i, j), i < j."""
    sizes = np.array([len(x) for x in items], np.int64)
    flat = np.concatenate(items)
    of = np.repeat(np.arange(len(items)), sizes)
    names, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    of, column = of[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    least = -(-percent * (sizes[:, None] + sizes[None]) // (100 + percent))  # 100 I >= t (a + b - I)
    alive = (100 * np.minimum(sizes[:, None], sizes[None]) >= percent * np.maximum(sizes[:, None], sizes[None])) & (sizes > 0)[:, None]
    np.fill_diagonal(alive, False)
    left = np.bincount(of, minlength=len(items))
    overlap = np.zeros(alive.shape, np.int64)
    for at in range(0, int(column.max(initial=-1)) + 1, columns):
        rows = np.flatnonzero(alive.any(1))
        if not len(rows):
            break
        a, b = np.searchsorted(column, [at, at + columns])
        place = np.full(len(items), -1)
        place[rows] = np.arange(len(rows))
        keep = place[of[a:b]] >= 0
        m = np.zeros((len(rows), columns), np.float32)
        m[place[of[a:b][keep]], column[a:b][keep] - at] = 1
        overlap[np.ix_(rows, rows)] += (m @ m.T).astype(np.int64)
        left -= np.bincount(of[a:b], minlength=len(items))
        alive &= overlap + np.minimum(left[:, None], left[None]) >= least
    links = alive & (overlap >= least)
    forest, new = [], np.ones(len(items), bool)
    for root in range(len(items)):
        todo = [root] if new[root] else []
        new[root] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(links[i] & new).tolist():
                new[j] = False
                forest.append((min(i, j), max(i, j)))
                todo.append(j)
    return forest


def links(profiles: DataFrame, *, percent: int, tile_sets: int = 256, tile_items: int = 1 << 19) -> DataFrame:
    """(a, b): links between distinct sets, by signature, that span every component of the join."""
    nodes = staged(profiles.where("items is not null").select("sig", "n", "rare", "items", "prefix").dropDuplicates(["sig"]), "nodes")
    posts = nodes.select("sig", F.explode("prefix").alias("item"))
    hubs = posts.groupBy("item").agg(F.min("sig").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    groups = components(posts.join(hubs, "item").select("sig", "hub"), "sig", "hub")
    members = nodes.join(groups.withColumnRenamed("node", "sig"), "sig").select("component", "sig", "n", "rare", "items")
    # the leader has the smallest share of shingles of its own: nearest to what its group has in common
    lead = members.groupBy("component").agg(F.min_by("sig", F.struct(F.col("rare") / F.col("n"), "sig")).alias("lead"))
    lead = lead.join(nodes.select(F.col("sig").alias("lead"), F.col("items").alias("lead_items"), F.col("n").alias("lead_n")), "lead")
    met = members.join(lead, "component").where("sig != lead")
    met = met.withColumn("i", F.size(F.array_intersect("items", "lead_items"))).withColumn("u", F.col("n") + F.col("lead_n") - F.col("i"))
    linked = F.col("i") * 100 >= F.col("u") * percent
    met = staged(met.select("component", "sig", "lead", "n", "items", linked.alias("linked"), (1 - F.col("i") / F.col("u")).alias("far")), "met")
    stars = met.where("linked").select(F.col("sig").alias("a"), F.col("lead").alias("b"))

    # what is not linked with its leader: beside the others like it, only members this near to them can link with it
    reach = 1 - percent / 100
    beyond = met.where("not linked").groupBy("component").agg(F.min("far").alias("nearest"))
    open_ = met.join(beyond, "component").where((~F.col("linked")) | (F.col("far") + reach + 1e-9 >= F.col("nearest")))
    open_ = staged(open_.select("component", "sig", "n", "items"), "open")
    tiles = open_.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile_sets), F.ceil(F.sum("n") / tile_items)).alias("tiles"))
    placed = open_.join(tiles, "component").withColumn("t", F.pmod(F.xxhash64("sig"), F.col("tiles")))
    pairs = placed.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pairs = pairs.select("component", F.least("t", "s").alias("p"), F.greatest("t", "s").alias("q"), "sig", "items")

    def product(t):
        t = t.sort_by([("sig", "ascending")])
        sig = t["sig"].to_pylist()
        found = tile_links([np.asarray(x, np.int64) for x in t["items"].to_pylist()], percent)
        return pa.table([pa.array([sig[i] for i, _ in found], pa.string()), pa.array([sig[j] for _, j in found], pa.string())], names=["a", "b"])

    # dealt by the whole key: the join's partitioning by component alone would keep a large group's tiles together
    tiled = pairs.repartition("component", "p", "q").groupBy("component", "p", "q")
    made = staged(stars.unionByName(tiled.applyInArrow(product, "a string, b string")), "links")
    discard(nodes, met, open_)
    return made


def join(df: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90, keep=(), component: str | None = None) -> DataFrame:
    """One row per row of `df`: key, the `keep` columns, n_shingles, component_id, set_id (digest of the shingle set), and under
    the name `component`, if given, the smallest set_id that links reach (null for empty sets).

    Rows link when 100 * overlap >= percent * union of their sets of k-word shingles; component_id is the smallest key
    that links reach. Null and empty texts have an empty set and stand alone, with their own key. Equal sets always
    link. A repeated key is one row each time; null keys never name a component unless all its keys are null.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie in 50..100")
    carried = list(dict.fromkeys([key, *keep]))
    rows = profile(df.select(*dict.fromkeys([*carried, text])), key=key, text=text, k=k, percent=percent, keep=keep)
    narrow = rows.select(*carried, "n", "sig")
    found = links(rows, percent=percent)
    whole = components(found, "a", "b")
    discard(found)
    classes = narrow.where("n > 0").groupBy("sig").agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("m"))
    classes = staged(classes.join(whole.withColumnRenamed("node", "sig"), "sig", "left").where("m > 1 or component is not null")
                     .select("sig", "low", F.coalesce("component", "sig").alias("component")), "classes")
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = classes.join(lows, "component").select("sig", "component_id", "component")
    out = narrow.withColumn("sig_key", F.when(F.col("n") > 0, F.col("sig")))
    out = out.join(named.select(F.col("sig").alias("sig_key"), "component_id", F.col("component").alias("_component")), "sig_key", "left")
    return out.select(*carried, F.col("n").alias("n_shingles"), F.coalesce("component_id", key).alias("component_id"), F.col("sig").alias("set_id"),
                      *([F.coalesce("_component", "sig_key").alias(component)] if component else []))
