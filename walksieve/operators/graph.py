"""Correlation graphs between series and what is read from them.

Series travel as one row with their history (bounded by the calendar).  A grid of
tiles pairs ranges of series on the left with ranges on the right; the grid has a
fixed number of left ranges and a new right range per `RIGHT` series, so a series
is sent a few dozen times whatever the number of pairs.  Within a tile the
correlations of one origin are matrix products over chunks, reduced at once to
weighted sums or averages; the strongest peers come from bounds (`strongest`).  Pairs are therefore never
rows of a shuffle unless the caller asks for the edges themselves, which leave
chunk by chunk.  A tile costs the same for all series without inner gaps, so no
series or period can overload a task.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY, clip, div, flag, logit, sigmoid
from ..functions.ordering import pct_rank as _pct_rank
from .features import _diff, _ret
from .strongest import strongest

#: Series of a left range at least, left ranges at most, series of a right range at most.
LEAST, LEFT, RIGHT = 64, 32, 1 << 17
#: Rows and columns of the matrices that a task holds at a time.
CHUNK = (256, 512)
#: Rows at a time where only the pairs of a series with later ones are formed.
HALF = 64
TINY = 1e-12
#: Ranges of neighbours that a task takes one after the other.
COLUMNS = 64


def series_arrays(df: DataFrame, cols: list[str], by=BY) -> DataFrame:
    """One row per series: arrays over its dense positions, NaN where a value is missing."""
    nan = F.lit(float("nan"))
    cell = F.struct("position", *[F.coalesce(F.col(c).cast("double"), nan).alias(c) for c in cols])
    g = df.groupBy(*by, "series_id").agg(F.sort_array(F.collect_list(cell)).alias("_r"))
    return g.select(*by, "series_id", *[F.col(f"_r.{c}").alias(c) for c in cols])


def grid(df: DataFrame) -> tuple[int, int]:
    """Numbers of left and right ranges for the series of ``df``."""
    n = df.select("series_id").distinct().count()
    return max(1, min(LEFT, -(-n // LEAST))), max(1, -(-n // RIGHT))


def _tiles(arrays: DataFrame, blocks: tuple[int, int] | int, by, left: list[str], right: list[str], others: DataFrame | None = None) -> DataFrame:
    """Send each series to every tile it takes part in, with the arrays that side needs, tiles together and in order.

    Series on the right are those of ``others``, if given.
    """
    names = sorted(set(left) | set(right))
    blocks = (blocks, blocks) if isinstance(blocks, int) else blocks

    def side(rows, tag, used, own, other, n_own, n_other):
        null = F.lit(None).cast("array<double>")
        return rows.select(
            F.xxhash64(*by).alias("_k"), *by, "series_id", F.lit(tag).alias("side"),
            F.pmod(F.xxhash64("series_id"), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other),
            *[(F.col(c) if c in used else null).alias(c) for c in names])

    both = side(arrays, "L", left, "bi", "bj", *blocks).unionByName(side(arrays if others is None else others, "R", right, "bj", "bi", *blocks[::-1]))
    # a stated number: adaptive execution would put few bytes into one task, but a tile costs far more than its bytes
    return both.repartition(4 * blocks[0] * blocks[1], "_k", "bi", "bj").sortWithinPartitions("_k", "bi", "bj", "side", "series_id")


def _centred(x: np.ndarray) -> np.ndarray:
    return x - np.nanmean(np.where(np.isfinite(x), x, np.nan), axis=1, keepdims=True)


def _unit(x0, mask):
    """Rows centred and scaled over their masks, NaN without variation."""
    n = mask.sum(axis=1)
    d = (x0 - (x0.sum(axis=1) / np.maximum(n, 1.0))[:, None]) * mask
    ss = (d * d).sum(axis=1)
    ok = ss > TINY * np.maximum((x0 * x0).sum(axis=1), 1e-300)
    return d / np.sqrt(np.where(ok, ss, np.nan))[:, None], n


class _Window:
    """Series over one window.

    ``usual`` are the places where most series of this side have a value. ``full`` rows have values there and nowhere else;
    ``z`` are the rows as unit vectors over the places that they share with usual rows of the other side, ``n`` the
    numbers of these places, ``kinds`` the different sets of them among the rows with gaps and ``kind`` each row's.
    """

    def __init__(self, w: np.ndarray, usual: np.ndarray, other: np.ndarray):
        known = np.isfinite(w)
        full = (known == usual).all(axis=1)
        self.full, self.gaps = np.flatnonzero(full), np.flatnonzero(~full)
        self.x0, self.m = np.where(known, w, 0.0), known.astype(float)
        shared = self.m * other
        self.z, self.n = _unit(self.x0 * other, shared)
        self.kinds, kind = np.unique(shared[self.gaps], axis=0, return_inverse=True)
        self.kind = np.zeros(len(w), int)
        self.kind[self.gaps] = kind.ravel()
        self.shared = int((usual & other).sum())

    def per_kind(self, kinds: np.ndarray, rows) -> np.ndarray:
        """One over the deviations of some full rows over each of the other side's sets of places."""
        x0 = self.x0[rows]
        sx, sxx = kinds @ x0.T, kinds @ (x0 * x0).T
        v = sxx - sx * sx / np.maximum(kinds.sum(axis=1), 1.0)[:, None]
        return 1.0 / np.sqrt(np.where(v > TINY * np.maximum(sxx, 1e-300), v, np.nan))


def _masked(x0, mx, y0, my):
    """Pairwise-complete correlations and counts of rows with gaps on both sides."""
    n = mx @ my.T
    sx, sy, sxx, syy = x0 @ my.T, mx @ y0.T, (x0 * x0) @ my.T, mx @ (y0 * y0).T
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    c = (x0 @ y0.T - sx * sy / n) / np.sqrt(vx * vy)
    c[~(vx > TINY * np.maximum(sxx, 1e-300)) | ~(vy > TINY * np.maximum(syy, 1e-300))] = np.nan
    return c, n


def _chunks(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[s:s + size] for s in range(0, len(rows), size)]


def _windows(x: np.ndarray, y: np.ndarray, k: int, min_pairs: int, origins=None):
    """(period, left window, right window) of the origins that can hold enough pairs; periods count from 0."""
    x, y = _centred(x), _centred(y)
    ux, uy = (np.isfinite(v).mean(axis=0) > 0.5 for v in (x, y))
    lo, hi = origins or (1, x.shape[1])
    for t in range(max(lo, min_pairs, 1) - 1, min(hi, x.shape[1])):
        w = slice(max(0, t - k + 1), t + 1)
        yield t, _Window(x[:, w], ux[w], uy[w]), _Window(y[:, w], uy[w], ux[w])


def _matrices(x: _Window, y: _Window, min_pairs: int, full: bool = True, first: np.ndarray | None = None):
    """(left rows, right rows, correlations, counts); too few pairs or no variation give NaN. Without ``full``, only pairs with a gap.

    The product of a unit vector with any values is their covariance over its places, up to the values' deviation over
    these places; that is formed once per set of places. With ``first``, the first right row that each left one needs
    (rising), right rows before those of a chunk are left out.
    """
    size = CHUNK[0] if first is None else HALF
    xf, xg = _chunks(x.full, size), _chunks(x.gaps, size)
    per_x = [x.per_kind(y.kinds, i) for i in xf]  # right rows with gaps against full left rows
    cut = lambda c, n: (c if np.isscalar(n) else np.where(n < min_pairs, np.nan, c))
    after = lambda rows, i: 0 if first is None else int(np.searchsorted(rows, first[i[0]]))
    for start in range(0, len(y.kind), CHUNK[1]):
        in_chunk = lambda rows: rows[np.searchsorted(rows, start):np.searchsorted(rows, start + CHUNK[1])]
        yf, yg = in_chunk(y.full), in_chunk(y.gaps)
        if len(yf):
            if full and x.shared >= min_pairs:
                zy = y.z[yf]
                for i in xf:
                    if (a := after(yf, i)) < len(yf):
                        yield i, yf[a:], _bounded(x.z[i] @ zy[a:].T), x.shared
            if any(after(yf, i) < len(yf) for i in xg):
                per_y, y0 = y.per_kind(x.kinds, yf), y.x0[yf]
                for i in xg:
                    if (a := after(yf, i)) < len(yf):
                        n = x.n[i][:, None]
                        yield i, yf[a:], _bounded(cut((x.z[i] @ y0[a:].T) * per_y[x.kind[i], a:], n)), n
        if len(yg):
            zy, n = y.z[yg], y.n[yg][None, :]
            for i, per in zip(xf, per_x):
                if (a := after(yg, i)) < len(yg):
                    yield i, yg[a:], _bounded(cut((x.x0[i] @ zy[a:].T) * per[y.kind[yg[a:]]].T, n[:, a:])), n[:, a:]
            for i in xg:
                if (a := after(yg, i)) < len(yg):
                    c, m = _masked(x.x0[i], x.m[i], y.x0[yg[a:]], y.m[yg[a:]])
                    yield i, yg[a:], _bounded(cut(c, m)), m


def _bounded(c):
    return np.clip(c, -1.0, 1.0, out=c)


def _without_self(c, place, i, j):
    """No value for a series with itself; ``place`` is the right row of each left one."""
    at = np.minimum(np.searchsorted(j, place[i]), len(j) - 1)
    own = np.flatnonzero(j[at] == place[i])
    c[own, at[own]] = np.nan
    return c


def _run(arrays, blocks, by, left, right, fn, schema, others=None):
    """Apply ``fn(ids_i, left arrays, ids_j, right arrays) -> columns`` (lists, arrays or Arrow arrays by name) to every tile."""
    keys = ", ".join(f"{k} string" for k in by)
    out = f"{keys}, {schema}"
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    types = pa.schema([(c, kind[t]) for c, t in (x.strip().split(" ") for x in out.split(","))])
    stacked = lambda parts, c: np.vstack([v for p in parts for v in p[c]]).astype(float)

    def made(parts):
        sides = [[p[p["side"] == tag] for p in parts] for tag in "LR"]
        sides = [[p for p in s if len(p)] for s in sides]
        if not all(sides):
            return
        (l, r), head = sides, parts[0].iloc[0]
        ids = [np.concatenate([p["series_id"].to_numpy() for p in s]) for s in sides]
        with np.errstate(all="ignore"), warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # means of series without values
            for res in fn(ids[0], {c: stacked(l, c) for c in left}, ids[1], {c: stacked(r, c) for c in right}):
                n = len(next(iter(res.values())))
                if n:
                    res = {c: pa.repeat(pa.scalar(head[c], pa.string()), n) for c in by} | res
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, types.field(c).type) for c, v in ((c, res[c]) for c in names)], schema=types)

    def task(batches):
        held, now = [], None
        for pdf in (b.to_pandas() for b in batches):
            for key, own in pdf.groupby(["_k", "bi", "bj"], sort=False):
                if key != now and held:
                    yield from made(held)
                    held = []
                now = key
                held.append(own)
        if held:
            yield from made(held)

    return _tiles(arrays, blocks, by, left, right, others).mapInArrow(task, out)


def pair_corr(values: DataFrame, col: str, *, k: int = 60, min_pairs: int = 24, lead: str | None = None,
              origins: tuple[int, int] | None = None, blocks: tuple[int, int] | int | None = None, by=BY) -> DataFrame:
    """Edges (position, i, j, w, n) with a defined correlation.

    Without ``lead`` each unordered pair appears once with i < j; with ``lead`` the
    correlation is between ``col`` of i and ``lead`` of j and both orders appear.
    """
    other = lead or col

    def fn(ids_i, a, ids_j, b):
        first = np.searchsorted(ids_j, ids_i, side="right") if lead is None else None
        place, names_i, names_j = pd.Index(ids_j).get_indexer(ids_i), pa.array(ids_i, pa.string()), pa.array(ids_j, pa.string())
        for t, x, y in _windows(a[col], b[other], k, min_pairs, origins):
            for i, j, c, n in _matrices(x, y, min_pairs, first=first):
                r, q = np.nonzero(np.isfinite(c) & (j >= first[i][:, None] if lead is None else j != place[i][:, None]))
                yield {"position": np.full(len(r), t + 1, "int32"), "i": names_i.take(pa.array(i[r])), "j": names_j.take(pa.array(j[q])), "w": c[r, q],
                       "n": np.broadcast_to(n, c.shape)[r, q].astype("int64")}

    arrays = series_arrays(values, sorted({col, other}), by)
    return _run(arrays, blocks or grid(values), by, [col], [other], fn, "position int, i string, j string, w double, n bigint")


def _top_candidates(values, col, other, aux, k, min_pairs, top, blocks, by):
    """Strongest peers of i by rank, with the peer's own values at that period.

    Series with equal values are one node on the left. On the right each history has its first ``top + 1`` series, as no
    other can come before these. A node's first ``top + 1`` peers hold the first ``top`` of each of its series, without itself.
    """
    def fn(ids_i, a, ids_j, b):
        nobody, names_i, names_j = np.full(len(ids_i), -1), pa.array(ids_i, pa.string()), pa.array(ids_j, pa.string())
        gone = np.zeros(b[other].shape, bool)
        for name in aux["required"]:
            gone |= ~np.isfinite(b[name])
        for t, best_w, best_j in strongest(a[col], b[other], k=k, min_pairs=min_pairs, top=top + 1, place=nobody, gone=gone):
            i, r = np.nonzero(np.isfinite(best_w))
            j = best_j[i, r]
            d = {"position": np.full(len(i), t + 1, "int32"), "series_id": names_i.take(pa.array(i)), "peer": names_j.take(pa.array(j)), "w": best_w[i, r]}
            yield d | {name: b[name][j, t] for name in aux["carry"]}

    cols = sorted({col, other, *aux["carry"], *aux["required"]})
    right = sorted({other, *aux["carry"], *aux["required"]})
    schema = "position int, series_id string, peer string, w double" + "".join(f", {n} double" for n in aux["carry"])
    nodes = series_arrays(values, cols, by).groupBy(*by, *cols).agg(F.sort_array(F.collect_list("series_id")).alias("_ids"))
    lefts = nodes.select(*by, F.get("_ids", F.lit(0)).alias("series_id"), *cols)
    rights = nodes.select(*by, F.explode(F.slice("_ids", 1, top + 1)).alias("series_id"), *cols)
    # a stated number: a node's few bytes become the rows of all its series
    cand = _run(lefts, blocks or grid(values), by, [col], right, fn, schema, rights).withColumnRenamed("series_id", "_node").repartition(4 * LEFT, *by, "_node")
    best = cand.groupBy(*by, "position", "_node").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.abs("w")).alias("_o"), "peer", "w", *aux["carry"]))), 1, top + 1).alias("_best"))
    members = nodes.select(*by, F.get("_ids", F.lit(0)).alias("_node"), "_ids").repartition(4 * LEFT, *by, "_node").select(*by, "_node", F.explode("_ids").alias("series_id"))
    own = best.join(members, [*by, "_node"]).select(
        *by, "position", "series_id", F.posexplode(F.slice(F.filter("_best", lambda x: x["peer"] != F.col("series_id")), 1, top)).alias("_at", "_x"))
    return own.select(*by, "position", "series_id", "_x.peer", "_x.w", *[f"_x.{n}" for n in aux["carry"]], (F.col("_at") + 1).alias("rank"))


def peer_features(panel: DataFrame, *, k: int = 60, min_pairs: int = 24, top: int = 3, blocks=None, by=BY) -> DataFrame:
    """Strongest co-moving peers of each series: mean |corr|, signed best, direction consensus, count."""
    p = panel.withColumn("_d", _diff(0, by))
    p = p.withColumn("up", flag(F.col("_d") > 0))
    best = _top_candidates(p.select(*by, "series_id", "position", "_d", "up"), "_d", "_d",
                           {"carry": ["up"], "required": []}, k, min_pairs, top, blocks, by)
    up = F.when(~F.isnan("up"), F.col("up"))
    a = best.groupBy(*by, "position", "series_id").agg(
        F.avg(F.abs("w")).alias("peer_corr_abs_mean"),
        F.max(F.when(F.col("rank") == 1, F.col("w"))).alias("peer_corr_signed_top1"),
        div(F.sum(F.abs("w") * up), F.sum(F.when(up.isNotNull(), F.abs("w")))).alias("peer_direction_consensus"),
        F.count(F.lit(1)).cast("double").alias("peer_count"))
    return panel.select(*by, "series_id", "position").join(a, [*by, "series_id", "position"], "left").fillna(0.0, ["peer_count"])


def lead_features(panel: DataFrame, *, k: int = 60, min_pairs: int = 24, top: int = 3, blocks=None, by=BY) -> DataFrame:
    """Peers whose return leads a series by two periods, and what they signal now.

    At t the newest usable pair is (peer return at t-3, own return at t-1); the
    signal is the peer's newest return in units of its spread over the same window.
    """
    from ..functions.columns import series_window

    p = panel.withColumns({"_now": _ret(0, by), "_then": _ret(2, by)})
    sd = F.stddev_pop("_then").over(series_window(-(k - 1), 0, by))
    p = p.withColumn("_sd", sd).withColumn("z", clip(div(F.col("_now"), F.col("_sd")), -5.0, 5.0))
    # i is the responding series, its peers are the predictors
    best = _top_candidates(p.select(*by, "series_id", "position", "_now", "_then", "z"), "_now", "_then",
                           {"carry": ["z"], "required": ["z"]}, k, min_pairs, top, blocks, by)
    w, s = F.abs("w"), F.col("w") * F.col("z")
    a = best.groupBy(*by, "position", "series_id").agg(
        (-div(F.sum(s * w), F.sum(w))).alias("lead_peer_score"),
        div(F.sum(F.when(s < 0, w).otherwise(0.0)), F.sum(w)).alias("lead_negative_consensus"),
        F.avg(w).alias("lead_abs_correlation"), F.count(F.lit(1)).cast("double").alias("lead_peer_count"))
    return panel.select(*by, "series_id", "position").join(a, [*by, "series_id", "position"], "left").fillna(0.0, ["lead_peer_count"])


def average_pair_corr(panel: DataFrame, *, k: int = 12, min_obs: int = 8, min_series: int = 3, blocks=None, by=BY) -> DataFrame:
    """Mean correlation of all pairs with enough common history, per period.

    Correlations of series without gaps are products of unit vectors, so their sum over all pairs is the product of two
    vector sums; only pairs with a series that has a gap in the window are formed. Both orders of a pair count, a series
    with itself does not.
    """
    p = panel.withColumn("_r", _ret(0, by))

    def fn(ids_i, a, ids_j, b):
        place = pd.Index(ids_j).get_indexer(ids_i)
        for t, x, y in _windows(a["_r"], b["_r"], k, min_obs):
            zx, zy = (w.z[w.full] if x.shared >= min_obs else w.z[:0] for w in (x, y))
            zx, zy = (z[np.isfinite(z).all(axis=1)] for z in (zx, zy))
            # a series' product with itself is its square, 1
            own = x.full[np.isin(place[x.full], y.full) & (x.shared >= min_obs)]
            own = x.z[own][np.isfinite(x.z[own]).all(axis=1)]
            s, n = float(zx.sum(axis=0) @ zy.sum(axis=0) - (own * own).sum()), len(zx) * len(zy) - len(own)
            for i, j, c, _ in _matrices(x, y, min_obs, full=False):
                c = _without_self(c, place, i, j)
                ok = np.isfinite(c)
                s, n = s + float(c[ok].sum()), n + int(ok.sum())
            yield {"position": [t + 1], "s": [s], "n": [n]}

    parts = _run(series_arrays(p, ["_r"], by), blocks or grid(p), by, ["_r"], ["_r"], fn, "position int, s double, n bigint")
    m = parts.groupBy(*by, "position").agg(div(F.sum("s"), F.sum("n")).alias("average_correlation"))
    from ..functions.columns import series_window

    seen = p.select(*by, "position", (F.count("_r").over(series_window(-(k - 1), 0, by)) >= min_obs).alias("_ok"))
    live = seen.groupBy(*by, "position").agg(F.sum(F.col("_ok").cast("int")).alias("_k"))
    return live.join(m, [*by, "position"], "left").select(
        *by, "position", F.when(F.col("_k") >= min_series, F.col("average_correlation")).alias("average_correlation"))


def mirror(edges: DataFrame) -> DataFrame:
    """Both directions of an undirected graph; self loops are dropped."""
    e = edges.where(F.col("i") != F.col("j"))
    swapped = e.select(*[F.col("j").alias("i") if c == "i" else F.col("i").alias("j") if c == "j" else F.col(c) for c in e.columns])
    return e.unionByName(swapped)


def frozen_graph(panel: DataFrame, *, upto: int, min_pairs: int = 24, blocks=None, by=BY) -> DataFrame:
    """One graph from the changes known at ``upto``, for use at every later origin."""
    p = panel.withColumn("_d", _diff(0, by))
    return pair_corr(p, "_d", k=upto, min_pairs=min_pairs, origins=(upto, upto), blocks=blocks, by=by).drop("position")


def reliable_graph(edges: DataFrame, *, min_pairs: int, rows) -> DataFrame:
    """Shrink edges with little joint history: w * clip((n-min+1)/(rows-min+1), 0, 1)."""
    rows = rows if not isinstance(rows, int) else F.lit(rows)
    r = clip((F.col("n") - min_pairs + 1) / F.greatest(F.lit(1), rows - min_pairs + 1), 0.0, 1.0)
    return edges.withColumn("w", F.col("w") * r)


def propagate(scores: DataFrame, edges: DataFrame, *, p: str = "p", alpha: float = 0.35, out: str = "p_graph", by=BY) -> DataFrame:
    """Blend each log-odds with the |w|-normalised sum of its neighbours' log-odds.

    A series without neighbours is blended with zero, that is pulled toward 0.5.
    Edges without a position apply at every origin, edges without some columns of ``by`` to all their values.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha must be between 0 and 1")
    keys = [*by, "position"]
    z = scores.select(*keys, F.col("series_id").alias("j"), logit(F.col(p)).alias("_z"))
    e = mirror(edges).where(F.col("w").isNotNull())
    if "position" in edges.columns:
        n = z.join(e, [*[c for c in keys if c in edges.columns], "j"]).groupBy(*keys, F.col("i").alias("series_id")).agg(
            F.sum(F.col("w") * F.col("_z")).alias("_num"), F.sum(F.abs("w")).alias("_den"))
    else:
        own, place = [c for c in keys if c in e.columns], [c for c in keys if c not in e.columns]
        at = scores.withColumn("_m", F.xxhash64(*place))
        return _blend(at.join(_neighbour_sums(z, e, own, place), [*own, "_m", "series_id"], "left").drop("_m").select(*scores.columns, "_num", "_den"), p, alpha, out)
    j = scores.join(n, [*keys, "series_id"], "left")
    return _blend(j, p, alpha, out)


def _neighbour_sums(z: DataFrame, e: DataFrame, own: list[str], place: list[str]) -> DataFrame:
    """Sums of w z and |w| over the neighbours of each series, for edges that hold at every period (and candidate).

    A score is a column of a matrix of series by periods and candidates, so the sums are products of the graph with it.
    The graph is cut into a fixed number of ranges of rows. Each gets every series' scores once and adds up its products
    range by range of columns; an edge is sent once, whatever the number of periods and candidates. Periods and candidates
    are told apart by 64 bits, `_m`.
    """
    rows = z.groupBy(*own, "j").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(*place).alias("_m"), "_z"))).alias("_r"))
    k, side = F.xxhash64(*own), lambda c, n: F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int")
    null = lambda t: F.lit(None).cast(t)
    kind = e.schema["i"].dataType.simpleString()
    scored = rows.select(k.alias("_k"), *own, F.explode(F.sequence(F.lit(0), F.lit(LEFT - 1))).alias("bi"), side("j", COLUMNS).alias("bj"), F.lit(0).alias("tag"),
                         null(kind).alias("i"), F.col("j").cast(kind).alias("j"), null("double").alias("w"), F.col("_r._m").alias("_m"), F.col("_r._z").alias("_z"))
    linked = e.select(k.alias("_k"), *own, side("i", LEFT).alias("bi"), side("j", COLUMNS).alias("bj"), F.lit(1).alias("tag"),
                      "i", "j", F.col("w").cast("double").alias("w"), null("array<bigint>").alias("_m"), null("array<double>").alias("_z"))
    # a stated number: adaptive execution would put few bytes into one task, but products cost far more than their bytes
    both = scored.unionByName(linked).repartition(4 * LEFT, "_k", "bi").sortWithinPartitions("_k", "bi", "bj", "tag")

    def sums(held, at, places):
        # held: frames of one range of rows and one of columns; at: what the range of rows has so far; places: number of each period and candidate
        d = pd.concat(held, ignore_index=True)
        s, edge = d[d["tag"] == 0], d[d["tag"] == 1]
        if not len(s) or not len(edge):
            return
        r = np.repeat(np.arange(len(s)), [len(v) for v in s["_m"]])
        code, found = pd.factorize(np.concatenate(s["_m"].to_list()))
        c, v = np.array([places.setdefault(x, len(places)) for x in found.tolist()])[code], np.concatenate(s["_z"].to_list()).astype(float)
        value, known = np.zeros((len(s), len(places))), np.zeros((len(s), len(places)))
        known[r, c] = 1.0
        value[r, c] = np.where(np.isnan(v), 0.0, v)
        to = pd.Index(s["j"]).get_indexer(edge["j"])
        edge, to = edge[to >= 0], to[to >= 0]
        code, ids = pd.factorize(edge["i"])
        w, size, x = np.zeros((len(ids), len(s))), np.zeros((len(ids), len(s))), edge["w"].to_numpy()
        fine = np.isfinite(x)
        np.add.at(w, (code[fine], to[fine]), x[fine])
        np.add.at(size, (code[fine], to[fine]), np.abs(x[fine]))
        num, den = w @ value, size @ known
        for a, b, v in zip(code[~fine], to[~fine], x[~fine]):
            on = known[b] > 0
            num[a, on] += v * value[b, on]
            den[a, on] += abs(v)
        for name, a, b in zip(ids, num, den):
            if name in at:
                for old, more, i in zip(at[name], (a, b), (0, 1)):
                    more[:len(old)] += old
                    at[name][i] = more
            else:
                at[name] = [a, b]

    def left(head, at, places):
        m = np.array(list(places), dtype="int64")
        for name, (a, b) in at.items():
            q = np.flatnonzero(b != 0)
            yield pd.DataFrame({**{c: head[c] for c in own}, "series_id": name, "_m": m[q], "_num": a[q], "_den": b[q]})

    def task(batches):
        held, at, places, now, head = [], {}, {}, None, None
        for pdf in batches:
            for key, part in pdf.groupby(["_k", "bi", "bj"], sort=False):
                if key != now and held:
                    sums(held, at, places)
                    held = []
                    if key[:2] != now[:2]:
                        yield from left(head, at, places)
                        at, places = {}, {}
                now, head = key, part.iloc[0]
                held.append(part)
        if held:
            sums(held, at, places)
            yield from left(head, at, places)

    types = ", ".join(f"`{c}` {e.schema[c].dataType.simpleString()}" for c in own)
    return both.mapInPandas(task, f"{types}, series_id {kind}, _m bigint, _num double, _den double")


def _blend(j, p, alpha, out):
    near = F.coalesce(div(F.col("_num"), F.col("_den")), F.lit(0.0))
    q = sigmoid((1.0 - alpha) * logit(F.col(p)) + alpha * near)
    return j.withColumn(out, clip(q, 1e-6, 1.0 - 1e-6)).drop("_num", "_den")


def graph_overlay(panel: DataFrame, scores: DataFrame, *, p: str = "p_up_raw", k: int = 48, min_pairs: int = 24,
                  alpha: float = 0.35, prior: str | None = "prior", w_prior: float = 0.5, blocks=None, by=BY) -> DataFrame:
    """Rebuild the signed return graph at every origin, propagate, then blend with the prior.

    Neighbour sums are formed inside the block pairs, so the edges are never written.
    """
    keys = [*by, "position", "series_id"]
    d = panel.withColumn("_r", _ret(0, by)).join(scores.select(*keys, F.coalesce(logit(F.col(p)), F.lit(0.0)).alias("_z")), keys, "left")

    def fn(ids_i, a, ids_j, b):
        place = pd.Index(ids_j).get_indexer(ids_i)
        for t, x, y in _windows(a["_r"], b["_r"], k, min_pairs):
            z = b["_z"][:, t]
            known, z = np.isfinite(z), np.where(np.isfinite(z), z, 0.0)
            num, den = np.zeros(len(ids_i)), np.zeros(len(ids_i))
            rows = min(k, t)
            for i, j, c, n in _matrices(x, y, min_pairs):
                rel = np.clip((n - min_pairs + 1) / max(1, rows - min_pairs + 1), 0.0, 1.0)
                c = _without_self(c, place, i, j)
                w = np.where(np.isfinite(c) & known[j][None, :], c * rel, 0.0)
                num[i] += w @ z[j]
                den[i] += np.abs(w).sum(axis=1)
            q = np.flatnonzero(den > 0)
            yield {"position": np.full(len(q), t + 1, "int32"), "series_id": ids_i[q], "num": num[q], "den": den[q]}

    parts = _run(series_arrays(d, ["_r", "_z"], by), blocks or grid(panel), by, ["_r"], ["_r", "_z"], fn,
                 "position int, series_id string, num double, den double")
    sums = parts.groupBy(*keys).agg(F.sum("num").alias("_num"), F.sum("den").alias("_den"))
    s = scores.join(sums, keys, "left").withColumn("_p", F.coalesce(F.col(p), F.lit(0.5)))
    s = _blend(s, "_p", alpha, "p_graph").drop("_p")
    if prior is None:
        return s
    mix = w_prior * F.col(prior) + (1.0 - w_prior) * F.col("p_graph")
    return s.withColumns({"p_graph_prior": F.coalesce(mix, F.col("p_graph")), "graph_fit_through": F.col("position") - 1})


# ---- rolling principal components ------------------------------------------


def _standard(x: np.ndarray, k: int, t: int, min_obs: int):
    """Window ending at ``t`` (0-based), median-filled and standardised per series; only usable rows."""
    w = x[:, max(0, t - k + 1): t + 1]
    ok = np.isfinite(w).sum(axis=1) >= min_obs
    w = w[ok].copy()
    if len(w):
        med = np.nanmedian(w, axis=1, keepdims=True)
        w = np.where(np.isfinite(w), w, med)
        sd = w.std(axis=1, keepdims=True)
        w = np.where(sd > 0, (w - w.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1.0), 0.0)
    return ok, w


def rolling_pca(panel: DataFrame, *, k: int = 60, n: int = 2, min_obs: int = 24, by=BY) -> DataFrame:
    """Principal components of the last ``k`` changes at every origin.

    The period-by-period Gram matrix (k x k) is a sum over series, so tasks add
    up their own series; only the small sums meet.  Loadings come from a second
    pass over the series.  Signs make the largest loading positive.
    """
    p = panel.withColumn("_d", _diff(0, by))
    arrays = series_arrays(p, ["_d"], by)
    keys = ", ".join(f"{c} string" for c in by)
    names = list(by)

    def partial(batches):
        for pdf in batches:
            rows = []
            for key, g in pdf.groupby(names):
                x = np.vstack(g["_d"].to_numpy()).astype(float)
                for t in range(min_obs - 1, x.shape[1]):
                    ok, w = _standard(x, k, t, min_obs)
                    if len(w):
                        rows.append((*key, t + 1, int(ok.sum()), (w.T @ w).ravel()))
            yield pd.DataFrame(rows, columns=[*names, "position", "m", "gram"])

    grams = arrays.mapInPandas(partial, f"{keys}, position int, m bigint, gram array<double>")

    def solve(key, pdf):
        cols = [*names, "position", "component", "score", "explained", "sigma", "u"]
        if pdf["m"].sum() < 2:
            return pd.DataFrame(columns=cols)
        g = np.sum(np.vstack(pdf["gram"].to_numpy()), axis=0)
        size = int(round(len(g) ** 0.5))
        val, vec = np.linalg.eigh(g.reshape(size, size))
        val = np.maximum(val[::-1], 0.0)
        vec = vec[:, ::-1]
        total = val.sum()
        out = []
        for c in range(min(n, size, int(pdf["m"].sum()))):
            s = float(np.sqrt(val[c]))
            out.append((*key, c + 1, float(vec[-1, c] * s), float(val[c] / total) if total > 0 else None, s, vec[:, c].tolist()))
        return pd.DataFrame(out, columns=cols)

    parts = grams.groupBy(*names, "position").applyInPandas(
        solve, f"{keys}, position int, component int, score double, explained double, sigma double, u array<double>")

    # every series meets every (origin, component); that side has T x n rows of k numbers
    per = parts.groupBy(*names).agg(F.collect_list(F.struct("position", "component", "sigma", "u")).alias("parts"))
    both = arrays.join(per, names)

    def loads(batches):
        for pdf in batches:
            for key, g in pdf.groupby(names):
                # a panel's components are the same in all its rows; all series of the batch meet them together
                x, ids, at, w = np.vstack(g["_d"].to_numpy()).astype(float), g["series_id"].to_numpy(), None, None
                for q in sorted(g["parts"].iloc[0], key=lambda q: q["position"]):
                    if q["position"] != at:
                        at, (ok, w) = q["position"], _standard(x, k, q["position"] - 1, min_obs)
                    if q["sigma"] > 1e-12 and len(w):
                        yield pd.DataFrame({**dict(zip(names, key)), "series_id": ids[ok], "position": np.int32(at), "component": np.int32(q["component"]),
                                            "loading": w @ np.asarray(q["u"], dtype=float) / q["sigma"]})

    load = both.mapInPandas(loads, f"{keys}, series_id string, position int, component int, loading double")
    pivot = load.groupBy(*names, "position", "component").agg(
        F.signum(F.max_by("loading", F.struct(F.round(F.abs("loading"), 12), F.hash("series_id")))).alias("_s"))
    sign = F.when(F.col("_s") < 0, -1.0).otherwise(1.0)
    facts = parts.drop("u", "sigma").join(pivot, [*names, "position", "component"], "left").withColumn("score", F.col("score") * sign)
    signed = load.join(pivot, [*names, "position", "component"]).withColumn("loading", F.col("loading") * sign)
    first = lambda c, x: F.max(F.when(F.col("component") == c, F.col(x)))
    m = facts.groupBy(*names, "position").agg(*[
        e for c in range(1, n + 1) for e in (first(c, "score").alias(f"pca_factor_{c}"), first(c, "explained").alias(f"pca_explained_variance_{c}"))])
    l = signed.groupBy(*names, "series_id", "position").agg(*[first(c, "loading").alias(f"pca_loading_{c}") for c in range(1, n + 1)])
    return panel.select(*names, "series_id", "position").join(m, [*names, "position"], "left").join(l, [*names, "series_id", "position"], "left")


def feature_corr(df: DataFrame, families: dict[str, list[str]], by=BY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(within-family correlation, between-family centroid correlation, coverage).

    Features are few and fixed, so all correlations are one aggregate each.
    """
    pairs = [(f, a, b) for f, cols in families.items() for x, a in enumerate(cols) for b in cols[x + 1:]]
    within = None
    if pairs:
        row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (_, a, b) in enumerate(pairs)])
        items = F.array(*[F.struct(F.lit(f).alias("family"), F.abs(F.col(f"c{i}")).alias("r")) for i, (f, _, _) in enumerate(pairs)])
        within = row.select(F.explode(items).alias("x")).groupBy("x.family").agg(
            F.avg("x.r").alias("mean_abs_r"), F.max("x.r").alias("max_abs_r"), F.count(F.lit(1)).alias("pairs"))
    # rank all features in one long pass, then take the family means per row
    keys = [*by, "position", "series_id"]
    flat = [c for cols in families.values() for c in cols]
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in flat]).unpivot(keys, flat, "_f", "_x")
    ranked = _pct_rank(long, [*by, "position", "_f"], "_x", "_k")
    names = list(families)
    cross = [(a, b) for x, a in enumerate(names) for b in names[x + 1:]]
    centre = ranked.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("_f").isin(cols), F.col("_k"))).alias(f"f_{f}") for f, cols in families.items()])
    r2 = centre.agg(
        *[F.corr(f"f_{a}", f"f_{b}").alias(f"c{i}") for i, (a, b) in enumerate(cross)])
    between = r2.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("family_a"), F.lit(b).alias("family_b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(cross)])).alias("x")).select("x.*")
    cov = df.select("position", *[F.col(c).cast("double").alias(c) for c in flat]).unpivot("position", flat, "feature", "x").groupBy("feature").agg(
        (F.count("x") / F.count(F.lit(1))).alias("coverage"), F.min(F.when(F.col("x").isNotNull(), F.col("position"))).alias("first_position"))
    return within, between, cov
