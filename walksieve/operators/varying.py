"""Walk-forward logistic models of many configurations at once, with effects and slopes of their own per series.

A configuration is a list of features, a penalty, and optionally an effect per series and slopes per series for some
features. Its Hessian is an arrowhead: one block of shared coefficients, one small block per series, and nothing
between series. The series' block is eliminated where its rows are. Given the shared coefficients, each series
solves for its own by a few small Newton steps on its own history, and sends only the Schur complement, which
adds up over series to a Newton step on the shared block. So any number of series fits in memory: the driver
holds shared coefficients (configurations x panels x origins x features), tasks hold one series at a time.

Standardisation and starting points come from one table of cross moments per period. Rows enter it as
(1, values less a centre, missing flags), zero where missing; filling with the causal median and standardising are
linear maps of that, so prefix sums over periods give the means, deviations and the first Newton step of every
configuration and origin, and configurations cost no scan of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import BY
from .models import _panel, causal_medians

_BLOCK = 64
#: Origins whose designs a task holds at a time: they stay in its cache, and early origins leave out the rows after them.
_ORIGINS = 20


@dataclass(frozen=True)
class Config:
    """One model: features, features whose slope varies by series (among `cols`), an intercept per series, C, class weights."""

    name: str
    cols: tuple[str, ...]
    slopes: tuple[str, ...] = ()
    effect: bool = False
    c: float = 0.25
    balanced: bool = False

    @property
    def varies(self) -> bool:
        return self.effect or bool(self.slopes)


@dataclass
class _Fits:
    """Parameters of one configuration and panel; the first axis of all arrays is the fitted origins."""

    origins: np.ndarray
    fill: np.ndarray  # median less centre
    mean: np.ndarray  # mean less centre
    sd: np.ndarray
    flag_mean: np.ndarray
    flag_sd: np.ndarray
    weights: np.ndarray  # of classes 0 and 1
    beta: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def some(self, which) -> "_Fits":
        return _Fits(*[getattr(self, f)[which] for f in self.__dataclass_fields__])


def _summed(df: DataFrame, keys: list[str], width: int = _BLOCK) -> DataFrame:
    """Element-wise sums of array column `v`, cut into blocks by `at`: map-side sums, no group is gathered."""
    return df.groupBy(*keys, "at").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)])


def _blocks(head: tuple, values: np.ndarray):
    return [(*head, i, values[i:i + _BLOCK]) for i in range(0, len(values), _BLOCK)]


def _whole(blocks: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """Arrays by key, from their blocks."""
    t = blocks.toArrow()
    values = np.column_stack([t[f"v{i}"].to_numpy() for i in range(_BLOCK)]) if t.num_rows else np.zeros((0, _BLOCK))
    out: dict[tuple, list] = {}
    for row, (*key, at) in enumerate(zip(*[t[c].to_pylist() for c in (*keys, "at")])):
        out.setdefault(tuple(key), []).append((at, row))
    # the last block of an array is shorter: nulls at its end
    return {k: (lambda v: v[~np.isnan(v)])(np.concatenate([values[r] for _, r in sorted(at)])) for k, at in out.items()}


def _design(fits: _Fits, x: np.ndarray, gone: np.ndarray, at: list[int], flags: list[int]) -> np.ndarray:
    """(origins, rows, 1 + features + flags): each row as every origin's model sees it."""
    k, n = len(fits.origins), len(x)
    z = (x[None, :, at] + gone[None, :, at] * fits.fill[:, None] - fits.mean[:, None]) / fits.sd[:, None]
    m = (gone[None, :, flags] - fits.flag_mean[:, None]) / fits.flag_sd[:, None]
    return np.concatenate([np.ones((k, n, 1)), z, m], axis=2)


def _own(base, u, y, w, c, steps: int = 50, start=None):
    """Coefficients of one series for all origins: ridge-logistic on `u` with offset `base`, damped Newton, all origins together."""
    k, _, p = u.shape
    own = np.zeros((k, p)) if start is None else start.copy()

    def loss(g):
        e = base + np.einsum("onp,op->on", u, g)
        return (w * (np.logaddexp(0.0, e) - y * e)).sum(1) + (g * g).sum(1) / (2 * c), e

    now, e = loss(own)
    for _ in range(steps):
        mu = 1.0 / (1.0 + np.exp(-np.clip(e, -35, 35)))
        d = np.matmul((u * (w * mu * (1 - mu))[..., None]).transpose(0, 2, 1), u) + np.eye(p) / c
        step = np.linalg.solve(d, (np.einsum("onp,on->op", u, w * (y - mu)) - own / c)[..., None])[..., 0]
        new, e = loss(own + step)
        worse = new > now + 1e-12 * (1 + np.abs(now))
        while worse.any() and np.abs(step[worse]).max() > 1e-12:
            step[worse] /= 2
            new, e = loss(own + step)
            worse = new > now + 1e-12 * (1 + np.abs(now))
        own, now = own + step, new
        if np.abs(step).max(initial=0.0) < 1e-11:
            break
    return own


class VaryingFit:
    """What `fit_many` found. `score` and `coefficients` read the rows again, as a series' own coefficients live with its rows."""

    def __init__(self, cols, flags, configs, centres, fits, lag, by, y, lo, hi, ended):
        self.cols, self.flags, self.configs, self.centres, self.fits = cols, flags, configs, centres, fits
        self.lag, self.by, self.y, self.lo, self.hi, self.ended = lag, by, y, lo, hi, ended

    def report(self, spark) -> DataFrame:
        """Newton steps on the shared block, the last step's largest entry and whether it converged, per fit."""
        rows = [(n, *k.split("\x1f"), int(o), int(t), float(s), bool(ok)) for (n, k, o), (t, s, ok) in self.ended.items()]
        return spark.createDataFrame(rows, "config string, " + "".join(f"{c} string, " for c in self.by) + "origin int, steps int, last_step double, converged boolean")

    def _terms(self, config: Config) -> list[str]:
        return ["intercept", *config.cols, *[f"missing_{c}" for c in self.flags if c in config.cols]]

    def score(self, rows: DataFrame, out: str = "p") -> DataFrame:
        """Keys, config, y, `out` and fit_through of every row at a fitted origin, one row per configuration."""
        data, sent = _prepared(rows, self.cols, self.y, self.by), self._sent(rows)
        lag, by, lo, hi = self.lag, list(self.by), self.lo, self.hi

        def task(batches):
            model = _Model(sent.value)
            for pdf in _series(batches):
                for config, _, rows_, _, fits, z, u, own in model.solved(pdf, lag):
                    at = {o: i for i, o in enumerate(fits.origins.tolist())}
                    hit = [(r, at[p]) for r, p in enumerate(pdf["position"].to_numpy()[rows_].tolist()) if lo <= p <= hi and p in at]
                    if not hit:
                        continue
                    r, o = np.array(hit).T
                    e = (z[o, r] * fits.beta[o]).sum(1) + (0.0 if u is None else (u[o, r] * own[o]).sum(1))
                    got = pdf.iloc[rows_[r]][[*by, "series_id", "position"]].copy()
                    got["config"], got["_y"], got[out] = config.name, pdf["_y"].to_numpy()[rows_[r]], np.clip(1.0 / (1.0 + np.exp(-e)), 1e-6, 1 - 1e-6)
                    yield got

        keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*by, "series_id", "position"))
        made = data.mapInPandas(task, f"{keys}, config string, _y double, {out} double")
        return made.withColumnRenamed("_y", self.y).withColumn("fit_through", F.col("position") - lag - 1)

    def coefficients(self, rows: DataFrame) -> DataFrame:
        """(config, panel, origin, series_id, term, coefficient): shared terms without a series, the others with theirs."""
        spark, by = rows.sparkSession, list(self.by)
        shared = [(name, *k.split("\x1f"), int(o), None, t, float(v)) for (name, k), f in self.fits.items() for o, b in zip(f.origins, f.beta)
                  for t, v in zip(self._terms(self.configs[name]), b)]
        schema = "config string, " + "".join(f"{c} string, " for c in by) + "origin int, series_id string, term string, coefficient double"
        out = spark.createDataFrame(shared, schema)
        if not any(c.varies for c in self.configs.values()):
            return out
        data, sent, lag = _prepared(rows, self.cols, self.y, self.by), self._sent(rows), self.lag

        def task(batches):
            model = _Model(sent.value)
            for pdf in _series(batches):
                head, made = [str(pdf[c].iloc[0]) for c in by], []
                for config, _, _, _, fits, _, u, own in model.solved(pdf, lag):
                    if u is not None:
                        terms = (["effect"] if config.effect else []) + list(config.slopes)
                        made += [(config.name, *head, int(o), str(pdf["series_id"].iloc[0]), t, float(v)) for o, g in zip(fits.origins, own) for t, v in zip(terms, g)]
                if made:
                    yield pd.DataFrame(made, columns=["config", *by, "origin", "series_id", "term", "coefficient"])

        return out.unionByName(data.mapInPandas(task, schema))

    def _sent(self, rows: DataFrame):
        return rows.sparkSession.sparkContext.broadcast((self.cols, self.flags, self.configs, self.centres, self.fits))


class _Model:
    """Parameters as a task sees them."""

    def __init__(self, sent):
        self.cols, self.flags, self.configs, self.centres, self.fits = sent
        self.at = {n: [self.cols.index(x) for x in c.cols] for n, c in self.configs.items()}
        self.flagged = {n: [self.cols.index(x) for x in self.flags if x in c.cols] for n, c in self.configs.items()}
        self.slopes = {n: ([0] if c.effect else []) + [1 + list(c.cols).index(x) for x in c.slopes] for n, c in self.configs.items()}

    def raw(self, pdf):
        x = pdf[self.cols].to_numpy(dtype=float) - self.centres[pdf["_k"].iloc[0]]
        gone = (~np.isfinite(x)).astype(float)
        return np.where(gone > 0, 0.0, x), gone

    def solved(self, pdf, lag, only=None):
        """Per configuration of the rows' panel and few origins: their places among the fits, the rows up to the last of them,
        labels and weights, the fits, the rows' design, the series' part of it and the series' coefficients."""
        k = pdf["_k"].iloc[0]
        x, gone = self.raw(pdf)
        y, pos = pdf["_y"].to_numpy(dtype=float), pdf["position"].to_numpy()
        known = np.isfinite(y)
        yy = np.where(known, y, 0.0)
        for name, config in self.configs.items():
            whole = self.fits.get((name, k))
            if only is not None:
                whole = whole.some(only[name, k]) if whole is not None and (name, k) in only else None
            for start in range(0, 0 if whole is None else len(whole.origins), _ORIGINS):
                places = slice(start, start + _ORIGINS)
                fits = whole.some(places)
                r = np.flatnonzero(pos <= fits.origins.max())
                z = _design(fits, x[r], gone[r], self.at[name], self.flagged[name])
                u = own = None
                use = (pos[r][None] <= fits.origins[:, None] - lag - 1) & known[r][None]
                w = np.where(use, np.where(yy[r][None] > 0.5, fits.weights[:, 1:], fits.weights[:, :1]), 0.0)
                if config.varies:
                    u = z[:, :, self.slopes[name]]
                    own = _own(np.einsum("ond,od->on", z, fits.beta), u, yy[r][None], w, config.c)
                yield config, places, r, (yy[r], w), fits, z, u, own


def _prepared(rows: DataFrame, cols, y: str, by) -> DataFrame:
    """Rows with keys, label and features as doubles, each series together in one task and in order."""
    d = rows.select(*by, "series_id", "position", _panel(by).alias("_k"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    # a stated number: adaptive execution would put few bytes into one task, but fits cost far more than their bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "_k", "series_id").sortWithinPartitions("_k", "series_id", "position")


def _series(batches, least: int = 0):
    """Whole series from sorted batches; with `least`, several series of one panel together until there are so many rows."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if not len(pdf):
            continue
        series, panel = pdf["series_id"], pdf["_k"]
        new = ((series != series.shift()) & ~(series.isna() & series.shift().isna())) | (panel != panel.shift())
        starts = np.flatnonzero(new.to_numpy())
        if held and len(starts) and starts[0] == 0:
            last = held[-1].iloc[-1]
            same = last["_k"] == panel.iloc[0] and (last["series_id"] == series.iloc[0] or (pd.isna(last["series_id"]) and pd.isna(series.iloc[0])))
            if same:
                starts = starts[1:]
        at = 0
        for s in [*starts.tolist(), len(pdf)]:
            if s > at:
                held.append(pdf.iloc[at:s])
                n += s - at
            if s < len(pdf) and held and (n >= least or held[-1]["_k"].iloc[0] != panel.iloc[s]):
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
            at = s
    if held:
        yield pd.concat(held, ignore_index=True)


def fit_many(rows: DataFrame, configs: list[Config], *, y: str = "y_true", lo: int, hi: int, lag: int = 1, min_rows: int = 1, max_iter: int = 40,
             tol: float = 1e-8, by=BY) -> VaryingFit:
    """Fit every configuration for every panel and origin lo..hi on rows at positions <= origin - lag - 1.

    The loss is the weighted logistic loss plus |w|^2 / (2 C) over all coefficients but the intercept, those of series
    included. Missing values take the causal median and, where a feature has any, a flag. An origin is fitted where it
    knows min_rows rows and both labels. A series without known rows has coefficients 0. Rows without a label are scored only.
    """
    by, configs = tuple(by), list(configs)
    names = {c.name for c in configs}
    if len(names) < len(configs):
        raise ValueError("configurations need different names")
    for c in configs:
        if not set(c.slopes) <= set(c.cols):
            raise ValueError(f"slopes of {c.name} must be among its features")
    cols = list(dict.fromkeys(x for c in configs for x in c.cols))
    data = _prepared(rows.where(F.col("position") <= hi - lag - 1), cols, y, by).where("_y is not null").persist()
    try:
        spark = rows.sparkSession
        # one row per panel, features wide
        centres = {r["_k"]: np.array([r[f"c{i}"] or 0.0 for i in range(len(cols))]) for r in data.groupBy("_k").agg(
            *[F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"c{i}") for i, c in enumerate(cols)]).collect()}
        totals = _cross_moments(data, cols, centres)
        medians = {(r["_k"], r["origin"], r["feature"]): r["median"] for r in causal_medians(data.drop(*by), cols, lo, hi, lag=lag, by=("_k",)).collect()}
        flags = [c for j, c in enumerate(cols) if any(m[0][0, 1 + len(cols) + j] + m[1][0, 1 + len(cols) + j] > 0 for per in totals.values() for m in per.values())]
        fits = {(c.name, k): _start(c, cols, flags, per, centres[k], medians, k, lo, hi, lag, min_rows) for c in configs for k, per in totals.items()}
        fits = {key: f for key, f in fits.items() if len(f.origins)}
        ended = _iterate(spark, data, cols, flags, {c.name: c for c in configs}, centres, fits, lag, max_iter, tol)
        return VaryingFit(cols, flags, {c.name: c for c in configs}, centres, fits, lag, by, y, lo, hi, ended)
    finally:
        data.unpersist()


def _cross_moments(data: DataFrame, cols, centres) -> dict:
    """Panel -> position -> (moments of class 0, of class 1): sums of products of (1, values less centre, missing flags)."""
    width = 1 + 2 * len(cols)
    upper = np.triu_indices(width)

    def task(batches):
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for (k, p, label), own in pdf.groupby(["_k", "position", "_y"], sort=False):
                x = own[cols].to_numpy(dtype=float) - centres[k]
                gone = ~np.isfinite(x)
                v = np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, x), gone.astype(float)])
                key = (k, int(p), int(label > 0.5))
                held[key] = held.get(key, 0.0) + (v.T @ v)[upper]
        out = [row for key, v in held.items() for row in _blocks(key, v)]
        if out:
            yield pd.DataFrame(out, columns=["_k", "position", "label", "at", "v"])

    found = _summed(data.mapInPandas(task, "_k string, position int, label int, at int, v array<double>"), ["_k", "position", "label"])
    out: dict = {}
    for (k, p, label), v in _whole(found, ["_k", "position", "label"]).items():  # periods x features squared
        m = np.zeros((width, width))
        m[upper] = v
        own = out.setdefault(k, {}).setdefault(p, [np.zeros((width, width)), np.zeros((width, width))])
        own[label] = m + np.triu(m, 1).T
    return out


def _start(config: Config, cols, flags, per, centre, medians, k, lo, hi, lag, min_rows) -> _Fits:
    """Preprocessing of every origin and the first Newton step from zero, from prefix sums of the moments."""
    at = np.array([cols.index(x) for x in config.cols])
    mf = np.array([cols.index(x) for x in flags if x in config.cols], int)
    m = len(cols)
    run = [np.zeros((1 + 2 * m,) * 2), np.zeros((1 + 2 * m,) * 2)]
    places, used, made = sorted(per), 0, []
    for o in range(lo, hi + 1):
        while used < len(places) and places[used] <= o - lag - 1:
            run = [a + b for a, b in zip(run, per[places[used]])]
            used += 1
        n0, n1 = run[0][0, 0], run[1][0, 0]
        n = n0 + n1
        if n < max(min_rows, 1) or not n0 or not n1:
            continue
        total = run[0] + run[1]
        fill = np.array([medians.get((k, o, x), centre[j]) - centre[j] for j, x in zip(at, config.cols)])
        gone = total[0, 1 + m + at]
        mean = (total[0, 1 + at] + gone * fill) / n
        var = (total[1 + at, 1 + at] + gone * fill ** 2) / n - mean ** 2
        sd = np.sqrt(np.maximum(var, 0.0))
        sd = np.where(sd > 1e-9 * np.maximum(1.0, np.abs(mean + centre[at])), sd, 1.0)
        fm = total[0, 1 + m + mf] / n
        fs = np.sqrt(fm * (1 - fm))
        fs = np.where(fs > 0, fs, 1.0)
        weights = np.array([n / (2 * n0), n / (2 * n1)]) if config.balanced else np.ones(2)
        # the design as a linear map of (1, values, flags)
        d = 1 + len(at) + len(mf)
        t = np.zeros((1 + 2 * m, d))
        t[0, 0] = 1.0
        for i, j in enumerate(at):
            t[1 + j, 1 + i], t[1 + m + j, 1 + i], t[0, 1 + i] = 1 / sd[i], fill[i] / sd[i], -mean[i] / sd[i]
        for i, j in enumerate(mf):
            t[1 + m + j, 1 + len(at) + i], t[0, 1 + len(at) + i] = 1 / fs[i], -fm[i] / fs[i]
        h = t.T @ (weights[0] * run[0] + weights[1] * run[1]) @ t / 4 + np.diag(_penalty(config, d))
        g = 0.5 * t.T @ (weights[1] * run[1][:, 0] - weights[0] * run[0][:, 0])
        made.append((o, fill, mean, sd, fm, fs, weights, np.linalg.solve(h, g)))
    if not made:
        return _Fits(np.zeros(0, int), *[np.zeros((0, 0))] * 7)
    return _Fits(*[np.array(v) for v in zip(*made)])


def _penalty(config: Config, d: int) -> np.ndarray:
    pen = np.full(d, 1.0 / config.c)
    pen[0] = 1e-10
    return pen


def _iterate(spark, data, cols, flags, configs, centres, fits, lag, max_iter, tol) -> dict:
    """Newton steps on the shared blocks of all fits together, until each has converged; a step that raises the loss is halved."""
    live = {key: np.ones(len(f.origins), bool) for key, f in fits.items()}
    ended, last = {}, {}
    whole = any(c.varies for c in configs.values())
    for turn in range(1, max_iter + 1):
        only = {key: np.flatnonzero(m) for key, m in live.items() if m.any()}
        if not only:
            break
        sent = spark.sparkContext.broadcast((cols, flags, configs, centres, {key: fits[key] for key in only}))

        def task(batches, sent=sent, only=only):
            model, held = _Model(sent.value), {}
            for pdf in _series(batches, 0 if whole else 512):
                k = pdf["_k"].iloc[0]
                for config, places, _, (yy, w), f, z, u, own in model.solved(pdf, lag, only):
                    if not w.any():
                        continue
                    e = np.einsum("ond,od->on", z, f.beta)
                    if u is not None:
                        e = e + np.einsum("onp,op->on", u, own)
                    mu = 1.0 / (1.0 + np.exp(-np.clip(e, -35, 35)))
                    curve = (w * mu * (1 - mu))[..., None]
                    h = np.matmul((z * curve).transpose(0, 2, 1), z)
                    g = np.einsum("ond,on->od", z, w * (yy[None] - mu))
                    loss = (w * (np.logaddexp(0.0, e) - yy[None] * e)).sum(1)
                    if u is not None:
                        at = model.slopes[config.name]  # the series' part of the design is some of its columns
                        cross = h[:, :, at]
                        block = cross[:, at] + np.eye(u.shape[2]) / config.c
                        h = h - np.matmul(cross, np.linalg.solve(block, cross.transpose(0, 2, 1)))
                        loss = loss + (own * own).sum(1) / (2 * config.c)
                    i, j = np.triu_indices(z.shape[2])
                    key = (config.name, k)
                    if key not in held:
                        held[key] = np.zeros((len(only[key]), len(i) + z.shape[2] + 1))
                    held[key][places] += np.concatenate([h[:, i, j], g, loss[:, None]], axis=1)
            out = [row for (name, k), sums in held.items() for o, v in zip(only[name, k], sums) for row in _blocks((name, k, int(o)), v)]
            if out:
                yield pd.DataFrame(out, columns=["config", "_k", "origin", "at", "v"])

        def solved(key, parts, sent=sent):
            # the matrix stays here: the driver gets a loss and a step
            configs, fits = sent.value[2], sent.value[4]
            v = np.concatenate(parts).ravel()
            v, beta = v[~np.isnan(v)], fits[key[0], key[1]].beta[key[2]]
            d = len(beta)
            pen = _penalty(configs[key[0]], d)
            h = np.zeros((d, d))
            h[np.triu_indices(d)] = v[: d * (d + 1) // 2]
            h = h + np.triu(h, 1).T + np.diag(pen)
            try:
                step = np.linalg.solve(h, v[d * (d + 1) // 2:-1] - pen * beta)
            except np.linalg.LinAlgError:  # matters only if the fit is to go on from here
                step = np.full(d, np.nan)
            return (*key, v[-1] + 0.5 * float(pen @ beta ** 2), step)

        def solve(batches):
            now, parts = None, []
            for pdf in batches:
                v, out = pdf[[f"v{i}" for i in range(_BLOCK)]].to_numpy(dtype=float), []
                for r, key in enumerate(zip(pdf["config"], pdf["_k"], pdf["origin"])):
                    if key != now and parts:
                        out.append(solved(now, parts))
                        parts = []
                    now = key
                    parts.append(v[r])
                if out:
                    yield pd.DataFrame(out, columns=["config", "_k", "origin", "loss", "step"])
            if parts:
                yield pd.DataFrame([solved(now, parts)], columns=["config", "_k", "origin", "loss", "step"])

        of = ["config", "_k", "origin"]
        # a fit's sums meet in one task
        sums = _summed(data.mapInPandas(task, "config string, _k string, origin int, at int, v array<double>").repartition(*of), of)
        got = sums.sortWithinPartitions(*of, "at").mapInPandas(solve, "config string, _k string, origin int, loss double, step array<double>").toArrow()
        for name, k, i, loss, step in zip(*[got[c].to_pylist() for c in (*of, "loss", "step")]):  # one step per fit
            f, key, step = fits[name, k], (name, k, i), np.array(step)
            at = (name, k, int(f.origins[i]))
            if key in last and loss > last[key][0] + 1e-9 * (1 + abs(last[key][0])):
                before, beta, step = last[key]
                last[key] = (before, beta, step / 2)
                f.beta[i] = beta + step / 2
                ended[at] = (turn, float(np.abs(step / 2).max()), False)
                continue
            if np.isnan(step).any():
                raise np.linalg.LinAlgError(f"singular matrix in the fit {at}")
            last[key] = (loss, f.beta[i].copy(), step)
            f.beta[i] = f.beta[i] + step
            done = bool(np.abs(step).max() < tol)
            ended[at] = (turn, float(np.abs(step).max()), done)
            live[name, k][i] = not done
        sent.unpersist()
    return ended


def walk_forward_many(rows: DataFrame, configs: list[Config], *, lo: int, hi: int, y: str = "y_true", out: str = "p", **kw) -> DataFrame:
    """Fit and score all configurations: keys, config, y, p and fit_through, one row per row and configuration."""
    return fit_many(rows, configs, y=y, lo=lo, hi=hi, **kw).score(rows.where(F.col("position") <= hi), out=out)
