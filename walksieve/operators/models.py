"""Walk-forward models: every origin has its own fit on the rows known to it.

Pooled logistic models of all origins are fitted together.  A Newton step needs
only sums over rows, so each task adds up its rows for every origin that may see
them and returns one small matrix per origin; the driver holds parameters only
(origins x features), never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.columns import BY, clip, div, flag, lag, logit, market_window, roll, truth
from .targets import origins_frame


def causal_medians(rows: DataFrame, cols: list[str], lo: int, hi: int, *, lag: int = 1, buckets: int = 64, by=BY) -> DataFrame:
    """Exact median of every feature over the rows usable at each origin.

    A histogram per (feature, bucket, period) finds the bucket of the middle rows;
    only that bucket is ordered.
    """
    k = [*by, "feature"]
    long = rows.select(*by, "position", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([*by, "position"], cols, "feature", "x").where("x is not null")
    cuts = [i / buckets for i in range(1, buckets)]
    edges = long.groupBy(*k).agg(F.percentile_approx("x", cuts, F.lit(1000)).alias("_e"))
    b = long.join(edges, k).select(*k, "position", "x", F.size(F.filter("_e", lambda e: e < F.col("x"))).alias("_b"))
    o = origins_frame(rows.sparkSession, lo, hi).select("origin")
    per = b.groupBy(*k, "_b", "position").agg(F.count(F.lit(1)).alias("_c"))
    known = per.join(F.broadcast(o), F.col("position") <= F.col("origin") - lag - 1).groupBy(*k, "origin", "_b").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*k, "origin")
    run = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumns({"_below": F.coalesce(F.sum("_c").over(run), F.lit(0)), "_n": F.sum("_c").over(w)})
    h = (F.col("_n") - 1) / 2.0
    known = known.withColumns({"_lo": F.floor(h), "_hi": F.ceil(h)})
    inside = lambda r: (F.col("_below") <= r) & (r < F.col("_below") + F.col("_c"))
    hit = known.where(inside(F.col("_lo")) | inside(F.col("_hi")))
    j = b.join(hit, [*k, "_b"]).where(F.col("position") <= F.col("origin") - lag - 1)
    # a stated number: a row here is few bytes, and adaptive execution would sort those of all origins in one task
    j = j.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *k, "origin", "_b")
    r = F.col("_below") + F.row_number().over(Window.partitionBy(*k, "origin", "_b").orderBy("x")) - 1
    return j.withColumn("_r", r).where((F.col("_r") == F.col("_lo")) | (F.col("_r") == F.col("_hi"))).groupBy(*k, "origin").agg(
        F.avg("x").alias("median"))


def _panel(by) -> "F.Column":
    """The key of a row's panel as one string."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in by])


def _moments(data, cols, lo, hi, lag):
    """Per (panel, origin): rows known, and per feature their count and the sums of x - c and (x - c)^2 about the panel's mean c.

    Sums about a centre near the mean keep the variance of a feature with a high level. One row per panel and period
    reaches the driver.
    """
    mean = {r["_k"]: [r[f"c_{c}"] or 0.0 for c in cols] for r in data.groupBy("_k").agg(*[F.avg(c).alias(f"c_{c}") for c in cols]).collect()}
    centre = F.create_map(*[x for k, v in mean.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))]) if mean else F.lit(None).cast("map<string,array<double>>")
    at = data.withColumn("_c", centre[F.col("_k")])
    shift = lambda i, c: F.col(c) - F.col("_c")[i]
    per = at.groupBy("_k", "position").agg(F.count(F.lit(1)).alias("_rows"), *[
        e for i, c in enumerate(cols) for e in (F.count(c).alias(f"n_{c}"), F.sum(shift(i, c)).alias(f"s_{c}"), F.sum(shift(i, c) * shift(i, c)).alias(f"q_{c}"))])
    t = per.orderBy("_k", "position").toPandas()
    out = {}
    for k, own in t.groupby("_k"):
        for o in range(lo, hi + 1):
            out[k, o] = own[own["position"] <= o - lag - 1].drop(columns="_k").sum(numeric_only=True)
    return out, {k: np.array(v) for k, v in mean.items()}


class PooledFit:
    """Parameters of all panels and origins: preprocessing, coefficients and how each fit ended."""

    def __init__(self, cols, missing, levels, effect, prep, beta, lag, by=BY, report=None):
        self.cols, self.missing, self.levels, self.effect, self.prep, self.fits, self.lag, self.by = cols, missing, levels, effect, prep, beta, lag, by
        self.ended = report or {}

    @property
    def beta(self) -> dict:
        """Coefficients per origin, where there is one panel."""
        if len({k for k, _ in self.fits}) > 1:
            raise ValueError("several panels were fitted; read `fits` by (panel, origin)")
        return {o: b for (_, o), b in self.fits.items()}

    def names(self):
        return ["intercept", *self.cols, *[f"missing_{c}" for c in self.missing], *[f"{self.effect}[{v}]" for v in self.levels]]

    def _keys(self, k):
        return tuple(k.split("\x1f"))

    def coefficients(self, spark) -> DataFrame:
        rows = [(*self._keys(k), int(o), n, float(v)) for (k, o), b in self.fits.items() for n, v in zip(self.names(), b)]
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in self.by) + ", origin int, term string, coefficient double")

    def report(self, spark) -> DataFrame:
        """Newton steps, largest entry of the last gradient and whether the fit converged, per panel and origin."""
        rows = [(*self._keys(k), int(o), int(n), float(g), bool(ok)) for (k, o), (n, g, ok) in self.ended.items()]
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in self.by) + ", origin int, steps int, gradient double, converged boolean")


def _design(x, med, mean, sd, missing_at, onehot):
    bad = ~np.isfinite(x)
    z = np.where(bad, med, x)
    z = (z - mean) / sd
    parts = [np.ones((len(x), 1)), z]
    if missing_at is not None and len(missing_at[0]):
        idx, mm, ms = missing_at
        parts.append((bad[:, idx].astype(float) - mm) / ms)
    if onehot is not None:
        parts.append(onehot)
    return np.hstack(parts)


def _onehot(values, levels):
    if not levels:
        return None
    pos = {v: i for i, v in enumerate(levels)}
    m = np.zeros((len(values), len(levels)))
    for r, v in enumerate(values):
        if v in pos:
            m[r, pos[v]] = 1.0
    return m


def fit_pooled(rows: DataFrame, cols: list[str], *, y: str = "y_true", lo: int, hi: int, lag: int = 1, c: float = 0.25, balanced: bool = False,
               missing_flags: bool = True, standardize: bool = True, effect: str | None = None, max_levels: int = 500,
               min_rows: int = 1, max_iter: int = 40, tol: float = 1e-8, by=BY) -> PooledFit:
    """Ridge-logistic models for origins lo..hi, each on rows at positions <= origin - lag - 1.

    Every panel (``by``) has fits of its own.  The penalty is 1/(2C)|w|^2 without the
    intercept; ``balanced`` weighs classes equally.  Missing values are filled with the
    causal median and may add a flag.  A Newton step that raises the loss is halved;
    ``PooledFit.report`` says how each fit ended.
    """
    by = tuple(by)
    data = rows.where(F.col(y).isNotNull()).select(*by, _panel(by).alias("_k"), "position", F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in cols],
                                                   *([F.col(effect).cast("string").alias(effect)] if effect else [])).where(F.col("position") <= hi - lag - 1).persist()
    try:
        levels = []
        if effect:
            levels = sorted(r[0] for r in data.select(effect).distinct().limit(max_levels + 1).collect())
            if len(levels) > max_levels:
                raise ValueError(f"{effect} has more than {max_levels} levels; use fit_local or group effects")
        mom, centre = _moments(data, cols, lo, hi, lag)
        cls = data.groupBy("_k", "position", "_y").agg(F.count(F.lit(1)).alias("n")).toPandas()  # two rows per panel and period
        med = {}
        if standardize:
            for r in causal_medians(data.drop(*by), cols, lo, hi, lag=lag, by=("_k",)).collect():  # panels x origins x features
                med[(r["_k"], r["origin"], r["feature"])] = r["median"]
        missing = [x for x in cols if missing_flags and any(m["_rows"] > m[f"n_{x}"] for m in mom.values())]
        mi = [cols.index(x) for x in missing]
        prep, beta, classw = {}, {}, {}
        for (key, o), m in mom.items():
            k = cls[(cls["_k"] == key) & (cls["position"] <= o - lag - 1)].groupby("_y")["n"].sum()
            if m["_rows"] < min_rows or len(k) < 2:
                continue
            n = float(m["_rows"])
            if standardize:
                md = np.array([med.get((key, o, x), 0.0) for x in cols])
                cnt = np.array([m[f"n_{x}"] for x in cols])
                s = np.array([m[f"s_{x}"] for x in cols]) + (n - cnt) * (md - centre[key])
                q = np.array([m[f"q_{x}"] for x in cols]) + (n - cnt) * (md - centre[key]) ** 2
                mean = centre[key] + s / n
                sd = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0.0))
                sd = np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0)
                mr = 1.0 - cnt[mi] / n
                ms = np.sqrt(mr * (1 - mr))
                miss = (mi, mr, np.where(ms > 0, ms, 1.0))
            else:
                md, mean, sd, miss = np.zeros(len(cols)), np.zeros(len(cols)), np.ones(len(cols)), None
            prep[key, o] = (md, mean, sd, miss)
            classw[key, o] = {v: n / (2.0 * float(k[v])) if balanced else 1.0 for v in k.index}
            beta[key, o] = np.zeros(1 + len(cols) + (len(mi) if standardize else 0) + len(levels))
        live, ended = set(beta), {}
        last: dict = {}  # loss, coefficients and step of the round before
        for turn in range(1, max_iter + 1):
            if not live:
                break
            now = {f: beta[f] for f in live}

            def add(batches, now=now):
                acc = {}
                for pdf in batches:
                    x, yy, p, panel = pdf[cols].to_numpy(dtype=float), pdf["_y"].to_numpy(), pdf["position"].to_numpy(), pdf["_k"].to_numpy()
                    hot = _onehot(pdf[effect].to_numpy(), levels) if effect else None
                    for f, bt in now.items():
                        use = (panel == f[0]) & (p <= f[1] - lag - 1)
                        if not use.any():
                            continue
                        z = _design(x[use], *prep[f], None if hot is None else hot[use])
                        e = z @ bt
                        mu = 1.0 / (1.0 + np.exp(-np.clip(e, -35, 35)))
                        w = np.where(yy[use] > 0.5, classw[f].get(1.0, 1.0), classw[f].get(0.0, 1.0))
                        h = (z * (w * mu * (1 - mu))[:, None]).T @ z
                        g = z.T @ (w * (yy[use] - mu))
                        loss = float((w * (np.logaddexp(0, e) - yy[use] * e)).sum())
                        # the matrix is symmetric: its upper triangle is sent
                        acc[f] = acc.get(f, 0.0) + np.concatenate([h[np.triu_indices(len(bt))], g, [loss]])
                if acc:
                    yield pd.DataFrame({"_k": [f[0] for f in acc], "origin": [f[1] for f in acc], "sums": [v.tolist() for v in acc.values()]})

            parts = data.mapInPandas(add, "_k string, origin int, sums array<double>")
            # one row per fit and task in, one per fit out
            got = parts.groupBy("_k", "origin").agg(F.collect_list("sums").alias("s")).select(
                "_k", "origin", F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), lambda t, v: F.zip_with(t, v, lambda m, n: m + n)).alias("s")).collect()
            for r in got:  # one parameter-sized row per fit
                f, v = (r["_k"], r["origin"]), np.asarray(r["s"])
                d = len(beta[f])
                pen = np.full(d, 1.0 / c)
                pen[0] = 1e-10
                loss = v[-1] + 0.5 * float(pen @ beta[f] ** 2)
                if f in last and loss > last[f][0] + 1e-9 * (1 + abs(last[f][0])):
                    # the step overshot: half of it from where it began
                    last[f] = (last[f][0], last[f][1], last[f][2] / 2)
                    beta[f] = last[f][1] + last[f][2]
                    ended[f] = (turn, ended[f][1], False)
                    continue
                h = np.zeros((d, d))
                h[np.triu_indices(d)] = v[: d * (d + 1) // 2]
                h = h + np.triu(h, 1).T + np.diag(pen)
                g = v[d * (d + 1) // 2:-1] - pen * beta[f]
                step = np.linalg.solve(h, g)
                last[f] = (loss, beta[f], step)
                beta[f] = beta[f] + step
                done = bool(np.max(np.abs(step)) < tol)
                ended[f] = (turn, float(np.max(np.abs(g))), done)
                if done:
                    live.discard(f)
        return PooledFit(cols, missing if standardize else [], levels, effect, prep, beta, lag, by, ended)
    finally:
        data.unpersist()


def score_pooled(rows: DataFrame, fit: PooledFit, *, out: str = "p", at: int | None = None) -> DataFrame:
    """Score each row with the model of its own panel and origin (or of the fixed origin ``at``)."""
    cols, levels, effect, prep, beta, flag_lag = fit.cols, fit.levels, fit.effect, fit.prep, fit.fits, fit.lag
    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])

    def task(batches):
        for pdf in batches:
            p = np.full(len(pdf), np.nan)
            pos = np.full(len(pdf), at) if at is not None else pdf["position"].to_numpy()
            panel, x = pdf["_k"].to_numpy(), pdf[cols].to_numpy(dtype=float)
            hot = _onehot(pdf[effect].astype(str).to_numpy(), levels) if effect else None
            for f in set(zip(panel.tolist(), pos.tolist())):
                if f in beta:
                    use = (panel == f[0]) & (pos == f[1])
                    z = _design(x[use], *prep[f], None if hot is None else hot[use])
                    p[use] = np.clip(1.0 / (1.0 + np.exp(-(z @ beta[f]))), 1e-6, 1 - 1e-6)
            pdf[out] = p
            yield pdf.drop(columns="_k")

    d = rows.withColumn("_k", _panel(fit.by)).mapInPandas(task, schema)
    through = F.lit(at) if at is not None else F.col("position")
    return d.withColumn(out, F.nanvl(out, F.lit(None).cast("double"))).withColumn("fit_through", F.when(F.col(out).isNotNull(), through - flag_lag - 1))


def walk_forward(rows: DataFrame, cols: list[str], *, lo: int, hi: int, y: str = "y_true", out: str = "p", **kw) -> DataFrame:
    """Fit and score every origin lo..hi; the score of t never uses a label newer than t-2 at lag 1."""
    fit = fit_pooled(rows, cols, y=y, lo=lo, hi=hi, **kw)
    return score_pooled(rows.where(F.col("position").between(lo, hi)), fit, out=out)


def _newton(z, y, c, penalise_intercept=False, iters=50):
    b = np.zeros(z.shape[1])
    pen = np.full(z.shape[1], 1.0 / c)
    pen[0] = 1.0 / c if penalise_intercept else 1e-10
    for _ in range(iters):
        mu = 1.0 / (1.0 + np.exp(-np.clip(z @ b, -35, 35)))
        step = np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + np.diag(pen), z.T @ (y - mu) - pen * b)
        b = b + step
        if np.max(np.abs(step)) < 1e-9:
            break
    return b


def fit_local(rows: DataFrame, cols: list[str], *, lo: int, hi: int, y: str = "y_true", lag: int = 1, c: float = 0.5, min_rows: int = 48,
              min_class: int = 8, fallback: str | None = None, coefficients: bool = False, by=BY) -> DataFrame:
    """One logistic model per series and origin on the series' own history.

    A series is one group of at most one row per period.  Too short, one-sided or
    empty-column histories use the fallback score and are flagged.  The intercept
    is penalised like the slopes.
    """
    names = [*by, "series_id", "position"]
    types = {k: "string" for k in by} | {"series_id": "string", "position": "int"}
    keep = rows.select(*names, F.col(y).cast("double").alias("_y"), *[F.col(x).cast("double").alias(x) for x in cols],
                       (F.col(fallback) if fallback else F.lit(None)).cast("double").alias("_f"))
    extra = "local_rows int, coef array<double>" if coefficients else "p_local double, local_rows int, fallback_used boolean"
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", " + extra

    def task(pdf):
        pdf = pdf.sort_values("position")
        pos, yy, x, fb = pdf["position"].to_numpy(), pdf["_y"].to_numpy(dtype=float), pdf[cols].to_numpy(dtype=float), pdf["_f"].to_numpy(dtype=float)
        head = [pdf[k].iloc[0] for k in names[:-1]]
        out = []
        for i in np.nonzero((pos >= lo) & (pos <= hi))[0]:
            tr = (pos <= pos[i] - lag - 1) & np.isfinite(yy)
            n, ones = int(tr.sum()), int(yy[tr].sum())
            ok = n >= min_rows and min(ones, n - ones) >= max(1, min_class) and np.isfinite(x[tr]).any(axis=0).all()
            b, p = None, fb[i]
            if ok:
                med = np.nanmedian(x[tr], axis=0)
                f = np.where(np.isfinite(x[tr]), x[tr], med)
                mu, sd = f.mean(axis=0), f.std(axis=0)
                sd = np.where(sd > 0, sd, 1.0)
                b = _newton(np.hstack([np.ones((n, 1)), (f - mu) / sd]), yy[tr], c, True)
                now = (np.where(np.isfinite(x[i]), x[i], med) - mu) / sd
                p = float(np.clip(1 / (1 + np.exp(-(b[0] + now @ b[1:]))), 1e-6, 1 - 1e-6))
            if coefficients:
                if b is not None:
                    out.append((*head, int(pos[i]), n, b.tolist()))
            else:
                out.append((*head, int(pos[i]), None if not np.isfinite(p) else p, n, not ok))
        cols_ = [*names, "local_rows", "coef"] if coefficients else [*names, "p_local", "local_rows", "fallback_used"]
        return pd.DataFrame(out, columns=cols_)

    return keep.groupBy(*names[:-1]).applyInPandas(task, schema)


def effective_local(df: DataFrame, min_rows: int, fallback: str) -> DataFrame:
    """A higher history threshold without refitting."""
    short = F.col("fallback_used") | (F.col("local_rows") < min_rows)
    return df.withColumns({"p_local": F.when(short, F.col(fallback)).otherwise(F.col("p_local")), "fallback_used": short})


def _by_market(market: DataFrame, cols, target, fn, out_schema, by, block: int = 8):
    """Walk-forward on a one-row-per-period table: one task per panel and block of origins, with the rows up to the block's end."""
    keys = [*by, "position"]
    d = market.select(*keys, F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    blocks = d.groupBy(*by, F.floor(F.col("position") / block).alias("_block")).agg(F.max("position").alias("_last"))
    parts = d.join(blocks, list(by)).where(F.col("position") <= F.col("_last"))
    schema = ", ".join(f"{k} string" for k in by) + ", position int, " + out_schema

    def task(pdf):
        pdf = pdf.sort_values("position")
        pos = pdf["position"].to_numpy()
        res = fn(pos, pdf[cols].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float), np.flatnonzero(pos >= int(pdf["_block"].iloc[0]) * block).tolist())
        for k in by:
            res[k] = pdf[k].iloc[0]
        return res[[*keys, *[c.strip().split(" ")[0] for c in out_schema.split(",")]]]

    return parts.groupBy(*by, "_block").applyInPandas(task, schema)


def fit_ridge(market: DataFrame, cols, target: str, *, fallback: str, alpha: float = 10.0, min_n: int = 12, lag: int = 1, out="forecast", by=BY) -> DataFrame:
    """Ridge forecast of a monthly quantity; the fallback column until enough history exists."""
    fb = cols.index(fallback)

    def fn(pos, x, y, now_at):
        rows = []
        for i in now_at:
            t = pos[i]
            tr = (pos <= t - lag - 1) & np.isfinite(y)
            if tr.sum() < min_n:
                rows.append((int(t), float(np.clip(x[i, fb], 0, 1)) if np.isfinite(x[i, fb]) else None, None))
                continue
            seen = np.isfinite(x[tr]).any(axis=0)
            a = x[tr][:, seen]
            med = np.nanmedian(a, axis=0)
            a = np.where(np.isfinite(a), a, med)
            mu, sd = a.mean(axis=0), a.std(axis=0)
            sd = np.where(sd > 0, sd, 1.0)
            z, ym = (a - mu) / sd, y[tr].mean()
            w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y[tr] - ym))
            now = (np.where(np.isfinite(x[i][seen]), x[i][seen], med) - mu) / sd
            rows.append((int(t), float(np.clip(ym + now @ w, 0, 1)), int(pos[tr].max())))
        return pd.DataFrame(rows, columns=["position", out, "fit_through"])

    return _by_market(market, cols, target, fn, f"{out} double, fit_through int", by)


def market_logit(market: DataFrame, cols, target: str, *, c: float = 0.1, min_n: int = 36, lag: int = 1, out="p_market", by=BY) -> DataFrame:
    """Walk-forward logistic on monthly signals, standardised on its own history."""
    def fn(pos, x, y, now_at):
        rows = []
        ok = np.isfinite(x).all(axis=1)
        for i in now_at:
            t = pos[i]
            tr = (pos <= t - lag - 1) & np.isfinite(y) & ok
            if tr.sum() < min_n or not ok[i] or len(np.unique(y[tr])) < 2:
                continue
            mu, sd = x[tr].mean(axis=0), x[tr].std(axis=0, ddof=1)
            sd = np.where(sd > 0, sd, 1.0)
            b = _newton(np.hstack([np.ones((tr.sum(), 1)), (x[tr] - mu) / sd]), y[tr], c)
            rows.append((int(t), float(1 / (1 + np.exp(-(b[0] + ((x[i] - mu) / sd) @ b[1:]))))))
        return pd.DataFrame(rows, columns=["position", out])

    return _by_market(market, cols, target, fn, f"{out} double", by)


def fit_zoo(rows: DataFrame, cols: list[str], *, y: str, through: int, kinds=("logistic", "boosted")) -> DataFrame:
    """Several classifiers on one frozen window, each scoring all rows."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = rows.where((F.col("position") <= through) & F.col(y).isNotNull())
    med = known.agg(*[F.coalesce(F.percentile_approx(c, 0.5, 10000), F.lit(0.0)).alias(c) for c in cols]).first().asDict()
    d = VectorAssembler(inputCols=cols, outputCol="_raw").transform(rows.select("panel_id", "series_id", "position", F.col(y).alias("label"), *[F.col(c).cast("double").alias(c) for c in cols]).fillna(med, cols))
    train = d.where((F.col("position") <= through) & F.col("label").isNotNull())
    d = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(train).transform(d)
    train = d.where((F.col("position") <= through) & F.col("label").isNotNull())
    models = {"logistic": LogisticRegression(regParam=0.01), "boosted": GBTClassifier(maxIter=20, maxDepth=2, seed=1)}
    for k in kinds:
        m = models[k].fit(train)
        d = m.transform(d).withColumn(f"p_{k}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    return d.select("panel_id", "series_id", "position", "label", *[f"p_{k}" for k in kinds])


def platt(rows: DataFrame, score: str, y: str, *, through: int, c: float = 1e6, out: str = "calibrated") -> DataFrame:
    """Logistic calibration of a score's log-odds on labels up to ``through``, applied to all rows."""
    d = rows.withColumn("_lo", logit(score))
    fit = fit_pooled(d, ["_lo"], y=y, lo=through + 2, hi=through + 2, c=c, standardize=False, missing_flags=False)
    return score_pooled(d, fit, out=out, at=through + 2).drop("_lo", "fit_through")


def isotonic(rows: DataFrame, score: str, y: str, *, through: int, out: str = "calibrated") -> DataFrame:
    """Monotone calibration on labels up to ``through``; values outside the range take the end value."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    d = VectorAssembler(inputCols=[score], outputCol="_x").transform(rows.where(F.col(score).isNotNull()))
    m = IsotonicRegression(featuresCol="_x", labelCol=y, predictionCol=out).fit(d.where((F.col("position") <= through) & F.col(y).isNotNull()))
    return m.transform(d).drop("_x")


def prequential(rows: DataFrame, score: str, y: str, *, lo: int, hi: int, min_origins: int = 12, c: float = 1.0, frozen_after: int | None = None,
                out: str = "calibrated", lag: int = 1, by=BY) -> DataFrame:
    """Calibrate each origin on earlier labels only; the raw score until enough months exist.

    After ``frozen_after`` the last calibrator known there is kept.
    """
    d = rows.withColumn("_lo", logit(score))
    last = hi if frozen_after is None else min(hi, frozen_after + 1)
    fit = fit_pooled(d.where(F.col("position") >= lo), ["_lo"], y=y, lo=lo + lag + min_origins, hi=last, c=c, standardize=False, missing_flags=False, lag=lag, by=by)
    if frozen_after is not None:
        for o in range(last + 1, hi + 1):
            for k in {k for k, x in fit.fits if x == last}:
                fit.fits[k, o], fit.prep[k, o] = fit.fits[k, last], fit.prep[k, last]
    s = score_pooled(d.where(F.col("position").between(lo, hi)), fit, out="_cal")
    done = F.col("_cal").isNotNull() & F.col(score).isNotNull()
    through = F.least(F.col("position"), F.lit(last)) - lag - 1
    status = F.when(done & (F.col("position") > last), "frozen").when(done, "prequential").otherwise("raw_fallback")
    return s.withColumns({out: F.when(done, clip("_cal", 0.001, 0.999)).otherwise(F.col(score)), "status": status,
                          "fit_through": F.when(done, through)}).drop("_lo", "_cal")


def cohort_probability(calls: DataFrame, group: list[str], *, k: float = 50.0, min_months: int = 12, lag: int = 2, out="cohort_p", by=BY) -> DataFrame:
    """(hits + k * overall rate) / (calls + k) of a call's group, from calls at least ``lag`` periods old."""
    from .metrics import with_correct

    c = with_correct(calls).where("correct is not null")
    keys = [*by, *group, "position"]
    frame = lambda ks: Window.partitionBy(*ks).orderBy("position").rangeBetween(Window.unboundedPreceding, -lag)
    m = c.groupBy(*by, "position").agg(F.sum("correct").alias("_h"), F.count(F.lit(1)).alias("_n"))
    w = frame(list(by))
    m = m.select(*by, "position", F.count(F.lit(1)).over(w).alias("_months"), ((1.0 + F.sum("_h").over(w)) / (2.0 + F.sum("_n").over(w))).alias("_g"))
    # one row per group and period with calls; a group with no history yet uses the overall rate
    g = c.groupBy(*keys).agg(F.sum("correct").alias("_h"), F.count(F.lit(1)).alias("_n"))
    wg = frame([*by, *group])
    g = g.select(*keys, F.coalesce(F.sum("_h").over(wg), F.lit(0.0)).alias("_gh"), F.coalesce(F.sum("_n").over(wg), F.lit(0)).alias("_gn"))
    j = c.join(m, [*by, "position"]).join(g, keys)
    p = F.col("_g") if not group else (F.col("_gh") + k * F.col("_g")) / (F.col("_gn") + k)
    return j.withColumn(out, F.when(F.col("_months") >= min_months, p)).drop("_months", "_g", "_gh", "_gn")


def fit_correctness(rows: DataFrame, *, through: int, up: str = "p_select", down: str = "p_down", stress: str = "regime_stress", c: float = 0.1) -> DataFrame:
    """One model of "this call is right" for both directions: each row enters as Up and as Down."""
    d = rows.where(F.col(up).isNotNull() & F.col(down).isNotNull() & F.col(stress).isNotNull()).withColumn("_f", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    d = d.withColumns({"_fu": F.col("_f") * F.col(up), "_fd": F.col("_f") * F.col(down), "_fs": F.col("_f") * F.col(stress),
                       "_right": F.when(F.col("_f") == 0, F.col("y_true")).otherwise(1 - F.col("y_true"))})
    cols = [up, down, stress, "_f", "_fu", "_fd", "_fs"]
    fit = fit_pooled(d, cols, y="_right", lo=through + 2, hi=through + 2, c=c, missing_flags=False)
    s = score_pooled(d, fit, out="_p", at=through + 2)
    return s.groupBy("panel_id", "position", "series_id").agg(F.max(F.when(F.col("_f") == 0, F.col("_p"))).alias("up_cal"),
                                                              F.max(F.when(F.col("_f") == 1, F.col("_p"))).alias("down_cal"))


# ---- forecasts as quantiles ---------------------------------------------------


def quantiles_to_p(df: DataFrame, levels: list[float], q: str = "quantiles") -> DataFrame:
    """P(change > 0) from forecast quantiles by a piecewise-linear distribution with linear tails.

    Crossing quantiles are sorted.  Wrong length, missing or spreadless quantiles
    fail closed to 0.5.
    """
    if not levels or any(not 0 < x < 1 for x in levels) or any(a >= b for a, b in zip(levels, levels[1:])):
        raise ValueError("levels must be strictly increasing inside (0, 1)")
    n, a = len(levels), F.col(q)
    L = F.array(*[F.lit(float(x)) for x in levels])
    finite = truth((F.size(a) == n) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    d = df.withColumns({"nan_flag": truth((F.size(a) == n)) & ~finite, "_v": F.when(finite, F.array_sort(a))})
    d = d.withColumn("crossing_flag", finite & truth(F.col("_v") != a))
    v = lambda i: F.get("_v", F.lit(i) if isinstance(i, int) else i)
    d = d.withColumn("degenerate_flag", truth(v(n - 1) - v(0) <= 0))
    le = F.size(F.filter("_v", lambda x: x <= 0))
    d = d.withColumns({"_k": le, "_s0": F.size(F.filter("_v", lambda x: x == v(0))), "_s1": n - 1 - F.size(F.filter("_v", lambda x: x == v(n - 1)))})
    lv = lambda i: F.get(L, i)
    k = F.col("_k")
    inner = lv(k - 1) + (lv(k) - lv(k - 1)) / (v(k) - v(k - 1)) * (0.0 - v(k - 1))
    low = clip(lv(F.lit(0)) - (lv(F.col("_s0")) - levels[0]) / (v(F.col("_s0")) - v(0)) * v(0), 0.0, levels[0])
    high = clip(levels[-1] + (levels[-1] - lv(F.col("_s1"))) / (v(n - 1) - v(F.col("_s1"))) * (0.0 - v(n - 1)), levels[-1], 1.0)
    ok = finite & ~F.col("degenerate_flag")
    cdf = F.when(~ok, F.lit(None).cast("double")).when(k == 0, low).when(v(n - 1) < 0, high).when(k >= n, F.lit(levels[-1])).otherwise(inner)
    mid = levels.index(0.5) if 0.5 in levels else None
    wide = v(levels.index(0.9)) - v(levels.index(0.1)) if 0.1 in levels and 0.9 in levels else F.lit(None).cast("double")
    d = d.withColumns({"p_up": F.coalesce(clip(1.0 - cdf, 0.001, 0.999), F.lit(0.5)), "failure_flag": ~ok,
                       "median": F.when(ok, v(mid)) if mid is not None else F.lit(None).cast("double"), "width_80": F.when(ok, wide)})
    asym = (v(levels.index(0.9)) + v(levels.index(0.1)) - 2.0 * v(mid)) / F.col("width_80") if mid is not None and 0.1 in levels and 0.9 in levels else F.lit(None).cast("double")
    return d.withColumn("asymmetry", F.when(ok, F.when(F.col("width_80") > 1e-12, clip(asym, -1.0, 1.0)).otherwise(0.0))).withColumn(
        "direction", F.when(F.col("p_up") >= 0.5, "Up").otherwise("Down")).drop("_v", "_k", "_s0", "_s1")


def drift_forecaster(contexts: DataFrame, levels: list[float], *, step: int = 2, context: str = "context") -> DataFrame:
    """Deterministic forecaster: last value plus drift, spread evenly around it.

    It runs as any user forecaster does, on Arrow batches of contexts.
    """
    offsets = 2.0 * (np.asarray(levels) - 0.5)
    schema = StructType([*contexts.schema.fields, StructField("quantiles", ArrayType(DoubleType()))])

    def run(batches):
        for pdf in batches:
            out = []
            for c in pdf[context]:
                x = np.asarray([] if c is None else c, dtype=float)
                x = x[np.isfinite(x)]
                drift = (x[-1] - x[0]) / (len(x) - 1) if len(x) >= 2 else 0.0
                out.append((x[-1] + drift * step + x.std() * offsets).tolist() if len(x) else None)
            yield pdf.assign(quantiles=out)

    return forecast(contexts, run, schema)


def forecast(contexts: DataFrame, forecaster, schema) -> DataFrame:
    """Run a user forecaster on batches of contexts: an iterator of frames in, frames out."""
    return contexts.mapInPandas(forecaster, schema)


NAIVE_RULES = ["majority", "persistence", "reversal", "momentum_3", "momentum_6", "momentum_12", "mean_reversion", "ar1"]


def naive_direction(targets: DataFrame, *, by=BY) -> DataFrame:
    """Simple direction rules, as probabilities 0 or 1 (null where undecidable); the rules are our definition."""
    from .features import _diff, _level, _momentum
    from ..functions.columns import UNB, series_window

    known = Window.partitionBy(*by, "series_id").orderBy("position").rangeBetween(UNB, -2)
    d = targets.withColumns({"_d": _diff(0, by), "_l": _diff(1, by)})
    w = series_window(UNB, 0, by)
    d = d.withColumns({"_b": F.regr_slope("_d", "_l").over(w), "_a": F.regr_intercept("_d", "_l").over(w)})
    return d.withColumns({
        "majority": flag(F.avg("y_true").over(known) >= 0.5), "persistence": flag(F.col("_d") > 0), "reversal": flag(F.col("_d") <= 0),
        **{f"momentum_{k}": flag(_momentum(k, 0, by) > 0) for k in (3, 6, 12)},
        "mean_reversion": flag(_level(0, by) < roll(F.avg, "value", 12, 6, by=by, lag_rows=1)),
        "ar1": flag(F.col("_a") + F.col("_b") * F.col("_d") > 0)}).drop("_d", "_l", "_a", "_b")


def vote(df: DataFrame, weights: dict[str, float], out: str = "p_vote") -> DataFrame:
    """Weighted share of Up votes among the rules that decide; our definition."""
    num = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return df.withColumn(out, div(num, den))
