"""Walk-forward models with series' own slopes against one dense fit."""

import numpy as np
import pandas as pd
import pytest

from walksieve.operators import models, varying
from walksieve.operators.varying import Config

COLS = ["a", "b", "c", "d"]


def panel(series=25, periods=40, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        tilt = r.normal(0, 1.5, 2)
        for t in range(1, periods + 1):
            if r.random() < 0.1:
                continue
            x = r.normal(size=4) * [1, 5, 1, 1] + [0, 1e4, 0, 3]
            p = 1 / (1 + np.exp(-(0.8 * x[0] + tilt[0] + tilt[1] * x[2])))
            miss = r.random(4) < [0, 0.1, 0.1, 0]
            rows.append(("main", f"s{s}", t, None if r.random() < 0.05 else float(r.random() < p), *[None if g else float(v) for v, g in zip(x, miss)]))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "panel_id string, series_id string, position int, y_true double, " + ", ".join(f"{c} double" for c in COLS))


def dense(rows, config, origin):
    """Scores at `origin` of one dense Newton fit with a column per series and per series and slope."""
    at = [COLS.index(c) for c in config.cols]
    train = [r for r in rows if r[2] <= origin - 2 and r[3] is not None]
    now = [r for r in rows if r[2] == origin]
    ids = sorted({r[1] for r in train})
    any_gone = [j for j in at if any(r[4 + j] is None for r in rows if r[2] <= max(x[2] for x in rows) - 2 and r[3] is not None)]
    raw = np.array([[np.nan if r[4 + j] is None else r[4 + j] for j in at] for r in train])
    med = np.nanmedian(raw, axis=0)
    full = np.where(np.isnan(raw), med, raw)
    mean, sd = full.mean(0), full.std(0)

    def make(part):
        x = np.array([[np.nan if r[4 + j] is None else r[4 + j] for j in at] for r in part])
        z = (np.where(np.isnan(x), med, x) - mean) / sd
        flags = np.isnan(x)[:, [at.index(j) for j in any_gone]].astype(float)
        fm = np.isnan(raw)[:, [at.index(j) for j in any_gone]].mean(0)
        fs = np.sqrt(fm * (1 - fm))
        hot = np.array([[float(r[1] == i) for i in ids] for r in part])
        blocks = [np.ones((len(part), 1)), z, (flags - fm) / np.where(fs > 0, fs, 1)]
        if config.effect:
            blocks.append(hot)
        for s in config.slopes:
            blocks.append(hot * z[:, [list(config.cols).index(s)]])
        return np.hstack(blocks)

    x, y = make(train), np.array([r[3] for r in train])
    w = np.where(y > 0.5, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if config.balanced else np.ones(len(y))
    pen = np.full(x.shape[1], 1 / config.c)
    pen[0] = 1e-10
    b = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * mu * (1 - mu))[:, None]).T @ x + np.diag(pen), x.T @ (w * (y - mu)) - pen * b)
    return {r[1]: float(p) for r, p in zip(now, 1 / (1 + np.exp(-make(now) @ b)))}


CONFIGS = [Config("plain", ("a", "b", "c", "d")), Config("few", ("c", "a"), c=2.0, balanced=True), Config("own", ("a", "b", "c", "d"), ("c", "a"), True, 0.5),
           Config("effect", ("a", "b"), (), True, 1.0, True)]


def test_equals_a_dense_fit(spark):
    rows = panel()
    df = table(spark, rows).repartition(3)
    got = varying.walk_forward_many(df, CONFIGS, lo=20, hi=40).collect()
    assert len({(x.config, x.series_id, x.position) for x in got}) == len(got)
    for config in CONFIGS:
        for o in (20, 31, 40):
            want = dense(rows, config, o)
            mine = {x.series_id: x.p for x in got if x.config == config.name and x.position == o}
            assert mine.keys() == want.keys()
            assert max(abs(mine[s] - want[s]) for s in want) < 1e-7, (config.name, o)
    fit = varying.fit_many(df, CONFIGS[2:3], lo=30, hi=30)
    terms = fit.coefficients(df).collect()
    assert {t.term for t in terms if t.series_id is None} == {"intercept", "a", "b", "c", "d", "missing_b", "missing_c"}
    assert {t.term for t in terms if t.series_id == "s3"} == {"effect", "c", "a"} and len({t.series_id for t in terms}) == 26
    assert all(x.converged for x in fit.report(spark).collect())


def test_pooled_models_agree(spark):
    rows = panel(seed=5)
    df = table(spark, rows)
    a = {(x.series_id, x.position): x.p for x in models.walk_forward(df, COLS, lo=25, hi=40).collect() if x.p is not None}
    b = {(x.series_id, x.position): x.p for x in varying.walk_forward_many(df, [Config("m", tuple(COLS))], lo=25, hi=40).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_unknown_series_and_short_panels(spark):
    rows = [r for r in panel() if r[1] != "s1" or r[2] > 38]
    df = table(spark, [*rows, ("thin", "x", 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("thin", "x", 30, 0.0, 1.0, 1.0, 1.0, 1.0)])
    got = {(x.panel_id, x.series_id): x.p for x in varying.walk_forward_many(df, CONFIGS[2:3], lo=39, hi=39).collect()}
    want = dense(rows, CONFIGS[2], 39)
    assert all(abs(got["main", s] - p) < 1e-7 for s, p in want.items()) and all(k[0] == "main" for k in got)
    assert varying.walk_forward_many(df.limit(0), CONFIGS, lo=5, hi=9).count() == 0
    with pytest.raises(ValueError):
        varying.fit_many(df, [Config("x", ("a",), ("b",))], lo=5, hi=6)


def test_the_driver_gets_steps_not_matrices(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    got, to_arrow = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: got.append(to_arrow(df)) or got[-1])
    fit = varying.fit_many(table(spark, panel(series=6)), CONFIGS[2:3], lo=20, hi=40)
    per_fit = [t.nbytes / t.num_rows for t in got if "origin" in t.column_names]
    # seven coefficients, a loss and keys; the triangle of the matrix alone has 28 numbers
    assert per_fit and max(per_fit) < 160 and all(x.converged for x in fit.report(spark).collect())


def test_designs_are_held_for_few_origins():
    origins = np.arange(3, 83)
    k, ones = len(origins), np.ones((80, 1))
    fits = varying._Fits(origins, 0 * ones, 0 * ones, ones, np.zeros((k, 0)), np.ones((k, 0)), np.ones((k, 2)), np.zeros((k, 2)))
    model = varying._Model((["a"], [], {"m": Config("m", ("a",), (), True)}, {"main": np.zeros(1)}, {("m", "main"): fits}))
    rows = pd.DataFrame({"a": np.linspace(-1, 1, 82), "_k": "main", "_y": np.arange(82) % 2 * 1.0, "position": np.arange(1, 83)})
    seen = [(origins[places].tolist(), z.shape[1]) for _, places, _, _, _, z, _, _ in model.solved(rows, 1)]
    assert [o for part, _ in seen for o in part] == origins.tolist()
    assert all(len(part) <= 40 and n == part[-1] for part, n in seen)  # no rows after a block's last origin
