"""Counted bootstraps, monotone fits, permutations on bitmaps, budgets by look-up and halved batches against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import research
from walksieve.operators import cube, forecasting, metrics, resample, seasonal
from walksieve.operators import select as H
from walksieve.operators import targets as T
from walksieve.plans import correctness, robustness, seasonality

SF = "/root/testdata/sf0.001"


def scored(spark, seed=2, panels=("a", "b"), months=30):
    r = np.random.default_rng(seed)
    rows = [(p, t, f"s{i}", float(np.round(r.random(), 2)), float(r.random() < 0.5)) for p in panels for t in range(1, months + 1) for i in range(r.integers(1, 9))]
    rows += [("a", 3, "x", None, 1.0), ("a", 4, "y", 0.5, None)]
    return spark.createDataFrame(rows, "panel_id string, position int, series_id string, p double, y_true double")


def test_cube_equals_repeated_rows(spark):
    df = scored(spark).repartition(5)
    got = {x.panel_id: x for x in cube.bootstrap_metrics(df, "p", "y_true", reps=40, seed=3).collect()}
    for x in resample.metric_bootstrap(df, "p", "y_true", reps=40, seed=3).collect():
        for c in ("auc_p05", "auc_p95", "brier_p05", "brier_p95", "ece_p05", "ece_p95"):
            assert got[x.panel_id][c] == pytest.approx(x[c], abs=1e-9), c
    assert [list(range(*s.indices(7))) for s in cube._chunks(np.array([1, 1, 1, 2, 3, 3, 4]), 2)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert cube.bootstrap_metrics(df.where("p is null"), "p", "y_true", reps=5).count() == 0


def plain_isotonic(x, y):
    """Mean of the pooled block of each distinct score, by repeated merging."""
    values = sorted(set(x))
    blocks = [[[v], sum(b for a, b in zip(x, y) if a == v), sum(a == v for a in x)] for v in values]
    moved = True
    while moved:
        moved = False
        for i in range(len(blocks) - 1):
            if blocks[i][1] / blocks[i][2] >= blocks[i + 1][1] / blocks[i + 1][2]:
                blocks[i:i + 2] = [[blocks[i][0] + blocks[i + 1][0], blocks[i][1] + blocks[i + 1][1], blocks[i][2] + blocks[i + 1][2]]]
                moved = True
                break
    return values, [b[1] / b[2] for b in blocks for _ in b[0]]


def test_isotonic_by_origin(spark):
    df = scored(spark, 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = df.where("p is not null and y_true is not null").toPandas()
    got = {(x.panel_id, x.position, x.series_id): x.calibrated for x in cube.isotonic_prequential(df, "p", "y_true", lo=5, hi=30, min_months=6).collect()}
    assert len(got) == df.count() and spark.conf.get("spark.sql.shuffle.partitions") == before
    for p, t in (("a", 8), ("a", 19), ("b", 30)):
        past = rows[(rows.panel_id == p) & (rows.position <= t - 2)]
        xs, ys = plain_isotonic(past.p.tolist(), past.y_true.tolist())
        for x in rows[(rows.panel_id == p) & (rows.position == t)].itertuples():
            assert got[p, t, x.series_id] == pytest.approx(float(np.interp(x.p, xs, ys)), abs=1e-12)
    assert got["a", 6, rows[(rows.panel_id == "a") & (rows.position == 6)].series_id.iloc[0]] is None


def plain_existence(t, reps, seed, min_cell):
    """Arrays of periods x series, permuted one by one."""
    t = t.dropna(subset=["y_true"])
    wide = t.pivot(index="position", columns="series_id", values="y_true").sort_index()
    month = t.drop_duplicates("position").set_index("position").month.sort_index()
    nxt = [m + np.timedelta64(0, "D") for m in month]
    cal = np.array([(m.month % 12) + 1 for m in nxt])
    years = np.array([m.year + (m.month == 12) for m in nxt])
    v = wide.to_numpy()

    def counts(rows, cal_):
        known = ~np.isnan(v[rows])
        hot = (cal_[rows][:, None] == np.arange(1, 13)).astype(float)
        return hot.T @ known, hot.T @ np.nan_to_num(v[rows])

    def stats(cal_):
        every = np.ones(len(v), bool)
        with np.errstate(all="ignore"):
            n, k = counts(every, cal_)
            base = np.nanmean(v, axis=0)
            het = n * (k / n - base) ** 2 / (base * (1 - base))
            ok = (n >= min_cell) & (base * (1 - base) > 0)
            halves = []
            for parity in (0, 1):
                rows = years % 2 == parity
                m, u = counts(rows, cal_)
                halves.append((u / m - np.nanmean(v[rows], axis=0), m))
            (a, na), (b, nb) = halves
            both = (na >= min_cell) & (nb >= min_cell) & np.isfinite(a) & np.isfinite(b)
            r = np.corrcoef(a[both], b[both])[0, 1]
            breadth = np.nanmean(v, axis=1)
            between = sum((cal_ == m).sum() * (breadth[cal_ == m].mean() - breadth.mean()) ** 2 for m in range(1, 13) if (cal_ == m).any())
        return het[ok].sum(), r, between / breadth.var()

    orders = seasonal.permutations(len(cal), reps, seed)
    return np.array([stats(cal[o]) for o in orders])


def test_existence(spark):
    t = research.target_table(spark, SF)
    got = {x.statistic: x for x in seasonal.existence_tests(t, reps=60, seed=4, min_cell=3).collect()}
    want = plain_existence(t.toPandas(), 60, 4, 3)
    for i, name in enumerate(seasonal.STATISTICS):
        assert got[name].observed == pytest.approx(want[0, i], rel=1e-9)
        null = want[1:, i]
        assert got[name].null_median == pytest.approx(np.median(null), rel=1e-9) and got[name].p_value == pytest.approx((1 + (null >= want[0, i] - 1e-12).sum()) / 61)
    # the permutations are those of the row-wise test
    row = resample.label_permutation(t, reps=60, seed=4, min_cell=3).collect()[0]
    assert got["heterogeneity"].observed == pytest.approx(row.observed) and got["heterogeneity"].p_value == pytest.approx(row.p_value)
    assert seasonal.packed(np.array([[1, 0, 1] + [0] * 61 + [1]], bool)).tolist() == [[5, 1]]


def test_budgets_by_look_up(spark):
    rows = research.adapted(spark, SF)
    outcomes = T.sudden_drops(research.target_table(spark, SF), **research.SHOCK)
    fixed = {k: v for k, v in research.ADAPT.items() if k not in ("hi", "down_threshold", "down_margin", "max_replacements")}
    made = robustness.study(rows, outcomes, {"one": (0.5, 0.0), "two": (0.54, 0.02)}, research.WINDOWS, max_budget=3, cap=research.cap(), hi=research.HI, **fixed)
    got = {(x.policy, x.budget, x.window, x.regime): x for x in made.collect()}
    for policy, (threshold, margin) in (("one", (0.5, 0.0)), ("two", (0.54, 0.02))):
        for budget in (0, 1, 3):
            args = {**fixed, "down_threshold": threshold, "down_margin": margin, "max_replacements": budget}
            calls = H.regime_adaptive(rows, cap=research.cap(), hi=research.HI, **args)
            marked = H.down_candidates(rows, **{k: v for k, v in args.items() if k in ("down_threshold", "down_margin", "stress_trigger", "regime_bonus", "shock_bonus", "hard_threshold")})
            taken = T.in_windows(calls, research.WINDOWS).where("replacement").groupBy("window").count().collect()
            taken = {x["window"]: x["count"] for x in taken}
            left = T.in_windows(marked.where("_cand").join(calls.select("panel_id", "position", "series_id"), ["panel_id", "position", "series_id"], "left_anti"), research.WINDOWS)
            left = {x["window"]: x["count"] for x in left.groupBy("window").count().collect()}
            for want in metrics.scenarios(T.in_windows(rows, research.WINDOWS), calls, outcomes, ["window"]).collect():
                x = got[policy, budget, want["window"], want.regime]
                for c in ("months", "calls", "hits", "down_calls", "down_hits", "sudden_drops", "sudden_down_calls"):
                    assert x[c] == want[c], (policy, budget, want["window"], want.regime, c)
                for c in ("accuracy", "down_precision", "down_recall", "sudden_drop_recall"):
                    assert (x[c] is None) == (want[c] is None) and (x[c] is None or x[c] == pytest.approx(want[c]))
                if want.regime == "all":
                    assert x.replacements == taken.get(want["window"], 0) and x.abstained == left.get(want["window"], 0)


def test_halved_batches(spark):
    seen = []

    def run(part):
        seen.append(len(part))
        if any(v in (5, 11) for v in part):
            raise RuntimeError("bad row")
        return [v * 2 for v in part]

    done = forecasting.halved(run, list(range(16)))
    assert sorted(v for part, r, _ in done if not isinstance(r, Exception) for v in part) == [v for v in range(16) if v not in (5, 11)]
    assert [part for part, r, _ in done if isinstance(r, Exception)] == [[5], [11]] and len(seen) <= 1 + 2 * 2 * 4

    rows = [(i, [float(i), float(i + 1), None, float(i + 2)]) for i in range(20)] + [(90, None), (91, [1.0])]
    df = spark.createDataFrame(rows, "position int, context array<double>").withColumn("panel_id", F.lit("a"))
    levels = [0.1, 0.5, 0.9]

    def fragile(batch):
        if any(x[0] == 7.0 for x in batch):
            raise ValueError("seven")
        return forecasting.drift(levels)(batch)

    got = {x.position: x for x in forecasting.forecast_rows(df, fragile, batch=8, min_context=2).collect()}
    assert len(got) == 22 and got[7].quantiles is None and "seven" in got[7].forecast_error and "needed" in got[90].forecast_error and got[91].context_length == 1
    for i in range(20):
        if i != 7:
            assert got[i].forecast_error is None and got[i].quantiles[1] == pytest.approx(i + 4.0)
    e = forecasting.errors_by_origin(forecasting.forecast_rows(df, lambda b: [[0.0]] * (len(b) - 1), batch=4, min_context=2)).agg(F.sum("failures")).first()[0]
    assert e == 22


def test_correctness_methods(spark):
    calls = research.judged(spark, SF).where("model = 'adaptive'").toPandas()
    hit = np.where(calls.direction == "Up", calls.y_true, 1 - calls.y_true)
    assert (calls.correct == hit).all()
    for x in calls.sample(60, random_state=1).itertuples():
        past = calls[calls.position <= x.position - 2]
        if past.position.nunique() < 12:
            assert math.isnan(x.global_cohort) and math.isnan(x.platt_score_rank) and math.isnan(x.isotonic_score)
            continue
        rate = (1 + past.correct.sum()) / (2 + len(past))
        assert x.global_cohort == pytest.approx(rate)
        own = past[(past.rank_group == x.rank_group) & (past.regime_label == x.regime_label)]
        assert x.rank_regime_cohort == pytest.approx((own.correct.sum() + 50 * rate) / (len(own) + 50))
        xs, ys = plain_isotonic(past.score.tolist(), past.correct.tolist())
        assert x.isotonic_score == pytest.approx(float(np.interp(x.score, xs, ys)), abs=1e-9)
        z = np.column_stack([np.ones(len(past)), past.score, (past["rank"] - 1) / 14])
        b, pen = np.zeros(3), np.array([1e-10, 10.0, 10.0])
        for _ in range(40):
            mu = 1 / (1 + np.exp(-z @ b))
            b = b + np.linalg.solve((z * (mu * (1 - mu))[:, None]).T @ z + np.diag(pen), z.T @ (past.correct - mu) - pen * b)
        assert x.platt_score_rank == pytest.approx(1 / (1 + math.exp(-(b @ [1, x.score, (x.rank - 1) / 14]))), abs=1e-6)
    found = correctness.audit(research.judged(spark, SF), research.WINDOWS, models=["model"], reps=20)
    c = {x.method: x for x in found["comparison"].where("model = 'adaptive'").collect()}
    assert c["score"].n == len(calls) and c["score"].brier == pytest.approx(float(((calls.score - calls.correct) ** 2).mean()))
    for x in found["decision"].collect():
        assert x.released == (x.auc_gate and x.brier_gate and x.coverage_gate)
    s = {x.slice: x.n for x in found["slices"].where("model = 'adaptive'").collect()}
    assert s["direction:Up"] == (calls.direction == "Up").sum() and s["window:tuning"] == calls.position.between(*research.WINDOWS["tuning"]).sum()


def test_seasonal_study(spark):
    from catalog.metrics import calls

    live = calls(spark, SF).where("y_true is not null")
    summary, gate = seasonality.study(research.scores(spark, SF), live, research.target_table(spark, SF), research.WINDOWS, hi=10, reps=100, n=36, ensemble=(12, 24, 36), min_labels=12)
    rows, names = seasonality.candidate_scores(research.scores(spark, SF).where("ready and y_true is not null"), research.target_table(spark, SF), n=36, ensemble=(12, 24, 36), min_labels=12)
    p, c = rows.toPandas(), live.toPandas()
    got = {(x.candidate, x.window): x for x in summary.collect()}
    for name in names:
        for w, (lo, hi) in research.WINDOWS.items():
            hits = n = both = base = 0
            for t in range(lo, hi + 1):
                mine = c[c.position == t].set_index("series_id").direction
                if not len(mine):
                    continue
                pool = p[(p.position == t) & p[name].notna()].sort_values([name, "series_id"], ascending=[False, True]).head(len(mine))
                hits += sum((1 - x.y_true) if mine.get(x.series_id) == "Down" else x.y_true for x in pool.itertuples())
                n, both = n + len(pool), both + pool.series_id.isin(mine.index).sum()
                own = c[c.position == t]
                base += np.where(own.direction == "Down", 1 - own.y_true, own.y_true).sum()
            x = got[name, w]
            assert (x.hits, x.calls, x.overlap, x.production_hits, x.delta) == (hits, n, both, base, hits - base), (name, w)
    [g] = gate.collect()
    assert g.passed == (g.tuning_not_worse and g.validation_better and g.validation_stable and g.confirmation_not_worse)
