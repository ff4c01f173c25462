"""Boosted forecasts, the regime-adaptive study and the family ablation against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest

from catalog import research
from walksieve.operators import boosting
from walksieve.operators import search as K
from walksieve.operators import select as H
from walksieve.plans import ablation, adaptive

SF = "/root/testdata/sf0.001"


def plain_boosting(x, y, row, trees, step, depth, min_leaf, l2):
    """Every split tried in turn."""
    def best(g, rows):
        found = None
        for j in range(x.shape[1]):
            values = sorted(set(x[:, j]))
            for a, b in zip(values, values[1:]):
                low = [i for i in rows if x[i, j] <= (a + b) / 2]
                high = [i for i in rows if x[i, j] > (a + b) / 2]
                if min(len(low), len(high)) < min_leaf:
                    continue
                gl, gr = sum(g[i] for i in low), sum(g[i] for i in high)
                gain = gl ** 2 / (len(low) + l2) + gr ** 2 / (len(high) + l2) - (gl + gr) ** 2 / (len(rows) + l2)
                if gain > 0 and (found is None or gain > found[0] + 1e-12):
                    found = (gain, j, (a + b) / 2, low, high)
        return found

    at, total = np.full(len(y), y.mean()), y.mean()

    def grow(g, rows, d, new):
        found = best(g, rows) if d else None
        if found is None:
            value = -step * sum(g[i] for i in rows) / (len(rows) + l2)
            for i in rows:
                new[i] = value
            return lambda r: value
        _, j, t, low, high = found
        a, b = grow(g, low, d - 1, new), grow(g, high, d - 1, new)
        return lambda r: a(r) if r[j] <= t else b(r)

    for _ in range(trees):
        new = np.zeros(len(y))
        tree = grow(at - y, list(range(len(y))), depth, new)
        at = at + new
        total += tree(row)
    return total


@pytest.mark.parametrize("seed", range(4))
def test_booster(seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(50, 3)), 1)
    y = 0.4 * (x[:, 0] > 0.3) + 0.1 * r.normal(size=50)
    row = r.normal(size=3)
    got = boosting.Booster(x, y, trees=12, step=0.3, depth=2, min_leaf=5, l2=1.5).predict(row)
    assert got == pytest.approx(plain_boosting(x, y, row, 12, 0.3, 2, 5, 1.5), abs=1e-9)


def test_boosted_forecast_by_origin(spark):
    r = np.random.default_rng(9)
    rows = [(p, t, None if t % 9 == 0 else float(r.random()), float(r.normal()), None if t < 20 or t % 7 == 0 else float(r.normal()), None) for p in ("a", "b") for t in range(1, 41)]
    schema = "panel_id string, position int, y double, u double, v double, w double"
    made = boosting.boosted_forecast(spark.createDataFrame(rows, schema).repartition(3), ["u", "v", "w"], "y", lo=2, hi=40, trees=15, step=0.2, min_leaf=4, block=7)
    got = {(x.panel_id, x.position): x for x in made.collect()}
    assert len(got) == 78
    for p, t in (("a", 2), ("a", 3), ("b", 19), ("a", 30), ("b", 40)):
        own = [x for x in rows if x[0] == p]
        train = [x for x in own if x[1] <= t - 2 and x[2] is not None]
        if not train:
            assert got[p, t].forecast_breadth is None
            continue
        a = np.array([[np.nan if v is None else v for v in x[3:]] for x in train])
        now = np.array([[np.nan if v is None else v for v in x[3:]] for x in own if x[1] == t][0])
        seen = np.isfinite(a).any(axis=0)
        a, now = a[:, seen], now[seen]
        gaps = np.isnan(a)
        med = np.nanmedian(a, axis=0)
        some = gaps.any(axis=0)
        x = np.hstack([np.where(gaps, med, a), gaps[:, some]])
        row = np.concatenate([np.where(np.isnan(now), med, now), np.isnan(now)[some]])
        want = plain_boosting(x, np.array([q[2] for q in train]), row, 15, 0.2, 2, 4, 10.0)
        assert got[p, t].forecast_breadth == pytest.approx(min(max(want, 0.02), 0.98), abs=1e-9)
        assert got[p, t].fit_through == max(x[1] for x in train) and got[p, t].train_rows == len(train)
    # what comes later changes nothing
    cut = boosting.boosted_forecast(spark.createDataFrame([x for x in rows if x[1] <= 25], schema), ["u", "v", "w"], "y", lo=2, hi=40, trees=15, step=0.2, min_leaf=4)
    assert all(got[x.panel_id, x.position].forecast_breadth == x.forecast_breadth for x in cut.collect())


WINDOWS = {**research.WINDOWS, **research.INTERNAL}


def totals(calls, lo, hi):
    c = calls[(calls.position >= lo) & (calls.position <= hi) & calls.y_true.notna()]
    hit = np.where(c.direction == "Up", c.y_true, 1 - c.y_true)
    down = (c.direction == "Down").to_numpy()
    return {"hits": int(hit.sum()), "calls": len(c), "down": int(down.sum()), "precision": float(hit[down].mean()) if down.any() else math.nan,
            "accuracy": float(hit.mean()) if len(c) else math.nan}


def test_adaptive_search_and_choice(spark):
    rows = research.adapted(spark, SF)
    grid = K.grid_frame(spark, {"down_threshold": [0.5, 0.55], "down_margin": [0.0], "stress_trigger": [0.4], "replacement_margin": [0.02], "max_replacements": [0, 2]})
    kw = dict(cap=research.cap(), hi=research.HI, replacement_hi=2, **research.FIXED)
    found = adaptive.search(rows, grid, WINDOWS, list(research.INTERNAL), min_down_calls=3, min_down_precision=0.5, min_internal_calls=1, min_internal_precision=0.5, **kw)
    got = {x.candidate_id: x for x in found.collect()}
    base = H.dynamic_cap(rows.where("ready"), research.cap(), research.HI).toPandas()
    rank = []
    for g in grid.collect():
        calls = H.regime_adaptive(rows, cap=research.cap(), hi=research.HI, down_threshold=g.down_threshold, down_margin=0.0, stress_trigger=0.4, replacement_margin=0.02,
                                  max_replacements=int(g.max_replacements), replacement_hi=2, **research.FIXED).toPandas()
        s = {w: totals(calls, *b) for w, b in WINDOWS.items()}
        delta = {w: s[w]["hits"] - totals(base, *b)["hits"] for w, b in WINDOWS.items()}
        ok = s["tuning"]["down"] >= 3 and s["tuning"]["precision"] >= 0.5
        stable = ok and all(s[w]["down"] >= 1 and s[w]["precision"] >= 0.5 and delta[w] >= 0 for w in research.INTERNAL)
        x = got[g.candidate_id]
        assert (x.tuning_hits, x.tuning_down_calls, x.validation_hit_delta) == (s["tuning"]["hits"], s["tuning"]["down"], delta["validation"])
        assert (x.qualifying, x.stable_qualifying, x.development_qualifying) == (ok, stable, stable and delta["validation"] >= 0)
        worst = min(delta[w] for w in research.INTERNAL)
        rank.append((-x.development_qualifying, -x.stable_qualifying, -x.qualifying, -worst, -s["tuning"]["accuracy"], -np.nan_to_num(s["tuning"]["precision"], nan=-1), -s["tuning"]["down"], g.candidate_id))
    assert [got[r[-1]].place for r in sorted(rank)] == [1, 2, 3, 4]
    everyone = found.drop("development_qualifying")
    from pyspark.sql import functions as F

    some = everyone.withColumn("development_qualifying", F.col("place") >= 3)
    assert adaptive.choose(some, {}).collect()[0].place == 3
    back = {"down_threshold": 0.55, "max_replacements": 2}
    none = everyone.withColumn("development_qualifying", F.lit(False))
    [x] = adaptive.choose(none, back, allow_down=False).collect()
    assert (x.down_threshold, x.max_replacements, x.selection_mode, x.allow_down) == (0.55, 2.0, "conservative_fallback", False)
    calls = adaptive.apply_chosen(rows, adaptive.choose(none, back, allow_down=False), **kw).toPandas()
    assert set(calls.direction) == {"Up"} and calls.selection_mode.eq("conservative_fallback").all()
    with pytest.raises(Exception, match="not in the grid"):
        adaptive.choose(none, {"down_threshold": 0.9}).collect()


def test_family_ablation(spark):
    from pyspark.sql import functions as F

    rows = research.adapted(spark, SF).where("ready")
    keys = ["panel_id", "position", "series_id"]
    models = rows.select(*keys, F.col("p_up_raw").alias("p"), F.lit("base").alias("config")).unionByName(
        rows.select(*keys, (1 - F.col("p_up_raw")).alias("p"), F.lit("add_x").alias("config"))).unionByName(
        rows.select(*keys, F.when(F.col("position") % 2 == 0, F.col("y_true")).otherwise(F.col("p_up_raw")).alias("p"), F.lit("add_oracle").alias("config")).where("p is not null"))
    edges = spark.createDataFrame([("main", "Brand#1", "Brand#2", 0.5, 40)], "panel_id string, i string, j string, w double, n long")
    scored = ablation.rescored(rows, models, edges, ["base", "add_x", "add_oracle"])
    adapt = dict(research.ADAPT, max_replacements=0)
    made = ablation.study(scored, WINDOWS, ["early_tuning", "late_tuning", "validation"], k=5, cap=research.cap(), adapt=adapt, bands={"core": (1, 5)}, reps=200)
    got = {x.config: x for x in made.collect()}
    calls = {c: H.regime_adaptive(scored.where(F.col("config") == c), cap=research.cap(), **adapt).toPandas() for c in got}
    top = {c: H.top_k(scored.where((F.col("config") == c) & F.col("ready")), "p_up", 5).toPandas() for c in got}
    for c, x in got.items():
        for table, gate in ((top, x.base_gate), (calls, x.adaptive_gate)):
            mine, ref = ({w: totals(t, *WINDOWS[w]) for w in ("early_tuning", "late_tuning", "validation")} for t in (table[c], table["base"]))
            assert gate == all(mine[w]["hits"] >= ref[w]["hits"] and mine[w]["accuracy"] >= ref[w]["accuracy"] for w in mine), c
        assert x.validation_hits == totals(calls[c], *WINDOWS["validation"])["hits"]
        assert x.accepted == (x.base_gate and x.adaptive_gate and x.paired_gate) and (x.rejection_reason == "") == x.accepted
        own = calls[c]
        own = own[own.y_true.notna() & (own["rank"] <= 5)]
        assert x.core_calls == len(own)
    assert got["base"].accepted and got["base"].paired_p10 == 0.0 and got["add_oracle"].accepted and not got["add_x"].accepted
    names = [c.name for c in ablation.family_models(["a"], {"f": ["b"], "g": ["c", "d"]})]
    assert names == ["base", "full", "add_f", "add_g", "drop_f", "drop_g", "only_f", "only_g"]


@pytest.mark.parametrize("name", ["n03_directional", "n04_risk_gate", "n05_controller"])
def test_policy_search(spark, name):
    from pyspark.sql import functions as F

    from walksieve.plans import policies

    rows, grid, policy, fallback = research._studies()[name]
    grid = {k: [v[0], v[-1]] for k, v in grid.items()}
    frame, data = K.grid_frame(spark, grid), rows(spark, SF)
    base = research._up_base(spark, SF)
    found = policies.search(data, frame, policy, base, WINDOWS, rules=research._RULES, order=research._ORDER)
    found = spark.createDataFrame(found.collect(), found.schema)
    got, ref = {x.candidate_id: x for x in found.collect()}, base.toPandas()
    assert len(got) == 2 ** len(grid) and sorted(x.place for x in got.values()) == list(range(1, len(got) + 1))
    for g in frame.collect()[::3]:
        one = policy(data.withColumns({k: F.lit(g[k]) for k in grid}), ("panel_id",)).toPandas()
        delta = {w: totals(one, *b)["hits"] - totals(ref, *b)["hits"] for w, b in WINDOWS.items()}
        x = got[g.candidate_id]
        assert (x.tuning_hits, x.tuning_calls, x.validation_hit_delta) == (totals(one, *WINDOWS["tuning"])["hits"], totals(one, *WINDOWS["tuning"])["calls"], delta["validation"])
        assert x.development_qualifying == (min(delta["early_tuning"], delta["late_tuning"]) >= 0 and delta["validation"] >= 0)
    first = min(got.values(), key=lambda x: x.place)
    want = first if first.development_qualifying else next(x for x in got.values() if all(x[k] == v for k, v in fallback.items()))
    calls = policies.apply_chosen(data, found, frame, policy, fallback)
    e = {x.window: x for x in policies.evaluate(calls, base, WINDOWS, reps=20).collect()}
    assert {x.candidate_id for x in calls.select("candidate_id").distinct().collect()} == {want.candidate_id}
    assert all(e[w].hits == want[f"{w}_hits"] and e[w].hits - e[w].baseline_hits == want[f"{w}_hit_delta"] for w in WINDOWS)
