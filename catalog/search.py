"""Grids, qualification and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.operators import metrics as I
from walksieve.operators import search as K
from walksieve.operators import select as H
from walksieve.operators import targets as T

from .base import WINDOWS, out, q6
from .fixtures import BYK, memo, scores
from .metrics import auc_sql, calls, sw
from .registry import cte, query
from .selectors import ADAPT, cap_col, HI, KEY, LO, _lg, months

CB = ("panel_id", "candidate_id")
WEIGHTS = [i / 20 for i in range(21)]


def coverage_grid(s, d):
    g = K.with_grid(scores(s, d), K.grid_frame(s, {"w": WEIGHTS}))
    c = H.fixed_coverage(g, 5, F.col("w"), by=CB)
    return I.summarize(T.in_windows(c, WINDOWS), ["candidate_id", "w", "window"]).select("candidate_id", "w", "window", "calls", "hits", "accuracy")


cte("t_grid21", f"""
select g.i as candidate_id, g.i / 20.0::double as w, x."window", count(*) as calls, sum(y)::bigint as hits, avg(y) as accuracy from (
 select *, row_number() over (partition by i, pos order by {_lg('p_graph')} + (i / 20.0::double) * coalesce(rel, 0) desc, s) as rk from t_scores, (select unnest(range(21)) as i) where ready) g
join t_win x on pos between lo and hi where rk <= 5 and y is not null group by 1, 2, 3""")
query("k03_coverage_grid", f'select candidate_id, w, "window", calls, hits, {q6("accuracy")} as accuracy from t_grid21')(lambda s, d: out(coverage_grid(s, d), ["accuracy"]))
query("k01_grid_search", f"""
with p as (select candidate_id, max(case when "window" = 'tuning' then hits end) as tuning_hits, max(case when "window" = 'validation' then hits end) as validation_hits, max(case when "window" = 'confirmation' then hits end) as confirmation_hits from t_grid21 group by 1)
select *, row_number() over (order by tuning_hits desc, validation_hits desc, candidate_id) as place from p""")(
    lambda s, d: K.grid_search(K.pivot_windows(coverage_grid(s, d), "candidate_id", list(WINDOWS), ["hits"]), ["-tuning_hits", "-validation_hits", "candidate_id"]))


def adaptive_grid(s, d):
    grid = K.grid_frame(s, {"down_threshold": [0.5, 0.52, 0.55], "stress_trigger": [0.4, 0.5], "max_replacements": [0, 2]})
    g = K.with_grid(scores(s, d), grid)
    c = H.regime_adaptive(g, cap=cap_col("graduated"), **{**ADAPT, "down_threshold": F.col("down_threshold"), "stress_trigger": F.col("stress_trigger"), "max_replacements": F.col("max_replacements"), "replacement_hi": 2}, by=CB)
    return memo("adaptive_grid", s, d, lambda: I.summarize(T.in_windows(c, WINDOWS), ["candidate_id", "window"]))


query("k01_adaptive_grid")(lambda s, d: out(adaptive_grid(s, d), ["accuracy", "down_precision"]))


def qualified(s, d):
    p = K.pivot_windows(adaptive_grid(s, d), "candidate_id", list(WINDOWS), ["hits", "down_calls", "down_precision"])
    return K.qualify(p, {"enough_downs": "tuning_down_calls >= 3", "precise": "tuning_down_precision >= 0.5", "validated": "validation_hits >= 30"})


query("k02_qualify")(lambda s, d: out(qualified(s, d), [f"{w}_down_precision" for w in WINDOWS]))
query("k04_best_weight", f"""
select "window", arg_min(w, b * 1e6 - w * 1e-9) as weight, {q6('min(b)')} as brier from (select "window", w, avg((w * p_up_raw + (1 - w) * prior - y) * (w * p_up_raw + (1 - w) * prior - y)) as b from t_sw, (select unnest([0.0::double, 0.25, 0.5, 0.75, 1.0]) as w) where p_up_raw is not null and prior is not null group by 1, 2) group by 1""")(
    lambda s, d: out(K.best_weight(sw(s, d), "p_up_raw", "prior", "y_true", [0, 0.25, 0.5, 0.75, 1.0], ["window"]), ["brier"]))
query("k05_best_variant")(lambda s, d: K.best_variant(qualified(s, d), "validation_hits >= 25", ["-tuning_hits", "tuning_down_calls", "candidate_id"]).drop("qualifying", *[f"{w}_down_precision" for w in WINDOWS]))
query("k06_gate")(lambda s, d: K.gate(qualified(s, d).drop("qualifying", *[f"{w}_down_precision" for w in WINDOWS]), {"no_loss": "confirmation_hits >= 35", "gain": "validation_hits > tuning_hits"}, "promotable"))
query("k09_threshold_pareto", " union all ".join(f"""
select {t}::double as threshold, {m}::double as margin, "window", count(*) as calls, sum(1 - y)::bigint as hits, {q6('avg(1 - y)')} as precision from t_sw where p_down >= {t}::double and p_down >= p_up + {m}::double group by 3""" for t in (0.5, 0.52, 0.55) for m in (0.0, 0.05)))(
    lambda s, d: out(K.with_grid(sw(s, d), K.grid_frame(s, {"threshold": [0.5, 0.52, 0.55], "margin": [0.0, 0.05]})).where("p_down >= threshold and p_down >= p_up + margin").groupBy("threshold", "margin", "window").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(1 - F.col("y_true")).cast("bigint").alias("hits"), F.avg(1 - F.col("y_true")).alias("precision")), ["precision"]))
query("k08_component_ablation", f"""
select c as config, "window", {q6('avg((p - (1 - y)) * (p - (1 - y)))')} as brier from (
 select "window", y, unnest(['all', 'no_global', 'no_local', 'no_prior']) as c, unnest([(p_down_global + p_down_local + p_down_prior) / 3, (p_down_local + p_down_prior) / 2, (p_down_global + p_down_prior) / 2, (p_down_global + p_down_local) / 2]) as p from t_sw where ready) group by 1, 2""")(
    lambda s, d: out(_components(s, d), ["brier"]))


def _components(s, d):
    parts = ["p_down_global", "p_down_local", "p_down_prior"]
    configs = {"all": parts} | {f"no_{p.split('_')[-1]}": [x for x in parts if x != p] for p in parts}
    items = F.array(*[F.struct(F.lit(n).alias("config"), (sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).alias("p")) for n, cols in configs.items()])
    x = sw(s, d).where("ready").withColumn("x", F.explode(items)).select("window", "y_true", "x.*")
    return x.groupBy("config", "window").agg(F.avg((F.col("p") - 1 + F.col("y_true")) * (F.col("p") - 1 + F.col("y_true"))).alias("brier"))
