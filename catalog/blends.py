"""Score blends and further model variants on the scored panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import features as X
from walksieve.operators import graph as E
from walksieve.operators import market as M
from walksieve.operators import models as Z
from walksieve.operators import priors as G
from walksieve.operators import targets as T
from walksieve.operators.boosting import boosted_forecast

from .base import out, pct_sql, q6
from .fixtures import BYK, brand_table, market, memo, scores, target_table
from .models import LEAN, frame
from .registry import query
from .selectors import arms
from .targets import SHOCK

KEY = 'select s as series_id, pos as "position"'
lg = lambda p, e="1e-6": f"ln(least(1 - {e}, greatest({e}, {p})) / (1 - least(1 - {e}, greatest({e}, {p}))))"


def show(df, *cols, raw=(), places=6):
    return out(df, list(cols), places).select("series_id", "position", *cols, *raw)


query("g02_pattern_prior", f"{KEY}, pn as p_down_pattern_rows, {q6('p_down_pattern')} as p_down_pattern from t_scores")(
    lambda s, d: show(scores(s, d), "p_down_pattern", raw=["p_down_pattern_rows"]))
query("g03_down_blend", f"{KEY}, {q6('least(1 - 1e-6, greatest(1e-6, 0.5::double * p_down_global + 0.3::double * p_down_local + 0.2::double * p_down_pattern))')} as p_down_mix from t_scores where ready")(
    lambda s, d: show(G.down_blend(scores(s, d).where("ready"), local=0.3, pattern=0.2, out="p_down_mix"), "p_down_mix"))
query("g05_logit_overlay", f"{KEY}, {q6('1 / (1 + exp(-(' + lg('p_up', '1e-4') + ' + 0.5::double * coalesce(rel, 0))))')} as p_overlay from t_scores where ready")(
    lambda s, d: show(G.logit_add(scores(s, d).where("ready"), p="p_up", signal="group_relative_logit", w=0.5, out="p_overlay"), "p_overlay"))
query("g06_shrinkage", f"{KEY}, {q6('0.3::double * p_up_raw + 0.7::double * prior')} as p_shrunk from t_scores where ready")(
    lambda s, d: show(G.shrink(scores(s, d).where("ready"), p_local="p_up_raw", p_global="prior", w=0.3, out="p_shrunk"), "p_shrunk"))
query("g07_ramp_weight", f"{KEY}, {q6('case when not ready then 0 else 0.6::double * least(1.0::double, greatest(0.0::double, (prior_rows - 12) / 12.0::double)) end')} as local_weight from t_scores")(
    lambda s, d: show(G.ramp_weight(scores(s, d).withColumn("fallback_used", ~F.col("ready")), w_max=0.6, n_min=12, n_ref=24, rows="prior_rows"), "local_weight"))
query("g12_blend_arms", f"{KEY}, {q6('0.7::double * p_up + 0.3::double * (1 - p_down)')} as up_cal, {q6('0.6::double * p_down + 0.4::double * (1 - p_up)')} as down_cal from t_scores where ready")(
    lambda s, d: show(G.blend_arms(scores(s, d).where("ready").withColumns({"p_up_arm": F.col("p_up"), "p_down_arm": F.col("p_down")}), up_w=0.7, down_w=0.6), "up_cal", "down_cal"))
query("g13_joint_score", f"{KEY}, {q6('0.5::double * (p_select + 1 - p_down)')} as joint_p_up, {q6('1 - 0.5::double * (p_select + 1 - p_down)')} as joint_p_down from t_scores where ready")(
    lambda s, d: show(G.joint_score(arms(s, d).where("ready")), "joint_p_up", "joint_p_down"))
query("g14_active_probability", f"{KEY}, {q6('0.75::double * coalesce(p_up, p_up_raw) + 0.25::double * prior')} as p_blend from t_scores where ready")(
    lambda s, d: show(scores(s, d).where("ready").withColumn("p_blend", 0.75 * F.coalesce("p_up", "p_up_raw") + 0.25 * F.col("prior")), "p_blend"))
for _k, _sc in (("raw_max", "greatest(p_up, p_down)"), ("margin", "abs(p_up - p_down)")):
    query(f"g17_unified_{_k}", f"{KEY}, {q6(_sc, 11)} as unified_score, case when p_down > p_up then 'Down' else 'Up' end as unified_direction from t_scores where ready")(
        lambda s, d, k=_k: show(G.unify(scores(s, d).where("ready"), k), "unified_score", raw=["unified_direction"], places=11))
query("g17_unified_percentile_max", f"""
select {KEY[7:]}, {q6('greatest(u, d)')} as unified_score, case when d > u then 'Down' else 'Up' end as unified_direction from (select *, {pct_sql('p_up')} as u, {pct_sql('p_down')} as d from t_scores where ready)""")(lambda s, d: show(G.unify(scores(s, d).where("ready"), "percentile_max"), "unified_score", raw=["unified_direction"]))


def local(s, d):
    return memo("local", s, d, lambda: Z.fit_local(Z.walk_forward(frame(s, d), LEAN, lo=3, hi=82, out="p_global"), LEAN, lo=3, hi=82, min_rows=30, fallback="p_global"))


query("f04_down_global_and_local")(lambda s, d: show(Z.fit_local(Z.walk_forward(frame(s, d).withColumn("down", 1 - F.col("y_true")), LEAN, y="down", lo=3, hi=82, balanced=True, out="p_down_global"),
                                                         LEAN, y="down", lo=3, hi=82, min_rows=2, min_class=1, fallback="p_down_global"), "p_local", raw=["local_rows", "fallback_used"]))
query("f06_effective_local")(lambda s, d: show(Z.effective_local(local(s, d).withColumn("p_global", F.lit(0.5)), 60, "p_global"), "p_local", raw=["fallback_used"]))


def extreme(s, d):
    keys = [*BYK, "series_id"]
    p = brand_table(s, d)
    f = X.previous_shock(X.consecutive_down(X.trailing_z(p, k=36, m=18)), k=36, m=18, q=0.2)
    y = T.sudden_drops(target_table(s, d), **SHOCK).select(*keys, F.col("extreme_down").alias("y_true"))
    return f.drop("month", "value").join(y, keys)


query("f11_extreme_down")(lambda s, d: show(Z.walk_forward(extreme(s, d).where("ret1_z is not null"), ["ret1_z", "mom3_z", "consec_down", "prev_shock"], lo=3, hi=82, c=0.3, balanced=True), "p", raw=["fit_through"]))
query("f13_lean_down")(lambda s, d: show(Z.walk_forward(frame(s, d).withColumn("y_true", 1 - F.col("y_true")), LEAN, lo=3, hi=82, missing_flags=False), "p", raw=["fit_through"]))
query("f14_model_zoo")(lambda s, d: out(Z.fit_zoo(frame(s, d), LEAN, y="y_true", through=70), ["p_logistic", "p_boosted"], 5).drop("panel_id"))
query("f15_correctness_ranker")(lambda s, d: show(Z.walk_forward(scores(s, d).where("ready"), ["p_up", "p_down", "prior", "group_relative_logit", "regime_stress"], lo=3, hi=82, c=0.1, missing_flags=False), "p", raw=["fit_through"]))
query("f16_directional_ranker")(lambda s, d: show(Z.walk_forward(scores(s, d).where("ready"), ["p_up", "p_down", "prior", "return_1", "momentum_3", "forecast_breadth"], lo=3, hi=82, c=0.03, effect="group_id"), "p", raw=["fit_through"]))
query("f09_boosted_breadth")(lambda s, d: out(boosted_forecast(market(s, d).join(T.broad_down(target_table(s, d)).select(*BYK, "breadth"), BYK), ["market_breadth", "market_dispersion", "regime_stress"], "breadth", lo=3, hi=82), ["forecast_breadth"], 5).drop("panel_id"))
