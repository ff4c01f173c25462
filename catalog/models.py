"""Walk-forward models, calibration and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import features as X
from walksieve.operators import market as M
from walksieve.operators import metrics as I
from walksieve.operators import models as Z
from walksieve.operators import priors as G
from walksieve.operators import targets as T

from .base import GROUP_SQL, WINDOWS, brand, out, part, pct_sql, q6, supplier
from .features import D, L, M as MOM, R, W, KEY
from .fixtures import BYK, brand_table, group_table, market, memo, scores, target_table
from .market import timing
from .metrics import calls
from .registry import cte, query

LEAN = ["direction_lag_1", "momentum_3", "momentum_6", "distance_mean_12", "return_volatility_12"]


def frame(s, d):
    """Feature panel with labels: the training table of all models."""
    keys = [*BYK, "series_id"]
    return memo("frame", s, d, lambda: X.feature_panel(brand_table(s, d)).drop("month", "value").join(
        target_table(s, d).select(*keys, "y_true"), keys))


def p6(df, c="p"):
    return df.select("series_id", "position", rnd(c, 5).alias(c), "fit_through")


query("f01_walk_forward")(lambda s, d: p6(Z.walk_forward(frame(s, d), LEAN, lo=3, hi=82)))
query("f02_pooled_with_effects")(lambda s, d: p6(Z.walk_forward(frame(s, d), LEAN, lo=3, hi=82, effect="series_id")))
query("f03_balanced_drop_model")(lambda s, d: p6(Z.walk_forward(_drops(s, d), LEAN, y="drop", lo=3, hi=82, balanced=True)))
query("f05_local_models")(lambda s, d: Z.fit_local(frame(s, d), LEAN, lo=3, hi=82, min_rows=36).select("series_id", "position", rnd("p_local", 5).alias("p_local"), "local_rows", "fallback_used"))
query("f08_coefficients")(lambda s, d: out(Z.fit_pooled(frame(s, d), LEAN, lo=3, hi=82).coefficients(s), ["coefficient"], 5))
query("f10_ridge_quality")(lambda s, d: out(Z.fit_ridge(market(s, d).join(T.broad_down(target_table(s, d)).select(*BYK, "breadth"), BYK), ["forecast_breadth", "regime_stress", "market_dispersion"], "breadth", fallback="forecast_breadth"), ["forecast"], 5).drop("panel_id"))
query("f12_market_logit")(lambda s, d: out(Z.market_logit(timing(s, d).join(T.broad_down(target_table(s, d)).select(*BYK, "broad_down"), BYK), M.SIGNALS, "broad_down", min_n=24), ["p_market"], 5).drop("panel_id"))
query("f17_joint_correctness")(lambda s, d: out(Z.fit_correctness(scores(s, d).where("ready"), through=60), ["up_cal", "down_cal"], 5).drop("panel_id"))
query("f18_platt")(lambda s, d: Z.platt(scores(s, d).where("ready"), "p_up", "y_true", through=60).select("series_id", "position", rnd("calibrated", 5).alias("calibrated")))
query("f19_isotonic")(lambda s, d: Z.isotonic(scores(s, d).where("ready"), "p_up", "y_true", through=60).select("series_id", "position", rnd("calibrated", 5).alias("calibrated")))
query("f20_prequential")(lambda s, d: Z.prequential(scores(s, d).where("ready"), "p_up", "y_true", lo=3, hi=82, frozen_after=64).select("series_id", "position", rnd("calibrated", 5).alias("calibrated"), "status", "fit_through"))


def _drops(s, d):
    from .targets import SHOCK

    k = T.sudden_drops(target_table(s, d), **SHOCK).select(*BYK, "series_id", F.when(F.col("label_valid"), F.col("sudden_drop").cast("double")).alias("drop"))
    return frame(s, d).join(k, [*BYK, "series_id"])


query("f21_cohort_probability", f"""
with m as (select pos, sum(hit) as h, count(*) as n from t_calls where hit is not null group by 1), a as (select m.pos, count(k.pos) as mo, (1 + coalesce(sum(k.h), 0)) / (2.0::double + coalesce(sum(k.n), 0)) as g from m left join m k on k.pos <= m.pos - 2 group by 1),
x as (select c.s, c.pos, c.dir, count(k.hit) as n, coalesce(sum(k.hit), 0) as h from t_calls c left join t_calls k on k.dir = c.dir and k.pos <= c.pos - 2 and k.hit is not null where c.hit is not null group by 1, 2, 3)
select x.s as series_id, x.pos as "position", case when mo >= 12 then {q6('(x.h + 50 * g) / (x.n + 50)')} end as cohort_p from x join a on a.pos = x.pos""")(
    lambda s, d: out(Z.cohort_probability(calls(s, d), ["direction"]), ["cohort_p"]).select("series_id", "position", "cohort_p"))

LV = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
cte("t_ctx", f"select s, pos, d from (select s, pos, {D(0)} as d from t_supplier {W}) where d is not null")
query("f24_drift_quantiles", f"""
with n as (select s, pos, (last_value(d) over w) as lst, first_value(d) over w as fst, count(*) over w as n, stddev_pop(d) over w as sc from t_ctx window w as (partition by s order by pos rows between unbounded preceding and current row)),
q as (select *, lst + case when n >= 2 then (lst - fst) / (n - 1) else 0 end * 2 as c from n)
select s as series_id, pos as "position", {q6('1.6::double * sc', 1)} as width, {q6('c / (1.6::double * sc)', 5)} as centre from q where n >= 2 and sc > 0""")(
    lambda s, d: _shape(quantiles(s, d)))


def _shape(df):
    q = lambda i: F.get("quantiles", F.lit(i))
    w = (q(8) - q(0)).alias("width")
    x = df.select("series_id", "position", w, (q(4) / F.nullif(q(8) - q(0), F.lit(0.0))).alias("centre")).where("width > 0")
    return out(out(x, ["width"], 1), ["centre"], 5)


def quantiles(s, d):
    p = X.diff_context(supplier(s, d))
    back = lambda k: F.lag("value", k).over(X.series_window())
    p = p.withColumns({"_now": back(1).isNotNull() & back(2).isNotNull(), "_d": back(1) - back(2)})
    p = p.withColumn("_n", F.count("_d").over(X.series_window(X.UNB, 0))).where("_now and _n >= 2")
    return Z.drift_forecaster(p.select("panel_id", "series_id", "position", "context"), LV)


query("f22_quantiles_to_p", f"""
with n as (select s, pos, (last_value(d) over w) as lst, first_value(d) over w as fst, count(*) over w as n, stddev_pop(d) over w as sc from t_ctx window w as (partition by s order by pos rows between unbounded preceding and current row)),
q as (select *, lst + (lst - fst) / (n - 1) * 2 as c from n where n >= 2),
z as (select *, 0.5::double - c / (2 * sc) as f from q)
select s as series_id, pos as "position", {q6('least(0.999::double, greatest(0.001::double, 1 - least(1.0::double, greatest(0.0::double, f))))', 5)} as p_up from z where sc > 0""")(
    lambda s, d: Z.quantiles_to_p(quantiles(s, d), LV).where("not failure_flag").select("series_id", "position", rnd("p_up", 5).alias("p_up")))
_ge = lambda e: f"case when {e} then 1.0::double when not ({e}) then 0.0::double end"
query("f25_naive_directions", f"""
with a as (select s, pos, y, {D(0)} as d, {D(1)} as l, {MOM(3)} as m3, {MOM(6)} as m6, {MOM(12)} as m12, {L(0)} as src, {R('avg($)', 'v', 12, 6, 1)} as mean from t_brand_y {W})
select s as series_id, pos as "position", {_ge('avg(y) over k >= 0.5')} as majority, {_ge('d > 0')} as persistence, {_ge('d <= 0')} as reversal, {_ge('m3 > 0')} as momentum_3, {_ge('m6 > 0')} as momentum_6, {_ge('m12 > 0')} as momentum_12,
 {_ge('src < mean')} as mean_reversion from a window k as (partition by s order by pos range between unbounded preceding and 2 preceding)""")(
    lambda s, d: Z.naive_direction(target_table(s, d)).select("series_id", "position", *[c for c in Z.NAIVE_RULES if c != "ar1"]))
query("f26_vote")(lambda s, d: Z.vote(Z.naive_direction(target_table(s, d)), {"majority": 1.0, "momentum_12": 0.5, "mean_reversion": 0.5, "ar1": 0.5}).select("series_id", "position", rnd("p_vote").alias("p_vote")))
query("g09_eb_rate", f"""
with l as (select s, pos, y, row_number() over (partition by s order by pos) as c from t_part_y where y is not null),
k as (select p.s, p.pos, max(l.c) as c from t_part_y p left join l on l.s = p.s and l.pos <= p.pos - 2 group by 1, 2),
r as (select k.s, k.pos, case when count(l.y) >= 6 then avg(l.y) end as prior, count(l.y) as n from k left join l on l.s = k.s and l.c <= k.c and l.c > k.c - 24 group by 1, 2),
m as (select pos, avg(prior) as m, var_samp(prior) as v, avg(1.0::double / n) as i from r where prior is not null group by 1),
t as (select r.*, m.m, greatest(0.0::double, coalesce(m.v, 0) - m.m * (1 - m.m) * m.i) as tau2 from r left join m on m.pos = r.pos)
select s as series_id, pos as "position", case when prior is not null then {q6('m + case when tau2 > 0 then tau2 / (tau2 + m * (1 - m) / n) else 0 end * (prior - m)')} end as eb_prior from t""")(lambda s, d: out(G.eb_rate(G.available_rate(T.direction_targets(part(s, d)), n=24, min_labels=6)), ["eb_prior"]).select("series_id", "position", "eb_prior"))
query("g08_group_reliability", f"""
with m as (select pos, avg(rel * (y - p_graph)) - avg(rel) * avg(y - p_graph) as a, avg(rel * rel) - avg(rel) * avg(rel) as b from t_scores
           where ready and p_graph is not null and rel is not null and y is not null group by 1),
e as (select distinct pos from t_scores where ready),
w as (select e.pos, coalesce(sum(a) over z / nullif(coalesce(sum(b) over z, 0) + 1, 0), 0) as raw, count(a) over z as n from e left join m on m.pos = e.pos
      window z as (order by e.pos range between 25 preceding and 2 preceding))
select pos as "position", {q6('raw', 5)} as raw_weight, n as history_months, {q6('least(0.75::double, greatest(0.0::double, raw))', 5)} as reliability_weight from w""")(lambda s, d: out(G.group_reliability(scores(s, d).where("ready"), n=24), ["raw_weight", "reliability_weight"], 5).drop("panel_id"))
query("g10_seasonal_deviation")(lambda s, d: out(G.seasonal_dev(target_table(s, d)), ["seasonal_tau2", "seasonal_shrunk", "seasonal_raw"]).drop("panel_id"))
_KS = ["prior", "p_up_raw", "p_up", "p_select"]
query("g11_rank_ensemble", f"""
with k as (select s, pos, {", ".join(f"{pct_sql(c)} as k{i}" for i, c in enumerate(_KS))} from t_scores where ready)
select s as series_id, pos as "position", case when {" + ".join(f"(k{i} is not null)::int" for i in range(4))} >= 3 then
 {q6("(" + " + ".join(f"coalesce(k{i}, 0)" for i in range(4)) + ") / (" + " + ".join(f"(k{i} is not null)::int" for i in range(4)) + ")")} end as window_ensemble from k""")(lambda s, d: out(G.rank_ensemble(scores(s, d).where("ready"), ["prior", "p_up_raw", "p_up", "p_select"]), ["window_ensemble"]).select("series_id", "position", "window_ensemble"))
query("g04_group_strength", f"""select g as group_id, pos as "position", {q6('gp')} as group_prior, {q6('mp')} as market_prior from t_group_brand""")(
    lambda s, d: out(G.group_strength(target_table(s, d), group_table(s, d)), ["group_prior", "market_prior"]).select("group_id", "position", "group_prior", "market_prior"))
query("g18_hierarchical_prior", f"""select g as group_id, pos as "position", {q6('(coalesce(gs, 0) + 24 * mp) / (coalesce(gn, 0) + 24)')} as group_prior from t_group_brand""")(
    lambda s, d: out(G.group_strength(target_table(s, d), group_table(s, d), tau=24.0), ["group_prior"]).select("group_id", "position", "group_prior"))
query("g15_miss_overlay", f"""
with a as (select s, pos + 2 as pos, case when n >= 2 then m end as miss, case when n >= 2 then n end as cnt from (
  select s, pos, count(y) over w as n, avg(1 - y) over w as m from t_brand_y where y is not null window w as (partition by s order by pos rows between 6 preceding and 1 preceding))),
b as (select g, pos + 2 as pos, case when n >= 2 then m end as rate, case when n >= 2 then d end as sd from (
  select g, pos, count(u) over w as n, avg(u) over w as m, stddev_samp(u) over w as d from (select {GROUP_SQL} as g, pos, avg(y) as u from t_brand_y where y is not null group by 1, 2)
  window w as (partition by g order by pos rows between 6 preceding and 1 preceding))),
c as (select t.s, t.pos, t.p_select as p, a.miss, b.rate, b.sd, coalesce(a.cnt, 0) as n, least(1.0::double, greatest(0.0::double, (coalesce(a.cnt, 0) - 1) / 3.0::double)) as h
      from t_scores t left join a on a.s = t.s and a.pos = t.pos left join b on b.g = t.g and b.pos = t.pos where t.ready),
d as (select *, 0.45::double - 0.10::double * h as thr, least(0.5::double, greatest(-0.5::double, coalesce(rate, 0.5) - 0.5 - 0.5::double * coalesce(sd, 0.2))) as steady,
      least(1 - 1e-6, greatest(1e-6, p)) as q from c),
e as (select *, case when miss is not null and n >= 1 then least(1.0::double, greatest(0.0::double, greatest(miss - thr, 0.0::double) / greatest(1 - thr, 1e-3))) else 0 end * h as fault from d)
select s as series_id, pos as "position", {q6('least(1 - 1e-6, greatest(1e-6, 1 / (1 + exp(-(ln(q / (1 - q)) - 0.4::double * fault + 0.3::double * steady)))))')} as p_overlay from e""")(lambda s, d: out(_overlay(s, d), ["p_overlay"]).select("series_id", "position", "p_overlay"))


def _overlay(s, d):
    t = target_table(s, d)
    x = scores(s, d).where("ready").join(X.recent_miss(t), [*BYK, "series_id"], "left").join(M.group_stability(t, group_table(s, d)), [*BYK, "group_id"], "left")
    return G.miss_overlay(x)


_PARTS = ["p_down_global", "p_down_local", "p_down_pattern", "p_down_prior"]
_TOP = "case when base_up_rank <= 5 then {} end"
_AT = "max(case when base_up_rank = {} then p_select end)"
query("d20_origin_quality", f"""
with a as (select *, {" + ".join(f"({p} is not null)::int" for p in _PARTS)} as n, {" + ".join(f"coalesce({p}, 0)" for p in _PARTS)} as t from t_scores),
b as (select *, t / nullif(n, 0) as m from a), c as (select *, sqrt(({" + ".join(f"coalesce(({p} - m) * ({p} - m), 0)" for p in _PARTS)}) / nullif(n, 0)) as sd from b),
g as (select pos, max(n) / sum(n) as conc from (select pos, g, count(*) as n from t_scores where base_up_rank <= 5 group by 1, 2) group by 1)
select c.pos as "position", max(forecast_breadth) as forecast_breadth, max(regime_stress) as regime_stress, {q6(f"avg({_TOP.format('p_select')})")} as top_score_mean, {q6(f"min({_TOP.format('p_select')})")} as top_score_min,
 {q6(f"stddev_pop({_TOP.format('p_select')})")} as top_score_dispersion, {q6(f"{_AT.format(5)} - {_AT.format(6)}")} as cutoff_margin, {q6(f"({_AT.format(4)} - {_AT.format(7)}) / 3")} as cutoff_slope,
 {q6(f"avg({_TOP.format('sd')})")} as down_disagreement, {q6("avg(case when ready and base_up_rank is not null then 1.0::double else 0.0::double end)")} as ready_share,
 {q6(f"avg({_TOP.format('abs(p_graph - p_up)')})")} as graph_adjustment, {q6("max(conc)")} as group_concentration, 1.0::double - 2.0::double * abs(max(regime_stress) - 0.5) as regime_uncertainty
from c left join g on g.pos = c.pos group by c.pos""")(lambda s, d: out(M.origin_quality(scores(s, d), k=5), ["top_score_mean", "top_score_min", "top_score_dispersion", "cutoff_margin", "cutoff_slope", "down_disagreement", "ready_share", "graph_adjustment", "group_concentration"]).drop("panel_id"))
query("d21_historical_quality", f"""
with q as (select pos, avg(case when base_up_rank between 6 and 8 then y end) as q from t_scores group by 1),
k as (select pos, q, row_number() over (order by pos) as c from q where q is not null),
m as (select q.pos, q.q, max(k.c) as c from q left join k on k.pos <= q.pos - 2 group by 1, 2)
select m.pos as "position", {q6("m.q")} as quality_6_8, {q6("(select avg(k.q) from k where k.c <= m.c and k.c > m.c - 24)")} as historical_quality from m""")(lambda s, d: out(M.historical_quality(T.band_target(scores(s, d), 6, 8), "quality_6_8"), ["quality_6_8", "historical_quality"]).drop("panel_id"))
