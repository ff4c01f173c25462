"""Audits and composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import audit as A
from walksieve.operators import market as M
from walksieve.operators import models as Z
from walksieve.operators import search as K
from walksieve.operators import select as H
from walksieve.operators import targets as T
from walksieve.plans import studies as N

from .base import WINDOWS, brand, out, q6, supplier
from .fixtures import BYK, brand_table, market, memo, scores, target_table
from .market import timing
from .metrics import calls
from .models import LEAN, frame
from .registry import cte, query
from .selectors import HI, arms, months
from .targets import SHOCK


def production(s, d):
    return H.top_k(scores(s, d), "p_select", 5)


def inserted(s, d):
    return H.insert_down(arms(s, d), cap="cap", hi=HI, margin=0.0, floor=0.5, max_down=3)


query("l01_ledger")(lambda s, d: A.ledger(inserted(s, d), H.dynamic_cap(arms(s, d), F.col("cap"), HI)).drop("panel_id"))
query("l02_reconcile", """
with p as (select * from t_scores where accepted), j as (select coalesce(a.pos, b.pos) as pos, a.dir as da, case when b.s is not null then 'Up' end as db, coalesce(a.hit, 0) as ha, coalesce(b.y, 0) as hb from t_calls a full join p b on a.s = b.s and a.pos = b.pos),
k as (select *, case when db is null then 'added' when da is null then 'removed' when da = db then 'kept' else 'redirected' end as k from j)
select pos as "position", sum(case when k = 'kept' then ha - hb else 0 end)::double as kept_delta, sum(case when k = 'redirected' then ha - hb else 0 end)::double as redirected_delta, sum(case when k = 'added' then ha else 0 end)::double as added_delta,
 -sum(case when k = 'removed' then hb else 0 end)::double + 0.0::double as removed_delta, sum(ha)::double as candidate_hits, sum(hb)::double as production_hits, sum(ha)::double - sum(hb)::double as hit_delta, 0.0::double as residual from k group by 1""")(
    lambda s, d: A.reconcile(calls(s, d), production(s, d)).drop("panel_id"))
query("l03_pool_probe", """
select c.pos as "position", count(*) as calls, count(p.s) as in_pool, count(*) - count(p.s) as outside_pool from t_calls c left join (select s, pos from t_scores where accepted) p on p.s = c.s and p.pos = c.pos group by 1""")(
    lambda s, d: A.pool_probe(calls(s, d), production(s, d)).drop("panel_id"))
query("l04_ignored", f"""
select (p_down >= 0.45)::int + (p_down >= 0.5)::int + (p_down >= 0.55)::int as bucket, count(*) as "rows", {q6('avg(p_down)')} as mean_score, {q6('avg(1 - y)')} as down_rate from t_scores t
where ready and y is not null and not exists (select 1 from t_calls c where c.s = t.s and c.pos = t.pos) group by 1""")(
    lambda s, d: out(A.ignored(scores(s, d), calls(s, d), [0.45, 0.5, 0.55]), ["mean_score", "down_rate"]))
query("l05_by_regime")(lambda s, d: out(A.by_regime(scores(s, d), market(s, d), "regime_stress"), ["up_rate", "auc"]))
query("l06_training_audit", f"""
with k as (select p.s, p.pos, count(t.y) as n, coalesce(sum(t.y), 0) as u from t_brand_y p left join t_brand_y t on t.s = p.s and t.pos <= p.pos - 2 group by 1, 2)
select pos as "position", sum(n)::bigint as "rows", {q6('sum(u) / nullif(sum(n), 0)')} as up_share, sum((n >= 36 and least(u, n - u) >= 8)::int) as series_ready from k group by 1""")(
    lambda s, d: out(A.training_audit(target_table(s, d), min_rows=36), ["up_share"]).drop("panel_id"))
query("l07_coef_stability")(lambda s, d: out(A.coef_stability(Z.fit_pooled(frame(s, d), LEAN, lo=3, hi=82).coefficients(s)), ["mean", "std", "sign_agreement"], 5))
query("l08_reach", f"""
select t.s as series_id, {q6('avg(((p_up >= 0.5) = (y = 1))::int) - avg(((prior >= 0.5) = (y = 1))::int)')} as gain, coalesce(max(c.n), 0) as calls from t_scores t left join (select s, count(*) as n from t_calls group by 1) c on c.s = t.s
where y is not null and ready group by 1""")(lambda s, d: out(A.reach(scores(s, d).where("ready"), calls(s, d), "p_up", "prior"), ["gain"]))
query("l09_tail_check", f"""
with m as (select m.*, w."window", quantile_cont(stress, 0.75) over (partition by w."window") as thr from t_months m join t_win w on pos between lo and hi)
select "window", count(*) as months, sum((stress >= thr)::int) as tail_months, {q6('avg(case when stress >= thr then flip_target end)')} as tail_rate, {q6('avg(flip_target)')} as rate from m group by 1""")(
    lambda s, d: out(A.tail_check(T.in_windows(months(s, d), WINDOWS), "stress", "flip_target", 0.25, ["window"]), ["tail_rate", "rate"]))
query("l13_or_unavailable", """
select p.pos as "position", c.calls, c.calls is not null as available, case when c.calls is null then 'no calls in this month' end as reason from (select distinct pos from t_brand) p left join (select pos, count(*) as calls from t_calls group by 1) c on c.pos = p.pos""")(
    lambda s, d: A.or_unavailable(brand_table(s, d).select("position").distinct(), calls(s, d).groupBy("position").agg(F.count(F.lit(1)).alias("calls")), ["position"], "no calls in this month"))
query("l14_score_answers", """
with k as (select pos, count(*) as k, sum(hit) as h from t_calls group by 1),
r as (select *, row_number() over (partition by pos order by abs(p_up_raw - 0.5) desc, s) as place from t_scores where ready and y is not null and p_up_raw is not null)
select k.pos as "position", count(*) as calls, sum(case when p_up_raw >= 0.5 then y else 1 - y end) as answer_hits, max(h) as production_hits from k join r on r.pos = k.pos and r.place <= k.k group by 1""")(lambda s, d: A.score_answers(scores(s, d).where("ready"), scores(s, d).select(*BYK, "series_id", F.col("p_up_raw").alias("p_up")), calls(s, d), hi=HI + 2).drop("panel_id"))
query("n01_uptrend_baseline")(lambda s, d: N.uptrend_baseline(brand_table(s, d), LEAN, lo=50, hi=82, graph_upto=48, k=5, n_prior=24, min_labels=12, train=frame(s, d)).select("series_id", "position", "rank", rnd("p_up", 5).alias("p_up")))
query("n10_next_periods")(lambda s, d: N.next_periods(brand_table(s, d)).select("horizon", "month", F.to_json("selections").alias("selections")))
query("n12_shock_clustering", f"""
select shock as sudden_drop, count(nx) as months, {q6('avg(nx)')} as next_shock_rate from (select *, lead(case when valid then shock::int::double end) over (partition by s order by pos) as nx from t_shock_supplier) where valid group by 1""")(
    lambda s, d: out(N.shock_clustering(T.sudden_drops(T.direction_targets(supplier(s, d)), **SHOCK))[1], ["next_shock_rate"]))
query("n12_systemic_months", f"""select pos as "position", {q6('avg(shock::int)')} as shock_share from t_shock_supplier where valid group by 1 having avg(shock::int) >= 0.1""")(
    lambda s, d: out(N.shock_clustering(T.sudden_drops(T.direction_targets(supplier(s, d)), **SHOCK), share=0.1)[0], ["shock_share"]).drop("panel_id"))
query("n17_locked_evaluation")(lambda s, d: out(N.locked_evaluation({"adaptive": calls(s, d), "baseline": production(s, d)}, 65, 80, reps=200), ["observed", "p05", "p95"]).drop("panel_id"))
query("n19_context_export")(lambda s, d: N.context_export(supplier(s, d)).drop("panel_id"))
query("k11_signal_study")(lambda s, d: out(N.signal_study(months(s, d).join(timing(s, d), BYK), M.SIGNALS, WINDOWS), ["auc"]))
query("k07_family_ablation")(lambda s, d: out(N.family_ablation(frame(s, d), K.family_configs({"momentum": ["momentum_3", "momentum_6"], "risk": ["return_volatility_12"]}, "only"), lo=3, hi=82), ["brier", "auc"], 4))
