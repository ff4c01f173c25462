"""Selection policies on the scored panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.operators import market as M
from walksieve.operators import priors as G
from walksieve.operators import select as H
from walksieve.operators import targets as T

from .base import WINDOWS, groups, out, pct_sql, q6
from .fixtures import BYK, K, brand_table, group_table, market, scores, target_table
from .registry import cte, query

KEY = 'select s as series_id, pos as "position"'
LO, HI = 5, 8
CAPS = dict(lo=LO, hi=HI)


def show(c, *extra):
    return c.select("series_id", "position", "rank", *extra)


def ranked_sql(score, k, src="t_scores", where="ready", extra="", by="pos"):
    return f'select s as series_id, pos as "position", rk as rank{extra} from (select *, row_number() over (partition by {by} order by {score} desc, s) as rk from {src} where {where}) where rk <= {k}'


query("h01_top_k", ranked_sql("p_select", 5))(lambda s, d: show(H.top_k(scores(s, d), "p_select", 5)))

CAP_SQL = {"stress_up": "round_even(5 + 3 * least(1.0::double, greatest(0.0::double, (regime_stress - 0.35) / (0.75::double - 0.35))), 0)::int",
           "stress_down": "round_even(5 + 3 * (1 - least(1.0::double, greatest(0.0::double, (regime_stress - 0.35) / (0.75::double - 0.35)))), 0)::int",
           "binary": "case when forecast_breadth >= 0.5 then 8 else 5 end",
           "graduated": "coalesce(round_even(5 + 3 * least(1.0::double, greatest(0.0::double, (forecast_breadth - 0.42) / (0.56::double - 0.42))), 0)::int, 5)",
           "schedule": "case when forecast_breadth >= 0.52 then 8 when forecast_breadth >= 0.48 then 6 else 5 end"}
_CAPS = {"stress_up": lambda: H.cap_stress("regime_stress", LO, HI, 0.35, 0.75), "stress_down": lambda: H.cap_stress("regime_stress", LO, HI, 0.35, 0.75, False),
         "binary": lambda: H.cap_binary("forecast_breadth", LO, HI, 0.5), "graduated": lambda: H.cap_graduated("forecast_breadth", LO, HI, 0.42, 0.56),
         "schedule": lambda: H.schedule_graduated("forecast_breadth", 0.48, 0.52, (5, 6, 8))}


def cap_col(name):
    """A cap as a column; columns need a session, which importing this module must not."""
    return _CAPS[name]()


query("h02_caps", 'select distinct pos as "position", ' + ", ".join(f"{e} as {n}" for n, e in CAP_SQL.items()) + " from t_scores")(
    lambda s, d: scores(s, d).select("position", *[cap_col(n).alias(n) for n in _CAPS]).distinct())
for _c in ("graduated", "stress_up"):
    query(f"h03_dynamic_cap_{_c}", ranked_sql("p_select", CAP_SQL[_c]))(
        lambda s, d, c=_c: show(H.dynamic_cap(scores(s, d), cap_col(c), HI)))
_lg = lambda p: f"ln(least(1 - 1e-6, greatest(1e-6, {p})) / (1 - least(1 - 1e-6, greatest(1e-6, {p}))))"
query("h04_fixed_coverage", ranked_sql(f"({_lg('p_graph')} + 0.4::double * coalesce(rel, 0))", 6))(lambda s, d: show(H.fixed_coverage(scores(s, d), 6, 0.4)))

_EX = "coalesce(least(1.0::double, greatest(0.0::double, (regime_stress - 0.45::double) / (1 - 0.45::double))), 0)"
cte("t_ra0", f"""
select *, {CAP_SQL['graduated']} as cap, {_EX} as ex, least(1 - 1e-6, greatest(1e-6, coalesce(p_down, 0.5) + 0.05::double * {_EX} + 0.03::double * (0.75::double * coalesce(ps, 0) + 0.25::double * coalesce(pss, 0)))) as pd from t_scores where ready""")
cte("t_ra1", """select *, pd >= 0.6 as hard, (pd >= 0.6 or (pd >= 0.52 and pd >= p_graph + 0.01::double - 0.05::double * ex)) as cand, row_number() over (partition by pos order by p_select desc, s) as pool from t_ra0""")
cte("t_ra2", f"""
select *, pool <= cap as inp, (cap <= {LO} or pool <= {LO}) and pool <= cap as core,
 round_even(cap * 0.3::double * greatest(0.0::double, (regime_stress - 0.45::double) / (1 - 0.45::double)), 0) as quota from t_ra1""")
cte("t_ra3", """
select *, sum((core and hard)::int) over (partition by pos) as nhard, case when core and cand then row_number() over (partition by pos, core and cand order by pd desc, s) end as fl,
 case when inp then row_number() over (partition by pos, inp order by p_select, s) end as weak,
 case when not inp and cand and pd >= p_graph + 0.02::double then row_number() over (partition by pos, (not inp and cand and pd >= p_graph + 0.02::double) order by pd desc, s) end as rep from t_ra2""")
cte("t_ra4", "select *, least(2, count(rep) over (partition by pos)) as nrep from t_ra3")
cte("t_adaptive", """
select s, pos, y, cap, pd, p_graph as pu, greatest(pd, p_graph) as conf, case when coalesce(rep <= 2, false) or coalesce(fl <= least(cap, greatest(quota, nhard)), false) then 'Down' else 'Up' end as dir,
 coalesce(rep <= 2, false) as repl, regime_label from t_ra4 where (inp and weak > nrep) or coalesce(rep <= 2, false)""")
ADAPT = dict(hi=HI, min_cap=LO, down_threshold=0.52, down_margin=0.01, stress_trigger=0.45, max_down_share=0.3,
             regime_bonus=0.05, shock_bonus=0.03, hard_threshold=0.6, replacement_margin=0.02, max_replacements=2)


def adaptive(spark, d):
    return H.regime_adaptive(scores(spark, d), cap=cap_col("graduated"), **ADAPT)


query("h05_regime_adaptive", f"""{KEY}, cap, dir as direction, repl as replacement, row_number() over (partition by pos order by conf desc, s) as rank from t_adaptive""")(
    lambda s, d: show(adaptive(s, d), "cap", "direction", "replacement"))
query("h05_selection_changes", f"""
with b as (select s, pos, 'Up' as dir from (select *, row_number() over (partition by pos order by p_select desc, s) as rk from t_scores where ready) where rk <= 5)
select coalesce(a.s, b.s) as series_id, coalesce(a.pos, b.pos) as "position", b.s is null as added, a.s is null as removed, coalesce(a.dir <> b.dir, false) as direction_changed
from t_adaptive a full join b on a.s = b.s and a.pos = b.pos""")(
    lambda s, d: H.with_changes(adaptive(s, d), H.top_k(scores(s, d), "p_select", 5)).drop("panel_id"))

_dn = "(p_down >= 0.52 and p_down >= p_up + 0.01::double)"
query("h06_bidirectional", ranked_sql(f"case when {_dn} then p_down else p_up end", 6, extra=f", case when {_dn} then 'Down' else 'Up' end as direction", where="ready and p_down is not null"))(
    lambda s, d: show(H.bidirectional(scores(s, d), threshold=0.52, margin=0.01, k=6), "direction"))
cte("t_risk", """select *, case when p_down_global is not null then (rank() over (partition by pos, p_down_global is null order by p_down_global) + (count(*) over (partition by pos, p_down_global) - 1) / 2.0::double) / count(p_down_global) over (partition by pos) end as rp from t_scores""")
query("h07_risk_gate", ranked_sql("round(p_select - 0.15::double * rp, 12)", 5, "t_risk", "ready and p_down_global is not null"))(
    lambda s, d: show(H.risk_gate(scores(s, d).withColumn("p_select", F.col("p_select")), penalty=0.15, k=5, risk="p_down_global")))

ROLES = ["Brand#7", "Brand#2", "Brand#19"]
cte("t_mb3", "select pos, mb3 from t_mkt_brand")
query("h08_force_roles", """
with b as (select *, row_number() over (partition by pos order by p_select desc, s) as rk from t_scores where ready),
c as (select b.*, s in ('Brand#7', 'Brand#2', 'Brand#19') as role, coalesce(m.mb3 <= 0.5, false) as st from b join t_mb3 m on m.pos = b.pos),
n as (select pos, count(*) as n from c where st and role and rk > 5 group by 1),
v as (select c.*, row_number() over (partition by c.pos, role order by p_select, s) as vr, coalesce(n.n, 0) as n from c left join n on n.pos = c.pos where rk <= 5),
o as (select s, pos, p_select, role and st as forced from v where role or vr > n union all select s, pos, p_select, true from c where st and role and rk > 5)
select s as series_id, pos as "position", forced, row_number() over (partition by pos order by p_select desc, s) as rank from o""")(
    lambda s, d: show(H.force_roles(H.top_k(scores(s, d), "p_select", 5), scores(s, d), market(s, d), ROLES, threshold=0.5), "forced"))


def controller_input(s, d):
    from walksieve.functions.ordering import pct_rank

    x = pct_rank(scores(s, d), BYK, "p_down_global", "risk_percentile")
    return x.withColumns({"direction": F.when(F.col("p_down") > F.col("p_up"), "Down").otherwise("Up"), "eligible": F.lit(True), "data_quality_ok": F.lit(True),
                          "context_stress": F.col("regime_stress") > 0.5, "role_list": F.lit("Brand#7, Brand#2,Brand#19")})


query("h09_controller", ranked_sql("round(p_select + case when p_down > p_up then 0.1::double * rp else -0.2::double * rp end + case when regime_stress > 0.5 and s in ('Brand#7', 'Brand#2', 'Brand#19') and not coalesce(p_down > p_up, false) then 0.05::double else 0 end, 12)", 5, "t_risk", "ready and rp is not null"))(
    lambda s, d: show(H.controller(controller_input(s, d), risk=0.2, down=0.1, role=0.05, k=5)))
query("h10_normalized", f"""
with a as (select *, {pct_sql('p_select')} as u, {pct_sql('p_down')} as d from t_scores where ready and p_select is not null and p_down is not null),
b as (select *, p_down >= 0.5 and (coalesce(regime_stress >= 0.45, false) or p_down >= 0.6) as guard, d - u as adv, row_number() over (partition by pos order by p_select desc, s) as pool from a),
f as (select pos, s, adv, row_number() over (partition by pos order by adv desc, d desc, s) as r from b where pool <= 5 and guard and adv >= 0.05),
w as (select pos, s, u, row_number() over (partition by pos order by u, s) as r from b where pool <= 5),
o as (select pos, s, d, row_number() over (partition by pos order by d desc, s) as r from b where guard and pool > 8),
c as (select w.pos, w.s as victim, f.s as fs, f.adv as fa, o.s as ns, o.d - w.u as oa from w left join f on f.pos = w.pos and f.r = 1 left join o on o.pos = w.pos and o.r = 1 and o.d - w.u >= 0.05 where w.r = 1),
e as (select *, coalesce(oa > coalesce(fa, '-infinity'::double), false) as nw from c),
x as (select b.s, b.pos, case when not nw and b.s = fs then 'Down' else 'Up' end as dir, false as rep, u, d from b join e on e.pos = b.pos where pool <= 8 and not (nw and b.s = victim)
      union all select b.s, b.pos, 'Down', true, u, d from b join e on e.pos = b.pos and e.nw and e.ns = b.s)
select s as series_id, pos as "position", row_number() over (partition by pos order by case when dir = 'Down' then d else u end desc, s) as rank, dir as direction, rep as replacement from x""")(lambda s, d: show(H.normalized(scores(s, d), cap=8, core=5, down_threshold=0.5, stress_trigger=0.45, hard_threshold=0.6), "direction", "replacement"))
query("h11_guarded", f"""
with a as (select a.*, x.p_down_local as risk, x.forecast_breadth as fb, quantile_cont(x.p_down_local, 0.7) over (partition by a.pos) as thr from t_adaptive a join t_scores x on x.s = a.s and x.pos = a.pos),
b as (select *, sum((risk >= thr)::int) over (partition by pos) as nr, coalesce(dir = 'Up' and pu < 0.6, false) as weak from a),
c as (select *, row_number() over (partition by pos, weak order by pu, risk desc, s) as o from b)
select s as series_id, pos as "position", coalesce(weak and o <= least(2, nr) and fb < 0.5, false) as policy_replaced, case when coalesce(weak and o <= least(2, nr) and fb < 0.5, false) then 'Down' else dir end as policy_direction from c""")(
    lambda s, d: guarded_calls(s, d).select("series_id", "position", "policy_replaced", "policy_direction"))


def guarded_calls(s, d):
    x = scores(s, d).select(*BYK, "series_id", F.col("p_down_local").alias("p_extreme_down"), "forecast_breadth")
    return H.guarded(adaptive(s, d).join(x, [*BYK, "series_id"]), breadth_gate=0.5, risk_quantile=0.7, max_replacements=2, ceiling=0.6)


query("h12_schedule_quality", 'select distinct pos as "position", case when forecast_breadth >= 0.48 and regime_stress >= 0.5 then 8 when forecast_breadth >= 0.48 then 6 else 5 end as cap from t_scores')(
    lambda s, d: scores(s, d).select("position", H.schedule_quality("forecast_breadth", "regime_stress", 0.48, 0.5, (5, 6, 8)).alias("cap")).distinct())
query("h13_existing_caps", ranked_sql("p_up", CAP_SQL["binary"]))(lambda s, d: show(H.dynamic_cap(scores(s, d), cap_col("binary"), HI, score="p_up")))


def arms(s, d):
    return scores(s, d).withColumns({"up_cal": F.col("p_select"), "down_cal": F.col("p_down"), "base_direction": F.lit("Up"), "cap": cap_col("graduated")})


_fd = "(p_down >= 0.5 and p_down >= p_select + 0.0::double)"
query("h14_flexible", f"""
with a as (select *, case when {_fd} then 'Down' else 'Up' end as dir, case when {_fd} then p_down else p_select end as cs, {CAP_SQL['graduated']} as cap from t_scores where ready and p_down is not null),
b as (select *, row_number() over (partition by pos, dir order by cs desc, s) as dr from a),
c as (select *, row_number() over (partition by pos order by cs desc, s) as rk from b where dir = 'Up' or dr <= 2)
select s as series_id, pos as "position", rk as rank, dir as direction, case when dir = 'Up' then 'up' when accepted then 'down_overlay' else 'down_external' end as selection_source from c
where rk <= least(8, cap) and (rk <= 5 or cs >= 0.52)""")(
    lambda s, d: show(H.flexible(arms(s, d), floor=0.5, margin=0.0, extra=0.52, optional=True, base=5, hi=8, max_down=2), "direction", "selection_source"))
query("h15_compete", f"""
select s as series_id, pos as "position", rk as rank, case when jd > ju then 'Down' else 'Up' end as direction from (select *, row_number() over (partition by pos order by greatest(ju, jd) desc, s) as rk from (
 select *, {CAP_SQL['graduated']} as cap, round(0.5::double * (p_select + 1 - p_down), 12) as ju, 1 - round(0.5::double * (p_select + 1 - p_down), 12) as jd from t_scores where ready and p_down is not null)) where rk <= cap""")(
    lambda s, d: show(H.compete(G.joint_score(arms(s, d)).withColumn("joint_p_up", F.round("joint_p_up", 12)).withColumn("joint_p_down", 1 - F.col("joint_p_up")), "cap", HI), "direction"))
query("h16_insert_down")(lambda s, d: H.insert_down(arms(s, d), cap="cap", hi=HI, margin=0.0, floor=0.5, max_down=3).select("series_id", "position", "direction", "source", "victim_id", "call_correct"))
query("h17_designs", """
with p as (select *, row_number() over (partition by pos order by p_select desc, s) as pool from t_scores where ready),
o as (select *, row_number() over (partition by pos order by p_down desc, s) as k from p where pool > 6 and p_down >= 0.52),
n as (select p.pos, least(count(o.s), 6) as n from (select distinct pos from p) p left join o on o.pos = p.pos group by 1),
u as (select *, row_number() over (partition by pos order by greatest(p_down, p_up) desc, s) as place from p)
select pos as "position", s as series_id, y as y_true, 'Up' as direction, 'A' as design from p where pool <= 6
union all select p.pos, s, y, 'Up', 'B' from p join n on n.pos = p.pos where pool <= 6 - least(2, n) union all select pos, s, y, 'Down', 'B' from o where k <= 2
union all select p.pos, s, y, 'Up', 'C' from p join n on n.pos = p.pos where pool <= 6 - least(3, n) union all select pos, s, y, 'Down', 'C' from o where k <= 3
union all select pos, s, y, case when p_down > p_up then 'Down' else 'Up' end, 'D' from u where place <= 6""")(lambda s, d: H.designs(scores(s, d), H.top_k(scores(s, d), "p_select", 6), cap=6, threshold=0.52, insert_cap=2).drop("panel_id"))
query("h18_matched", """
select s as series_id, x.pos as "position", rk as rank, case when p_up >= 0.5 then 'Up' else 'Down' end as direction from (
 select *, row_number() over (partition by pos order by abs(p_up - 0.5) desc, s) as rk from t_scores where ready and y is not null) x
join (select pos, count(*) as k from t_adaptive group by 1) k on k.pos = x.pos where rk <= k""")(
    lambda s, d: show(H.matched(scores(s, d), adaptive(s, d), hi=HI + 2, p="p_up"), "direction"))
cte("t_rate36", "select *, round(prior0, 9) as prior36 from (select s, pos, y, case when count(y) over w >= 20 then avg(y) over w end as prior0 from t_brand_y window w as (partition by s order by pos range between 37 preceding and 2 preceding))")
for _m in ("up", "majority"):
    _sc = "prior0" if _m == "up" else "greatest(prior0, 1 - prior0)"
    query(f"h19_prior_only_{_m}", ranked_sql(_sc, 5, "t_rate36", "prior0 is not null and y is not null", ", case when prior0 >= 0.5 then 'Up' else 'Down' end as direction" if _m != "up" else ", 'Up' as direction"))(
        lambda s, d, m=_m: show(H.prior_only(target_table(s, d), n=36, k=5, mode=m, min_labels=20), "direction"))
query("h20_candidate_scores", " union all ".join(f"select '{n}' as candidate, series_id, \"position\", rank from ({ranked_sql(c, 5, where=f'ready and {c} is not null')})" for n, c in (("overlay", "p_select"), ("prior", "prior"), ("raw", "p_up_raw"))))(
    lambda s, d: show(H.candidate_scores(scores(s, d), {"overlay": "p_select", "prior": "prior", "raw": "p_up_raw"}, 5, hi=5), "candidate"))
query("h21_oracles", f"""
with u as (select x.*, w."window" from t_scores x join t_win w on pos between lo and hi where ready and y is not null),
c as (select * from t_adaptive where y is not null), k as (select pos, count(*)::int as cap, sum((case when dir = 'Up' then y else 1 - y end)) as production, sum(y) as up, sum(1 - y) as dn from c group by 1),
lr as (select s, avg(y) as lr from t_brand_y group by 1), lw as (select "window", s, avg(y) as lw from t_brand_y join t_win on pos between lo and hi group by 1, 2),
j as (select u.*, lr.lr, lw.lw, k.cap, k.production, k.up, k.dn, row_number() over (partition by u.pos order by lr.lr desc, u.s) as r1, row_number() over (partition by u.pos order by lw.lw desc, u.s) as r2
 from u join lr on lr.s = u.s join lw on lw.s = u.s and lw."window" = u."window" join k on k.pos = u.pos)
select pos as "position", "window", max(cap) as cap, {q6('avg(y)')} as breadth, avg(y) < 0.5 as broad_down, max(production) as production, sum(case when r1 <= cap then y else 0 end) as longrun_drift,
 sum(case when r2 <= cap then y else 0 end) as window_drift, case when avg(y) < 0.5 then max(dn) else max(up) end as breadth_timing,
 case when avg(y) < 0.5 then sum(case when r1 <= cap then 1 - y else 0 end) else sum(case when r1 <= cap then y else 0 end) end as longrun_plus_timing, least(max(cap)::double, sum(y)) as perfect_up
from j group by 1, 2""")(
    lambda s, d: out(H.oracles(scores(s, d).where("ready and y_true is not null"), adaptive(s, d).where("y_true is not null"), target_table(s, d), WINDOWS, hi=HI + 2), ["breadth"]).drop("panel_id"))

cte("t_months", """
select pos, sum(accepted::int) as calls, sum((accepted and y = 1)::int) as hits, sum((accepted and y = 0)::int) as flipped_hits, coalesce(avg(case when accepted then y end) < 0.5, false)::int as flip_target,
 coalesce(avg(y) < 0.5, false)::int as universe_broad_down, max(regime_stress) as stress from t_scores where ready group by pos""")
query("b16_month_outcomes", 'select pos as "position", calls, hits, flipped_hits, flip_target, universe_broad_down from t_months')(
    lambda s, d: T.month_outcomes(scores(s, d).where("ready")).drop("panel_id"))
query("b17_band_target", f'select pos as "position", {q6("avg(case when base_up_rank between 6 and 8 then y end)")} as quality_6_8 from t_scores group by pos')(
    lambda s, d: out(T.band_target(scores(s, d), 6, 8), ["quality_6_8"]).drop("panel_id"))


def months(s, d):
    x = scores(s, d)
    return T.month_outcomes(x.where("ready")).join(x.groupBy(*BYK).agg(F.max("regime_stress").alias("stress")), BYK)


query("h22_flip", """
select pos as "position", coalesce(stress >= thr, false) as flip, case when coalesce(stress >= thr, false) then flipped_hits - hits else 0 end as gain from (
 select *, case when count(stress) over w >= 12 then quantile_cont(stress, 0.75) over w end as thr from t_months window w as (order by pos rows between unbounded preceding and 1 preceding))""")(
    lambda s, d: H.flip(months(s, d), "stress", 0.25, min_n=12).select("position", "flip", "gain"))
query("h23_swap", """
with w as (select pos, s, y, p_up, row_number() over (partition by pos order by p_up, s) as r from t_scores where accepted), o as (select pos, s, y, p_down, row_number() over (partition by pos order by p_down desc, s) as r from t_scores where ready and not accepted)
select w.pos as "position", w.s as victim_id, o.s as outsider_id, 1 - o.y - w.y as hit_delta from w join o on o.pos = w.pos and o.r = 1 and w.r = 1 where p_down >= 0.5 and p_down >= p_up""")(
    lambda s, d: H.swap(scores(s, d), scores(s, d).where("accepted"), floor=0.5).drop("panel_id"))
query("h24_forecast_horizons", " union all ".join(f"""
select {h} as horizon, s as series_id, pos as "position", rk as rank, pos - {h + 1} as fit_through, cast(mo + interval {h} month as date) as forecast_month from (
 select *, row_number() over (partition by pos order by prior desc, s) as rk from (select s, pos, mo, case when count(y) over w >= 12 then avg(y) over w end as prior from (
  select s, pos, mo, case when a is null or b is null then null when b > a then 1.0::double else 0.0::double end as y from (select s, pos, mo, lead(v, {h - 1}) over (partition by s order by pos) as a, lead(v, {h}) over (partition by s order by pos) as b from t_brand))
  window w as (partition by s order by pos range between {24 + h} preceding and {h + 1} preceding)) where prior is not null) where rk <= 5""" for h in (1, 2, 3)))(
    lambda s, d: H.forecast_horizons(brand_table(s, d), (1, 2, 3)).select("horizon", "series_id", "position", "rank", "fit_through", "forecast_month"))
