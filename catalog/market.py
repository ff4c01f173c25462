"""Cross-section, market and group features."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import features as X
from walksieve.operators import market as M
from walksieve.operators import targets as T

from .base import GROUP_SQL, brand, groups, out, part, q6, supplier
from .features import D, KEY, L, R, W, cols_sql, reversal_sql
from .features import M as MOM
from .registry import cte, query

MW = "window w as (order by pos)"
_up = lambda e: f"case when {e} > 0 then 1.0::double when {e} <= 0 then 0.0::double end"
cte("t_d_part", f"select s, pos, {D(0)} as d from t_part {W}")
cte("t_xs_part", f"select pos, median(d) as med, stddev_samp(d) as sd, avg({_up('d')}) as b from t_d_part group by pos")
cte("t_rk_part", """select s, pos, d, case when d is not null then (rank() over (partition by pos, d is null order by d)
 + (count(*) over (partition by pos, d) - 1) / 2.0::double) / count(d) over (partition by pos) end as rk from t_d_part""")

query("d01_cross_section", f"""select pos as "position", {q6('med', 3)} as cross_section_median, {q6('sd', 3)} as cross_section_dispersion, {q6('b')} as cross_section_breadth from t_xs_part""")(
    lambda s, d: out(out(M.cross_section(part(s, d)), ["cross_section_median", "cross_section_dispersion"], 3), ["cross_section_breadth"]).drop("panel_id"))

query("d02_pct_rank", f"{KEY}, {q6('rk')} as cross_section_rank from t_rk_part")(
    lambda s, d: out(M.cross_section_rank(part(s, d)), ["cross_section_rank"]).select("series_id", "position", "cross_section_rank"))

query("d03_rank_change", f"{KEY}, {q6('rk - lag(rk) over w')} as cross_section_rank_change_1, {q6('rk - lag(rk, 3) over w')} as cross_section_rank_change_3 from t_rk_part {W}")(
    lambda s, d: out(M.rank_change(M.cross_section_rank(part(s, d))), ["cross_section_rank_change_1", "cross_section_rank_change_3"]).select(
        "series_id", "position", "cross_section_rank_change_1", "cross_section_rank_change_3"))

query("d03_market_change", f"""select pos as "position", {q6('b - lag(b, 3) over w')} as breadth_impulse_3, {q6('sd - lag(sd, 3) over w', 3)} as dispersion_change_3 from t_xs_part {MW}""")(
    lambda s, d: out(out(M.market_change(M.cross_section(part(s, d))), ["breadth_impulse_3"]), ["dispersion_change_3"], 3).select(
        "position", "breadth_impulse_3", "dispersion_change_3"))


def RM(agg, x, k, m, lag=0):
    return R(agg, x, k, m, lag, part="1")


query("d04_structured_regime", f"""select pos as "position", {q6(RM('avg($)', 'b', 3, 2))} as regime_breadth_3, {q6(RM('avg($)', 'sd', 12, 6), 3)} as regime_dispersion_12,
 {q6(RM('stddev_samp($)', 'sd', 12, 6), 3)} as regime_volatility_12 from t_xs_part""")(
    lambda s, d: out(out(M.structured_regime(M.cross_section(part(s, d))), ["regime_breadth_3"]), ["regime_dispersion_12", "regime_volatility_12"], 3).select(
        "position", "regime_breadth_3", "regime_dispersion_12", "regime_volatility_12"))


def market_sql(ret):
    return f"""select *, {RM('stddev_samp($)', 'mr', 6, 3)} as vol6, {RM('avg($)', 'mb', 3, 2)} as mb3, mb - lag(mb, 3) over (order by pos) as mbc
from (select pos, avg(r) as mr, median(r) as md, avg({_up('r')}) as mb, stddev_samp(r) as disp from {ret} group by pos)"""


cte("t_mkt_supplier", market_sql("t_ret_supplier"))
query("d05_market_regime", f"""select pos as "position", {cols_sql({'market_mean_return': 'mr', 'market_median_return': 'md', 'market_breadth': 'mb', 'market_dispersion': 'disp',
 'market_volatility_6': 'vol6', 'market_breadth_3': 'mb3', 'market_breadth_change_3': 'mbc'})}, pos - 1 as observation_through from t_mkt_supplier""")(
    lambda s, d: out(M.market_regime(supplier(s, d)), ["market_mean_return", "market_median_return", "market_breadth", "market_dispersion",
                                                       "market_volatility_6", "market_breadth_3", "market_breadth_change_3"]).drop("panel_id"))

_AGG = ["momentum_3", "momentum_6", "momentum_12", "return_1", "volatility_12", "drawdown_12"]
cte("t_down_supplier", f"""{KEY}, r as return_1, m3 as momentum_3, m6 as momentum_6, m12 as momentum_12, {R('stddev_samp($)', 'r', 12, 6)} as volatility_12,
 src / nullif({R('max($)', 'src', 12, 6)}, 0) - 1 as drawdown_12 from t_ret_supplier""")
query("d06_market_aggregate", 'select "position", ' + cols_sql({f"market_{c}_{n}": f"{f}({c})" for c in _AGG for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"))}) + ' from t_down_supplier group by 1')(
    lambda s, d: out(M.market_aggregate(X.downside_features(supplier(s, d)), _AGG), [f"market_{c}_{n}" for c in _AGG for n in ("mean", "median", "std")]).drop("panel_id"))

_GN = [f"g{i}" for i in range(5)]
cte("t_ret_brand", f"""select s, pos, mo, v, lag(v) over w as src, {MOM(1)} as r, {MOM(1, 1)} as r1, {MOM(1, 2)} as r2, {MOM(3)} as m3, {MOM(6)} as m6, {MOM(12)} as m12,
 {MOM(6, 2)} as rise, {MOM(2)} as stall, {GROUP_SQL} as g from t_brand {W}""")
query("d07_group_aggregate", 'select pos as "position", ' + cols_sql({f"group_{g}_{n}": f"avg(case when g = '{g}' then {c} end)" for g in _GN for n, c in (("momentum_3", "m3"), ("momentum_12", "m12"))}) + " from t_ret_brand group by 1")(
    lambda s, d: (lambda p: out(M.group_aggregate(X.momentum(p), groups(p), ["momentum_3", "momentum_12"], _GN), [f"group_{g}_{c}" for g in _GN for c in ("momentum_3", "momentum_12")]).drop("panel_id"))(brand(s, d)))

_BH = {f"breadth_lag_{k}": f"lag(b, {k}) over w" for k in range(2, 25)}
for _k in M.BREADTH_SPANS:
    _BH[f"breadth_mean_{_k}"] = RM("avg($)", "b", _k, max(2, _k // 2), 2)
    _BH[f"breadth_std_{_k}"] = RM("stddev_samp($)", "b", _k, max(2, _k // 2), 2)
_BH["breadth_change_2_3"] = "lag(b, 2) over w - lag(b, 3) over w"
_BH["breadth_acceleration"] = "lag(b, 2) over w - 2 * lag(b, 3) over w + lag(b, 4) over w"
query("d08_breadth_history", f"""select pos as "position", {cols_sql({'breadth_target': 'b'} | _BH)} from (select pos, avg(y) as b from t_part_y group by 1) {MW}""")(
    lambda s, d: out(M.breadth_history(T.direction_targets(part(s, d))), ["breadth_target", *_BH]).drop("panel_id"))

query("d09_broadcast_returns", 'select pos as "position", ' + cols_sql({f"return_{g}": f"avg(case when g = '{g}' then r end)" for g in _GN}
      | {f"\"return_of_{i}\"": f"max(case when s = '{i}' then r end)" for i in ("Brand#3", "Brand#12")}) + " from t_ret_brand group by 1")(
    lambda s, d: (lambda p: out(M.broadcast_returns(p, groups(p), _GN, ["Brand#3", "Brand#12"]), [f"return_{g}" for g in _GN] + ["return_of_Brand#3", "return_of_Brand#12"]).drop("panel_id"))(brand(s, d)))


def pr(x, part):
    return f"case when {x} is not null then (rank() over (partition by {part}, {x} is null order by {x}) + (count(*) over (partition by {part}, {x}) - 1) / 2.0::double) / count({x}) over (partition by {part}) end"


cte("t_rel_supplier", f"""
with m as (select pos, mr, ml, ml / nullif(lag(ml, 3) over (order by pos), 0) as mm3, ml / nullif(lag(ml, 6) over (order by pos), 0) as mm6, ml / nullif(lag(ml, 12) over (order by pos), 0) as mm12
           from (select pos, avg(r) as mr, avg(src) as ml from t_ret_supplier group by 1))
select t.*, m.mr, m.mm3, m.mm6, m.mm12, {R('avg($)', 'r', 3, 1)} as a3, {R('avg($)', 'r', 6, 3)} as a6, {pr('r', 't.pos')} as rk
from (select * from t_ret_supplier) t join m on m.pos = t.pos""".replace("partition by s order by pos", "partition by s order by t.pos"))
_REL = {"rel_rank": "rk", "rel_return_1": "r - mr", "rel_return_3": "a3 - mr", "rel_return_6": "a6 - mr", "rel_momentum_3": "m3 + 1 - mm3", "rel_momentum_6": "m6 + 1 - mm6",
        "rel_momentum_12": "m12 + 1 - mm12", **{f"rel_rank_change_{k}": f"rk - lag(rk, {k}) over w" for k in (1, 2, 3)},
        "rel_rank_slope": f"rk - {R('avg($)', 'rk', 3, 2)}", "rel_rank_acceleration": "lag(rk, 2) over w - lag(rk, 1) over w", "rel_deterioration": "lag(rk, 3) over w - rk"}
query("d10_relative_features", f"{KEY}, {cols_sql(_REL)} from t_rel_supplier {W}")(
    lambda s, d: out(M.relative_features(supplier(s, d)), list(_REL)).select("series_id", "position", *_REL))

_GR = {"vs_group_return": "r - avg(r) over g", **{f"vs_group_momentum_{k}": f"m{k} - avg(m{k}) over g" for k in (3, 6, 12)}, "rank_in_group": pr("r", "pos, g")}
query("d11_group_relative", f"""select series_id, "position", {cols_sql({c: c for c in _GR})}, {q6('rank_in_group - lag(rank_in_group, 3) over (partition by series_id order by "position")')} as rank_in_group_change_3
from ({KEY}, {', '.join(f'{e} as {c}' for c, e in _GR.items())} from t_ret_brand window g as (partition by pos, g))""")(
    lambda s, d: (lambda p: out(M.group_relative(p, groups(p)), [*_GR, "rank_in_group_change_3"]).select("series_id", "position", *_GR, "rank_in_group_change_3"))(brand(s, d)))

query("d12_breadth_interactions", f"""
{KEY}, {q6('mb')} as peer_pos_consensus, coalesce(r > 0, false)::int::double * coalesce(mb > 0.5, false)::int as breadth_confirm,
{q6('(r - mr) * coalesce(mb > 0.6::double, false)::int')} as weak_in_strong, {q6('(r - mr) * coalesce(mb < 0.4::double, false)::int')} as weak_in_weak
from (select *, avg({_up('r')}) over (partition by pos) as mb, avg(r) over (partition by pos) as mr from t_ret_supplier)""")(
    lambda s, d: out(M.breadth_interactions(supplier(s, d)), ["peer_pos_consensus", "weak_in_strong", "weak_in_weak"]).select(
        "series_id", "position", "peer_pos_consensus", "breadth_confirm", "weak_in_strong", "weak_in_weak"))

query("d17_causal_breadth", f"""select pos as "position", {q6('mb')} as breadth_up, {q6('mb3')} as breadth_mean_3, pos - 1 as observation_through from t_mkt_supplier""")(
    lambda s, d: out(M.market_regime(supplier(s, d)), ["market_breadth", "market_breadth_3"]).select(
        "position", F.col("market_breadth").alias("breadth_up"), F.col("market_breadth_3").alias("breadth_mean_3"), "observation_through"))

_ge = lambda a, b: f"case when {a} > {b} then 1.0::double when {a} <= {b} then 0.0::double end"
cte("t_timing_brand", f"""
with a as (select s, pos, {L(0)} as src, {L(1)} as src1, {L(12)} as old, {R('avg($)', 'v', 10, 10, 1)} as ma, {GROUP_SQL} as g from t_brand {W}),
f as (select a.*, z.z, abs(z.z) as az from a join t_z_brand z on z.s = a.s and z.pos = a.pos),
h as (select *, {R('avg($)', 'az', 3, 3)} - {R('avg($)', 'az', 36, 24)} as vr from f),
m as (select pos, avg({_ge('src', 'ma')}) as ma10_breadth, avg({_ge('src', 'old')}) as mom12_breadth, avg(az) as shock_magnitude, stddev_samp(z) as shock_dispersion,
      avg(case when g in ('g0', 'g1') then z end) - avg(case when g in ('g3', 'g4') then z end) as spread, avg(vr) as vol_regime, sum({_ge('src', 'src1')}) as ys, count({_ge('src', 'src1')}) as yn from h group by pos)
select *, {RM('avg($)', 'spread', 3, 3)} as risk_on_spread, {RM('sum($)', 'ys', 12, 12)} / nullif({RM('sum($)', 'yn', 12, 12)}, 0) as breadth_12 from m""")


def timing(spark, d):
    p = brand(spark, d)
    return M.timing_signals(p, groups(p), on=["g0", "g1"], off=["g3", "g4"])


query("d18_timing_signals", 'select pos as "position", ' + cols_sql({c: c for c in M.SIGNALS}) + " from t_timing_brand")(
    lambda s, d: out(timing(s, d), M.SIGNALS).select("position", *M.SIGNALS))

query("d19_group_stability", f"""
select g as group_id, pos + 2 as "position", case when n >= 2 then {q6('u')} end as group_up_rate, case when n >= 2 then {q6('sd')} end as group_up_std
from (select g, pos, count(u0) over w as n, avg(u0) over w as u, stddev_samp(u0) over w as sd from (select {GROUP_SQL} as g, pos, avg(y) as u0 from t_brand_y where y is not null group by 1, 2)
      window w as (partition by g order by pos rows between 6 preceding and 1 preceding))""")(
    lambda s, d: (lambda p: out(M.group_stability(T.direction_targets(p), groups(p)), ["group_up_rate", "group_up_std"]).drop("panel_id"))(brand(s, d)))
