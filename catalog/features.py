"""Per-series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import features as X
from walksieve.operators import priors as G
from walksieve.operators import targets as T

from .base import brand, out, part, q6, supplier
from .registry import cte, query

KEY = 'select s as series_id, pos as "position"'
W = "window w as (partition by s order by pos)"


def pick(df, cols, places=6, raw=()):
    return out(df, cols, places).select("series_id", "position", *cols, *raw)


def cols_sql(d, places=6):
    return ", ".join(f"{q6(e, places)} as {n}" for n, e in d.items())


def L(k):
    return f"lag(v, {k + 1}) over w"


def D(k):
    return f"({L(k)} - {L(k + 1)})"


def M(k, start=0):
    return f"({L(start)} / nullif({L(start + k)}, 0) - 1)"


def updown(e):
    return f"case when {e} > 0 then 1.0::double when {e} <= 0 then 0.0::double end"


def R(agg, x, k, m, lag=0, part="s"):
    """Framed aggregate with a minimum count."""
    fr = f"over (partition by {part} order by pos rows between {k - 1 + lag} preceding and {lag} {'preceding' if lag else 'preceding'})"
    fr = fr.replace("and 0 preceding", "and current row")
    return f"case when count({x}) {fr} >= {m} then {agg.replace('$', x)} {fr} end"


query("c01_level_diff_pct", f"""{KEY}, {cols_sql({'level': L(0), 'diff_1': D(0)}, 2)}, {q6(f'{D(0)} / nullif({L(1)}, 0)')} as pct_change_1,
{updown(D(0))} as direction_1 from t_supplier {W}""")(
    lambda s, d: out(out(X.lag_features(supplier(s, d)), ["level", "diff_1"], 2), ["pct_change_1"]).select("series_id", "position", *X.LEVEL))

query("c02_direction_lags", f"{KEY}, " + ", ".join(f"{updown(D(k))} as direction_lag_{k}" for k in X.DIRECTION_LAGS) + f" from t_part {W}")(
    lambda s, d: X.lag_features(part(s, d)).select("series_id", "position", *X.DIRECTION))

query("c03_change_lags", f"{KEY}, " + cols_sql({f"change_lag_{k}": D(k) for k in X.DIRECTION_LAGS}, 2) + f" from t_supplier {W}")(
    lambda s, d: pick(X.lag_features(supplier(s, d)), X.CHANGE, 2))

query("c04_momentum", f"{KEY}, " + cols_sql({f"momentum_{k}": M(k) for k in X.MOMENTUM_SPANS} | {"momentum_acceleration_3": f"{M(3)} - {M(3, 3)}"}) + f" from t_supplier {W}")(
    lambda s, d: pick(X.momentum(supplier(s, d)), [*X.MOMENTUM, "momentum_acceleration_3"]))

cte("t_roll_supplier", f"""
select s, pos, lag(v) over w as src, {R('avg($)', 'v', 12, 6, 1)} as mean, {R('stddev_samp($)', 'v', 12, 6, 1)} as sd,
       {R('mad($)', 'v', 12, 6, 1)} as mad, {R('avg($)', 'v', 6, 3, 1)} as mean6 from t_supplier {W}""")

query("c05_rolling_mean_std", f"{KEY}, {q6('mean', 6)} as rolling_mean_12, {q6('sd', 4)} as rolling_std_12 from t_roll_supplier")(
    lambda s, d: out(pick(X.rolling_level(supplier(s, d)), ["rolling_mean_12"], raw=["rolling_std_12"]), ["rolling_std_12"], 4))
query("c06_rolling_mad", f"{KEY}, {q6('mad', 3)} as rolling_mad_12 from t_roll_supplier")(
    lambda s, d: pick(X.rolling_level(supplier(s, d)), ["rolling_mad_12"], 3))
query("c07_robust_z", f"{KEY}, {q6('(src - mean) / nullif(1.4826 * mad, 0)')} as robust_z_12 from t_roll_supplier")(
    lambda s, d: pick(X.rolling_level(supplier(s, d)), ["robust_z_12"]))
query("c08_distance_mean", f"{KEY}, {q6('src / nullif(mean6, 0) - 1')} as distance_mean_6, {q6('src / nullif(mean, 0) - 1')} as distance_mean_12 from t_roll_supplier")(
    lambda s, d: pick(X.rolling_level(supplier(s, d)), ["distance_mean_6", "distance_mean_12"]))

query("c09_stale_run", f"""
select s as series_id, pos as "position", case when src is not null then (row_number() over (partition by s, g order by pos) - 1)::double end as stale_run
from (select *, sum(coalesce(src <> p, false)::int) over (partition by s order by pos) as g
      from (select s, pos, lag(v) over w as src, lag(v, 2) over w as p from t_part {W}))""")(
    lambda s, d: X.stale_run(part(s, d)).select("series_id", "position", "stale_run"))

query("c10_since_observed", f"""
select s as series_id, pos as "position", (src is not null)::int::double as observed, (row_number() over (partition by s, g order by pos) - 1)::double as time_since_observation
from (select *, sum((src is not null)::int) over (partition by s order by pos) as g from (select s, pos, lag(v) over w as src from t_part {W}))""")(
    lambda s, d: X.since_observed(part(s, d)).select("series_id", "position", "observed", "time_since_observation"))

query("c11_signed_run", f"""
select s as series_id, pos as "position", 0.0::double + sg * row_number() over (partition by s, g order by pos) as signed_run_length
from (select *, sum((sg is distinct from pg)::int) over (partition by s order by pos) as g
      from (select s, pos, sg, lag(sg) over w as pg from (select s, pos, sign({D(0)})::double as sg from t_part {W}) {W}))""")(
    lambda s, d: X.signed_run(part(s, d)).select("series_id", "position", (F.col("signed_run_length") + F.lit(0.0)).alias("signed_run_length")))

cte("t_ret_supplier", f"""
select s, pos, mo, v, lag(v) over w as src, {M(1)} as r, {M(1, 1)} as r1, {M(1, 2)} as r2, {M(3)} as m3, {M(6)} as m6, {M(12)} as m12, {M(6, 2)} as rise, {M(2)} as stall
from t_supplier {W}""")

_VOL = R("stddev_samp($)", "r", 12, 6)
query("c13_risk_momentum", f"""
select s as series_id, pos as "position", {q6('vol')} as return_volatility_12, {q6('m3 / nullif(vol * sqrt(3.0), 0)')} as risk_normalized_momentum_3,
{q6('m6 / nullif(vol * sqrt(6.0), 0)')} as risk_normalized_momentum_6 from (select *, {_VOL} as vol from t_ret_supplier)""")(
    lambda s, d: pick(X.risk_momentum(supplier(s, d)), X.RISK))

_NEG = "case when r < 0 then 1.0::double when r >= 0 then 0.0::double end"
query("c14_downside_features", f"""
{KEY}, {cols_sql({
    'return_1': 'r', 'return_lag_1': 'r1', 'return_lag_2': 'r2', 'momentum_3': 'm3', 'momentum_6': 'm6', 'momentum_12': 'm12',
    'volatility_3': R('stddev_samp($)', 'r', 3, 2), 'volatility_6': R('stddev_samp($)', 'r', 6, 3), 'volatility_12': _VOL,
    'drawdown_12': f"src / nullif({R('max($)', 'src', 12, 6)}, 0) - 1", 'distance_mean_12': f"src / nullif({R('avg($)', 'src', 12, 6)}, 0) - 1",
    'negative_share_3': R('avg($)', _NEG, 3, 2)})} from t_ret_supplier""")(
    lambda s, d: pick(X.downside_features(supplier(s, d)), X.DOWNSIDE))


def reversal_sql(src):
    return f"""
select *, rise_score - stall_score as ex_score, coalesce(rise > 0 and rise_score >= 0.5 and stall_score <= 0.5, false)::int::double as ex_flag
from (select *, rise / nullif(v24 * sqrt(6.0), 0) as rise_score, abs(stall) / nullif(v24 * sqrt(2.0), 0) as stall_score
      from (select *, {R('stddev_samp($)', 'r', 3, 2)} as v3, {_VOL} as v12, {R('stddev_samp($)', 'r', 24, 12)} as v24, {R('avg($)', 'r', 2, 2)} as two,
                   {R('avg($)', 'r', 4, 3, 2)} as four, {R('max($)', 'src', 12, 6)} as high from {src}))"""


cte("t_rev_supplier", reversal_sql("t_ret_supplier"))
query("c15_reversal_features", f"""
{KEY}, {cols_sql({'rise_6_before_2': 'rise', 'stall_2': 'stall', 'rise_score': 'rise_score', 'stall_score': 'stall_score', 'exhaustion_score': 'ex_score',
                  'deceleration_2_vs_4': 'four - two', 'volatility_compression': 'v3 / nullif(v12, 0)'})},
ex_flag as exhaustion_flag, coalesce(src >= 0.98::double * high, false)::int::double as near_high_12 from t_rev_supplier""")(
    lambda s, d: pick(X.reversal_features(supplier(s, d)), X.REVERSAL))

_z = lambda x: f"({x} - {R('avg($)', x, 60, 24, 1)}) / nullif({R('stddev_samp($)', x, 60, 24, 1)}, 0)"
query("c16_trailing_z", f"""{KEY}, {q6(_z('d1'))} as ret1_z, {q6(_z('d3'))} as mom3_z
from (select s, pos, {D(0)} as d1, {L(0)} - {L(3)} as d3 from t_supplier {W})""")(
    lambda s, d: pick(X.trailing_z(supplier(s, d)), ["ret1_z", "mom3_z"]))

_dn = lambda k: f"case when {D(k)} <= 0 then 1.0::double when {D(k)} > 0 then 0.0::double end"
query("c17_consecutive_down", f"""{KEY}, a + a * b + a * b * c as consec_down from (select s, pos, {_dn(0)} as a, {_dn(1)} as b, {_dn(2)} as c from t_part {W})""")(
    lambda s, d: X.consecutive_down(part(s, d)).select("series_id", "position", "consec_down"))

query("c18_previous_shock", f"""{KEY}, case when d is not null and q is not null then (d < 0 and d <= q)::int::double end as prev_shock
from (select *, {R('quantile_cont($, 0.2)', 'd', 36, 18, 1)} as q from (select s, pos, {D(0)} as d from t_supplier {W}))""")(
    lambda s, d: X.previous_shock(supplier(s, d), k=36, m=18, q=0.2).select("series_id", "position", "prev_shock"))

query("c19_relative_scale", f"""{KEY}, {cols_sql({'relative_volatility_12': 'nullif(sd, 0) / nullif(abs(mean), 0)', 'diff_z_12': 'd / nullif(sd, 0)', 'momentum_acceleration_3_12': 'acc'})}
from (select s, pos, {R('avg($)', 'v', 12, 6, 1)} as mean, {R('stddev_samp($)', 'v', 12, 6, 1)} as sd, {D(0)} as d, {M(3)} - {M(12)} as acc from t_supplier {W})""")(
    lambda s, d: pick(X.relative_scale(supplier(s, d)), ["relative_volatility_12", "diff_z_12", "momentum_acceleration_3_12"]))


def shock_sql(panel):
    return f"""select s, pos, c / nullif({R('stddev_samp($)', 'c', 36, 24, 1)}, 0) as z
from (select s, pos, ln(case when {L(0)} > 0 then {L(0)} end) - ln(case when {L(1)} > 0 then {L(1)} end) as c from {panel} {W})"""


cte("t_z_brand", shock_sql("t_brand"))
cte("t_z_supplier", shock_sql("t_supplier"))
query("c20_log_shock", f"{KEY}, {q6('z')} as log_shock, {q6('abs(z)')} as abs_log_shock from t_z_supplier")(
    lambda s, d: pick(X.log_shock(supplier(s, d)), ["log_shock", "abs_log_shock"]))

_ge = lambda a, b: f"case when {a} > {b} then 1.0::double when {a} <= {b} then 0.0::double end"
query("c21_ma_flags", f"""{KEY}, {_ge('src', 'ma')} as above_ma_10, {_ge('src', 'old')} as above_12_ago
from (select s, pos, {L(0)} as src, {L(12)} as old, {R('avg($)', 'v', 10, 10, 1)} as ma from t_supplier {W})""")(
    lambda s, d: X.ma_flags(supplier(s, d)).select("series_id", "position", "above_ma_10", "above_12_ago"))

_num = lambda c: f"coalesce({c}, false)::int::double"
query("c22_breakdown", f"""
{KEY}, {cols_sql({'dist_high_3': 'src / nullif(h3, 0)', 'dist_high_6': 'src / nullif(h6, 0)', 'dist_high_12': 'src / nullif(h12, 0)',
 'return_after_high_6': 'src / nullif(h6, 0) - 1', 'negative_acceleration': 'm3 - m6', 'reversal_after_strength': f"m3 * {_num('m12 > 0')}",
 'z_1': 'z', 'z_3': R('avg($)', 'z', 3, 2), 'neg_z_share_3': R('avg($)', 'case when z < 0 then 1.0::double when z >= 0 then 0.0::double end', 3, 2)})},
{_num('src < a3')} as below_mean_3, {_num('src < a6')} as below_mean_6, {_num('h3 < h6')} as lower_high, {_num('m3 < 0 and m6 > 0')} as momentum_turn_neg,
{_num('r > 0 and src / nullif(h6, 0) < 1')} as failed_recovery
from (select *, r / nullif({_VOL}, 0) as z, {R('max($)', 'src', 3, 2)} as h3, {R('max($)', 'src', 6, 3)} as h6, {R('max($)', 'src', 12, 6)} as h12,
 {R('avg($)', 'src', 3, 2)} as a3, {R('avg($)', 'src', 6, 3)} as a6 from t_ret_supplier)""")(
    lambda s, d: pick(X.breakdown_features(supplier(s, d)), X.BREAKDOWN))

_pos = "case when r > 0 then 1.0::double when r <= 0 then 0.0::double end"
query("c23_strength", f"""
{KEY}, {cols_sql({'pos_share_3': R('avg($)', _pos, 3, 1), 'pos_share_6': R('avg($)', _pos, 6, 3), 'strength_momentum_3': 'm3', 'strength_momentum_6': 'm6',
 'vol_adj_momentum_3': f'm3 / nullif({_VOL}, 0)', 'trend_slope_3': R('avg($)', 'r', 3, 2), 'trend_consistency_6': f"m6 * {_num('m3 > 0')}"})} from t_ret_supplier""")(
    lambda s, d: pick(X.strength_features(supplier(s, d)), X.STRENGTH))

query("c24_context", f"""
with d as (select s, pos, v - lag(v) over w as d from t_part {W}),
k as (select s, pos, list(d) over w as ds, stddev_pop(d) over w as sd, avg((d > 0)::int) over w as up from d where d is not null
      window w as (partition by s order by pos rows between 35 preceding and current row)),
n as (select p.s, p.pos, max(k.pos) as last from t_part p left join k on k.s = p.s and k.pos < p.pos group by 1, 2)
select n.s as series_id, n.pos as "position", array_to_string(list_transform(ds, lambda x: case when x > 0 then 'U' when x < 0 then 'D' else '=' end), '') as directions,
       round(up, 3) as share_rising, len(ds)::integer as n from n left join k on k.s = n.s and k.pos = n.last""")(
    lambda s, d: X.context(part(s, d)).select("series_id", "position", "directions", "share_rising",
                                              F.size("standardised_changes").alias("n")).withColumn(
        "n", F.when(F.col("n") >= 0, F.col("n"))))

cte("t_breadth_supplier", f"""
select pos, avg(case when d > 0 then 1.0::double when d <= 0 then 0.0::double end) as b from (select pos, v - lag(v) over w as d from t_supplier {W}) group by pos""")


@query("c25_market_context", f"""
select p.pos as "position", cast(list(round(k.b, 3) order by k.pos) filter (k.b is not null) as varchar) as monthly_share_rising
from t_breadth_supplier p left join t_breadth_supplier k on k.pos < p.pos and k.pos >= p.pos - 36 and k.b is not null group by 1""")
def market_context(spark, d):
    p = supplier(spark, d).withColumn("_d", F.col("value") - F.lag("value").over(X.series_window()))
    m = p.groupBy("panel_id", "position").agg(F.avg(X.flag(F.col("_d") > 0)).alias("breadth_raw"))
    a = F.col("monthly_share_rising")
    return X.market_context(m).select("position", F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ", "), F.lit("]")).alias("monthly_share_rising"))


query("c26_diff_context", f"""
with f as (select s, min(pos) filter (v is not null) as lo from t_supplier group by 1),
d as (select p.s, p.pos, p.v - lag(p.v) over (partition by p.s order by p.pos) as d from t_supplier p join f on f.s = p.s where p.pos >= f.lo)
select p.s as series_id, p.pos as "position", count(d.pos)::integer as n, {q6('sum(d.d)', 2)} as total, count(d.d)::integer as known
from t_supplier p left join (select d.* from d join f on f.s = d.s where d.pos > f.lo) d on d.s = p.s and d.pos < p.pos group by 1, 2""")(
    lambda s, d: X.diff_context(supplier(s, d)).select(
        "series_id", "position", F.coalesce(F.size("context"), F.lit(0)).alias("n"),
        F.aggregate("context", F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("k")),
                    lambda a, x: F.struct((a["t"] + F.coalesce(x, F.lit(0.0))).alias("t"), (a["k"] + F.when(x.isNotNull(), 1).otherwise(0)).alias("k"))).alias("z"),
    ).select("series_id", "position", F.when(F.col("n") > 0, F.col("n")).otherwise(0).alias("n"),
             F.when(F.col("z.k") > 0, rnd("z.t", 2)).alias("total"), F.coalesce("z.k", F.lit(0)).alias("known")))

query("c27_calendar_encoding", f"""
select distinct pos as "position", {q6('sin(2 * pi() * month(mo) / 12)')} as month_sin, {q6('cos(2 * pi() * month(mo) / 12)')} as month_cos, pos / 100.0::double as time_index from t_supplier""")(
    lambda s, d: out(X.calendar_enc(supplier(s, d)), ["month_sin", "month_cos"]).select("position", "month_sin", "month_cos", "time_index").distinct())

query("c28_causal_percentile", f"""
select p.pos as "position", {q6('case when p.b is null or count(k.b) < 12 then 0.5::double else avg((k.b <= p.b)::int) end')} as breadth_pct
from t_breadth_supplier p left join t_breadth_supplier k on k.pos < p.pos and k.b is not null group by p.pos, p.b""")(
    lambda s, d: out(X.causal_percentile(_breadth(s, d), "breadth"), ["breadth_pct"]).select("position", "breadth_pct"))

query("c29_expanding_threshold", f"""
select p.pos as "position", case when count(k.b) >= 24 then {q6('quantile_cont(k.b, 0.8)')} end as threshold
from t_breadth_supplier p left join t_breadth_supplier k on k.pos < p.pos group by p.pos""")(
    lambda s, d: out(X.expanding_threshold(_breadth(s, d), "breadth", 0.2), ["threshold"]).select("position", "threshold"))


def _breadth(spark, d):
    p = supplier(spark, d).withColumn("_d", F.col("value") - F.lag("value").over(X.series_window()))
    return p.groupBy("panel_id", "position").agg(F.avg(X.flag(F.col("_d") > 0)).alias("breadth"))


for _n in (24, 36, 48, None):
    _fr = f"{_n + 1} preceding" if _n else "unbounded preceding"
    query(f"c30_calendar_rate_{_n or 'all'}", f"""
{KEY}, case when count(y) over w >= 12 then {q6('avg(y) over w')} end as prior, count(y) over w as prior_rows from t_part_y
window w as (partition by s order by pos range between {_fr} and 2 preceding)""")(
        lambda s, d, n=_n: pick(G.calendar_rate(T.direction_targets(part(s, d)), n=n, min_labels=12), ["prior"], raw=["prior_rows"]))

query("c31_available_rate", f"""
with l as (select s, pos, y, row_number() over (partition by s order by pos) as c from t_part_y where y is not null),
k as (select p.s, p.pos, max(l.c) as c from t_part_y p left join l on l.s = p.s and l.pos <= p.pos - 2 group by 1, 2)
select k.s as series_id, k.pos as "position", case when count(l.y) >= 6 then {q6('avg(l.y)')} end as prior, count(l.y) as prior_rows
from k left join l on l.s = k.s and l.c <= k.c and l.c > k.c - 8 group by 1, 2""")(
    lambda s, d: pick(G.available_rate(T.direction_targets(part(s, d)), n=8, min_labels=6), ["prior"], raw=["prior_rows"]))

query("c32_recent_miss", f"""
select s as series_id, pos + 2 as "position", case when n >= 2 then {q6('m')} end as recent_miss_rate, case when n >= 2 then n::double end as recent_call_count
from (select s, pos, avg(1 - y) over w as m, count(y) over w as n from t_part_y where y is not null window w as (partition by s order by pos rows between 6 preceding and 1 preceding))""")(
    lambda s, d: out(X.recent_miss(T.direction_targets(part(s, d))), ["recent_miss_rate"]).select("series_id", "position", "recent_miss_rate", "recent_call_count"))
