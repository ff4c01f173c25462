"""One scored panel that selectors, metrics, resampling and audits work on.

The scores are closed formulas of trailing rates and momentum, so DuckDB can
rebuild them exactly; rounding to nine digits makes both engines rank alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import sigmoid
from walksieve.functions.ordering import ordinal_rank
from walksieve.operators import features as X
from walksieve.operators import market as M
from walksieve.operators import priors as G
from walksieve.operators import targets as T

from .base import GROUP_SQL, brand, groups, out, q6
from .features import R, reversal_sql
from .market import market_sql
from .panels import scratch
from .registry import cte
from .targets import SHOCK

K = 5
cte("t_mkt_brand", market_sql("t_ret_brand"))
cte("t_rev_brand", reversal_sql("t_ret_brand"))
_lg = lambda p: f"case when ({p}) is not null then ln(least(0.9999::double, greatest(0.0001::double, {p})) / (1 - least(0.9999::double, greatest(0.0001::double, {p})))) end"
cte("t_rate_brand", """
with l as (select s, pos, y, row_number() over (partition by s order by pos) as c from t_brand_y where y is not null),
k as (select p.s, p.pos, max(l.c) as c from t_brand_y p left join l on l.s = p.s and l.pos <= p.pos - 2 group by 1, 2)
select k.s, k.pos, case when count(l.y) >= 12 then avg(l.y) end as prior, count(l.y) as prior_rows
from k left join l on l.s = k.s and l.c <= k.c and l.c > k.c - 24 group by 1, 2""")
cte("t_group_brand", f"""
with d as (select pos, {GROUP_SQL} as g, sum(y) as s, count(y) as n from t_brand_y group by 1, 2),
w as (select pos, g, sum(s) over a as gs, sum(n) over a as gn from d window a as (partition by g order by pos range between 13 preceding and 2 preceding)),
m as (select pos, sum(s) over b as ms, sum(n) over b as mn from (select pos, sum(s) as s, sum(n) as n from d group by 1) window b as (order by pos range between 13 preceding and 2 preceding)),
j as (select w.pos, w.g, gs, gn, ms / nullif(mn, 0) as mp from w join m on m.pos = w.pos)
select pos, g, gs, gn, coalesce(gs / nullif(gn, 0), mp) as gp, mp from j""")
cte("t_base_brand", f"""
select *, 1 - prior as p_down_prior from (
select t.s, t.pos, t.g, y.y, y.v is not null as obs, a.prior, a.prior_rows, t.r, t.m3, t.ex_flag, {R('avg($)', 'case when t.r < 0 then 1.0::double when t.r >= 0 then 0.0::double end', 3, 2).replace('partition by s order by pos', 'partition by t.s order by t.pos')} as neg3,
 round(1 / (1 + exp(2 * (t.src / nullif(c.mean, 0) - 1))), 9) as p_up_raw, round(1 / (1 + exp(-(1.5::double * (t.src / nullif(c.mean, 0) - 1) + t.m3))), 9) as p_down_global,
 round(1 / (1 + exp(-2 * t.r)), 9) as p_down_local, {_lg('q.gp')} - {_lg('q.mp')} as rel
from t_rev_brand t join t_brand_y y on y.s = t.s and y.pos = t.pos join t_rate_brand a on a.s = t.s and a.pos = t.pos
join (select s, pos, {R('avg($)', 'v', 12, 6, 1)} as mean from t_brand) c on c.s = t.s and c.pos = t.pos
left join t_group_brand q on q.pos = t.pos and q.g = t.g)""")
cte("t_pat_brand", """
select *, coalesce(case when ex_flag = 1 and pn >= 2 then (ph + 2) / (pn + 4.0::double) end, p_down_prior) as p_down_pattern
from (select *, count(case when ex_flag = 1 and y is not null then 1 - y end) over w as pn, sum(case when ex_flag = 1 and y is not null then 1 - y end) over w as ph
 from t_base_brand window w as (partition by s order by pos range between unbounded preceding and 2 preceding))""")
cte("t_score_brand", f"""
select b.*, round(0.5::double * prior + 0.5::double * coalesce(p_up_raw, prior), 10) as p_up,
 round(1 / (1 + exp(-({_lg('0.5::double * prior + 0.5::double * coalesce(p_up_raw, prior)')} + 0.25::double * coalesce(rel, 0)))), 11) as p_select,
 round((p_down_global + p_down_local + p_down_pattern + p_down_prior) / 4, 11) as p_down, prior is not null and p_up_raw is not null as ready,
 round(0.35::double * 0.5 + 0.65::double * coalesce(p_up_raw, 0.5), 9) as p_graph, k.ps, k.pss
from t_pat_brand b left join t_known_brand k on k.s = b.s and k.pos = b.pos""")
cte("t_ranked_brand", f"""
select t.*, x.rk as base_up_rank, coalesce(x.rk <= {K}, false) as accepted from t_score_brand t
left join (select s, pos, row_number() over (partition by pos order by p_select desc, s) as rk from t_score_brand where ready) x on x.s = t.s and x.pos = t.pos""")
_peer = {"peer_breadth_up": ("r", "r > 0"), "peer_negative_share": ("r", "r < 0"), "peer_weak_momentum_share": ("m3", "m3 < 0"),
         "peer_exhaustion_share": ("ex_flag", "ex_flag = 1"), "peer_lead_negative_share": ("neg3", "neg3 >= 0.5")}
cte("t_peer_brand", "select pos, count(*) as peer_count, count(r) as peer_available, avg(r) as peer_mean_return, median(r) as peer_median_return, stddev_samp(r) as peer_dispersion, avg(m3) as peer_mean_momentum_3, "
    + ", ".join(f"case when count({c}) > 0 then avg(coalesce({e}, false)::int) end as {n}" for n, (c, e) in _peer.items()) + " from t_ranked_brand where not accepted group by pos")
cte("t_m0_brand", """
select m.pos, mr as market_mean_return, mb as market_breadth, mb3 as market_breadth_3, mbc as market_breadth_change_3, disp as market_dispersion,
 p.* exclude (pos), k.pss as previous_shock_share from t_mkt_brand m left join t_peer_brand p on p.pos = m.pos left join (select pos, max(pss) as pss from t_known_brand group by 1) k on k.pos = m.pos""")
_pct = {}
for _c in M.STRESS_LOW + M.STRESS_HIGH:
    _e = f"case when {_c} is null or count({_c}) over w < 12 then 0.5::double else len(list_filter(list({_c}) over w, lambda x: x <= {_c}))::double / count({_c}) over w end"
    _e = f"case when {_c} is null or n_{_c} < 12 then 0.5::double else len(list_filter(h_{_c}, lambda x: x <= {_c}))::double / n_{_c} end"
    _pct[_c] = f"1 - ({_e})" if _c in M.STRESS_LOW else _e
cte("t_m1_brand", "select pos, " + ", ".join(f"{e} as {c}_stress" for c, e in _pct.items()) + " from (select *, "
    + ", ".join(f"list({c}) filter ({c} is not null) over w as h_{c}, count({c}) over w as n_{c}" for c in _pct)
    + " from t_m0_brand window w as (order by pos rows between unbounded preceding and 1 preceding))")
cte("t_stress_brand", "select *, (0.45::double * market_stress + 0.35::double * peer_stress + 0.20::double * shock_stress) / (0.45::double + 0.35::double + 0.20::double) as regime_stress from (select *, "
    + ", ".join("(" + " + ".join(f"{c}_stress" for c in cols) + f") / {len(cols)} as {n}" for n, cols in M.STRESS_PARTS.items()) + " from t_m1_brand)")
cte("t_fb_brand", """
select pos, case when count(b) over w >= 6 then avg(b) over w end as fb from (select pos, avg(y) as b from t_brand_y group by 1) window w as (order by pos rows between 13 preceding and 2 preceding)""")
cte("t_scores", """
select r.*, round(t.regime_stress, 9) as regime_stress, case when t.regime_stress < 0.35 then 'calm' when t.regime_stress > 0.65 then 'stressed' else 'mixed' end as regime_label,
 round(f.fb, 9) as forecast_breadth, 'Up' as direction from t_ranked_brand r join t_stress_brand t on t.pos = r.pos join t_fb_brand f on f.pos = r.pos""")

_CACHE = {}
BYK = ["panel_id", "position"]


def base_scores(spark, d):
    p, g, t = brand_table(spark, d), group_table(spark, d), target_table(spark, d)
    f = X.reversal_features(X.downside_features(p)).select(
        *BYK, "series_id", "return_1", "momentum_3", "negative_share_3", "exhaustion_flag", "distance_mean_12")
    s = G.available_rate(t, n=24, min_labels=12).join(f, [*BYK, "series_id"]).join(g, "series_id")
    s = s.withColumn("p_down_prior", 1 - F.col("prior"))
    r9 = lambda c: F.round(c, 9)
    s = s.withColumns({
        "p_up_raw": r9(sigmoid(-2 * F.col("distance_mean_12"))),
        "p_down_global": r9(sigmoid(1.5 * F.col("distance_mean_12") + F.col("momentum_3"))),
        "p_down_local": r9(sigmoid(2 * F.col("return_1"))),
    })
    s = G.pattern_prior(s, min_rows=2)
    s = s.join(G.group_strength(t, g).select(*BYK, "group_id", "group_prior", "market_prior", "group_relative_logit"), [*BYK, "group_id"], "left")
    s = G.prior_blend(s)
    s = G.logit_add(s, p="p_up", signal="group_relative_logit", w=0.25, out="p_select")
    k = T.known_outcome(T.sudden_drops(t, **SHOCK))
    s = s.join(k, [*BYK, "series_id"], "left")
    s = s.withColumns({
        "p_select": F.round("p_select", 11), "p_up": F.round("p_up", 10),  # half of a nine-digit number has ten
        "p_down": F.round((F.col("p_down_global") + F.col("p_down_local") + F.col("p_down_pattern") + F.col("p_down_prior")) / 4, 11),
        "p_graph": r9(0.35 * 0.5 + 0.65 * F.coalesce("p_up_raw", F.lit(0.5))),
        "ready": F.col("prior").isNotNull() & F.col("p_up_raw").isNotNull(),
    })
    unranked = s
    s = memo("unranked", spark, d, lambda: unranked)
    rk = ordinal_rank(s.where("ready").select(*BYK, "series_id", "p_select"), BYK, "p_select", "base_up_rank").drop("p_select")
    s = s.join(rk, [*BYK, "series_id"], "left")
    return s.withColumn("accepted", F.coalesce(F.col("base_up_rank") <= K, F.lit(False)))


def _version(spark, d):
    """Names, sizes and times of the files of a folder: rewritten data is another version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(d)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def memo(key, spark, d, build):
    """Write a shared intermediate once per session and read it back.

    The table lies in the folder the cluster names in spark.checkpoint.dir, so it
    survives lost executors and later plans start from a plain scan.
    """
    k = (key, spark.sparkContext.applicationId, d, _version(spark, d))
    if k not in _CACHE:
        path = f"{scratch(spark)}/{key}"
        build().write.parquet(path)
        _CACHE[k] = path
    return spark.read.parquet(_CACHE[k])


def forget():
    """Shared intermediates are built anew from here on."""
    _CACHE.clear()


def brand_table(spark, d):
    return memo("brand", spark, d, lambda: brand(spark, d))


def group_table(spark, d):
    return memo("groups", spark, d, lambda: groups(brand_table(spark, d)))


def target_table(spark, d):
    return memo("targets", spark, d, lambda: T.direction_targets(brand_table(spark, d)))


def ranked(spark, d):
    return memo("ranked", spark, d, lambda: base_scores(spark, d))


def market(spark, d):
    def build():
        s = ranked(spark, d)
        m = M.market_regime(brand_table(spark, d)).join(M.peer_summary(s.drop("accepted"), s), BYK, "left")
        m = m.join(s.groupBy(*BYK).agg(F.max("previous_shock_share").alias("previous_shock_share")), BYK, "left")
        h = M.breadth_history(target_table(spark, d))
        return M.stress(m).join(h.select(*BYK, F.col("breadth_mean_12").alias("forecast_breadth")), BYK, "left")
    return memo("market", spark, d, build)


def scores(spark, d):
    def build():
        m = market(spark, d).select(*BYK, F.round("regime_stress", 9).alias("regime_stress"), "regime_label",
                                    F.round("forecast_breadth", 9).alias("forecast_breadth"))
        return ranked(spark, d).join(m, BYK).withColumn("direction", F.lit("Up"))
    return memo("scores", spark, d, build)


from .registry import query  # noqa: E402

_S = {"prior": "prior", "p_up_raw": "p_up_raw", "p_up": "p_up", "p_select": "p_select", "p_down": "p_down", "p_down_pattern": "p_down_pattern",
      "group_relative_logit": "rel", "regime_stress": "regime_stress", "forecast_breadth": "forecast_breadth"}
query("g01_prior_blend_scores", 'select s as series_id, pos as "position", ' + ", ".join(f"{q6(e, 11)} as {n}" for n, e in _S.items())
      + ", ready, base_up_rank, accepted, regime_label from t_scores")(
    lambda s, d: out(scores(s, d), list(_S), 11).select("series_id", "position", *_S, "ready", "base_up_rank", "accepted", "regime_label"))
query("d14_peer_summary", 'select pos as "position", peer_count, peer_available, ' + ", ".join(f"{q6(c)} as {c}" for c in [*_peer, "peer_mean_return", "peer_median_return", "peer_dispersion", "peer_mean_momentum_3"]) + " from t_peer_brand")(
    lambda s, d: out(M.peer_summary(ranked(s, d).drop("accepted"), ranked(s, d)), [*_peer, "peer_mean_return", "peer_median_return", "peer_dispersion", "peer_mean_momentum_3"]).drop("panel_id"))
_fl = {"negative_return": "case when r < 0 then 1 when r >= 0 then 0 end", "weak_momentum": "case when m3 < 0 then 1 when m3 >= 0 then 0 end",
       "negative_streak": "case when neg3 >= 0.5 then 1 when neg3 < 0.5 then 0 end", "exhaustion": "case when ex_flag = 1 then 1 when ex_flag = 0 then 0 end"}
query("d15_warnings", f"""select s as series_id, pos as "position", {q6('(' + ' + '.join(f'coalesce({e}, 0)' for e in _fl.values()) + ')::double / nullif(' + ' + '.join(f'(({e}) is not null)::int' for e in _fl.values()) + ', 0)')} as warning_score,
 concat_ws(',', {', '.join(f"case when {e} = 1 then '{n}' end" for n, e in _fl.items())}) as warning_reason from t_ranked_brand where not accepted""")(
    lambda s, d: out(M.warnings(ranked(s, d).drop("accepted"), ranked(s, d)), ["warning_score"]).drop("panel_id"))
_st = [f"{c}_stress" for c in M.STRESS_LOW + M.STRESS_HIGH] + [*M.STRESS_PARTS, "regime_stress"]
query("d16_stress", 'select pos as "position", ' + ", ".join(f"{q6(c)} as {c}" for c in _st) + " from t_stress_brand")(
    lambda s, d: out(market(s, d), _st).select("position", *_st))
