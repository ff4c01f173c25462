"""Metrics on the scored panel and its selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.operators import metrics as I
from walksieve.operators import select as H
from walksieve.operators import targets as T

from .base import WINDOWS, brand, out, q6
from .fixtures import BYK, memo, scores, target_table
from .registry import cte, query
from .selectors import HI, adaptive, arms, guarded_calls
from .targets import SHOCK

cte("t_calls", """select *, case when dir = 'Up' then y else 1 - y end as hit, row_number() over (partition by pos order by conf desc, s) as rk from t_adaptive""")
cte("t_cw", 'select c.*, w."window" from t_calls c join t_win w on pos between lo and hi')
cte("t_sw", 'select c.*, w."window" from t_scores c join t_win w on pos between lo and hi where y is not null')
W = ["window"]


def calls(s, d):
    return memo("calls", s, d, lambda: adaptive(s, d))


def cw(s, d):
    return T.in_windows(calls(s, d), WINDOWS)


def sw(s, d):
    return T.in_windows(scores(s, d).where("y_true is not null"), WINDOWS)


query("i01_correct", 'select s as series_id, pos as "position", hit as correct from t_calls')(
    lambda s, d: I.with_correct(calls(s, d)).select("series_id", "position", "correct"))
query("i02_summary", f"""select "window", count(distinct pos) as months, count(*) as calls, sum(hit)::bigint as hits, {q6('avg(hit)')} as accuracy, sum((dir = 'Up')::int) as up_calls, sum((dir = 'Down')::int) as down_calls,
 coalesce(sum(case when dir = 'Down' then hit end), 0)::bigint as down_hits, {q6("avg(case when dir = 'Down' then hit end)")} as down_precision from t_cw where hit is not null group by 1""")(
    lambda s, d: out(I.summarize(cw(s, d), W), ["accuracy", "down_precision"]))
query("i03_monthly_stats", f"""select "window", {q6('avg(a)')} as monthly_mean, {q6('median(a)')} as monthly_median, {q6('coalesce(stddev_samp(a), 0)')} as monthly_std from (select "window", pos, avg(hit) as a from t_cw where hit is not null group by 1, 2) group by 1""")(
    lambda s, d: out(I.monthly_stats(cw(s, d), W), ["monthly_mean", "monthly_median", "monthly_std"]))


def auc_sql(src, score, y, keys):
    k = ", ".join(keys)
    return f"""select {k}, {q6('(sum(case when yy = 1 then r end) - p * (p + 1) / 2) / nullif(p * (n - p), 0)')} as auc from (
 select *, rank() over (partition by {k} order by sc) + (count(*) over (partition by {k}, sc) - 1) / 2.0::double as r, sum(yy) over (partition by {k}) as p, count(*) over (partition by {k}) as n
 from (select {k}, {score} as sc, {y} as yy from {src} where {score} is not null and {y} is not null)) group by {k}, p, n"""


query("i04_auc", auc_sql("t_sw", "p_up", "y", ['"window"']))(lambda s, d: out(I.auc(sw(s, d), "p_up", "y_true", W), ["auc"]))
query("i05_average_precision", f"""
with l as (select "window", p_up as sc, sum(y) as p, count(*) as n from t_sw where p_up is not null group by 1, 2),
c as (select "window", p, sum(p) over w as tp, sum(n) over w as nn, sum(p) over (partition by "window") as tot from l window w as (partition by "window" order by sc desc))
select "window", {q6('sum(p / tot * tp / nn)')} as average_precision from c group by 1""")(
    lambda s, d: out(I.avg_precision(sw(s, d), "p_up", "y_true", W), ["average_precision"]))
_pc = "least(1 - 1e-6, greatest(1e-6, p_up))"
query("i06_brier_log_loss", f"""select "window", {q6('avg((p_up - y) * (p_up - y))')} as brier, {q6(f'avg(-(y * ln({_pc}) + (1 - y) * ln(1 - {_pc})))')} as log_loss from t_sw where p_up is not null group by 1""")(
    lambda s, d: out(sw(s, d).where("p_up is not null").groupBy("window").agg(I.brier("p_up", "y_true").alias("brier"), I.log_loss("p_up", "y_true").alias("log_loss")), ["brier", "log_loss"]))
query("i07_ece", f"""select "window", {q6('sum(n * abs(p - yy)) / sum(n)')} as ece from (select "window", least(floor(p_up * 10), 9) as b, count(*) as n, avg(p_up) as p, avg(y) as yy from t_sw where p_up is not null group by 1, 2) group by 1""")(
    lambda s, d: out(I.ece(sw(s, d), "p_up", "y_true", W), ["ece"]))
_qe = ", ".join(f"quantile_cont(p_up, {i / 5}) as q{i}" for i in range(1, 5))
query("i07_ece_quantile", f"""with e as (select "window", {_qe} from t_sw where p_up is not null group by 1)
select "window", {q6('sum(n * abs(p - yy)) / sum(n)')} as ece_quantile from (select t."window", {' + '.join(f'(p_up > q{i})::int' for i in range(1, 5))} as b, count(*) as n, avg(p_up) as p, avg(y) as yy from t_sw t join e on e."window" = t."window" where p_up is not null group by 1, 2) group by 1""")(
    lambda s, d: out(I.ece_quantile(sw(s, d), "p_up", "y_true", W, bins=5), ["ece_quantile"]))
query("i08_metrics", f"""
with b as (select *, ((p_up >= 0.5) = (y = 1))::int::double as h, rank() over (partition by "window" order by p_up) + (count(*) over (partition by "window", p_up) - 1) / 2.0::double as rp,
 rank() over (partition by "window" order by y) + (count(*) over (partition by "window", y) - 1) / 2.0::double as ry from t_sw where p_up is not null)
select "window", count(*) as n, sum(h)::bigint as hits, {q6('avg(h)')} as accuracy, {q6('(avg(case when y = 1 then h end) + avg(case when y = 0 then h end)) / 2')} as balanced_accuracy,
 {q6('avg(p_up)')} as mean_probability, {q6('avg(y)')} as base_rate, {q6('corr(rp, ry)', 5)} as spearman from b group by 1""")(
    lambda s, d: out(out(I.metrics(sw(s, d), "p_up", "y_true", W).drop("brier", "log_loss", "auc", "ece"), ["accuracy", "balanced_accuracy", "mean_probability", "base_rate"]), ["spearman"], 5))


def wil(h, n, z, sign):
    return f"(({h} / {n} + {z * z} / (2 * {n})) {sign} {z} * sqrt({h} / {n} * (1 - {h} / {n}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n})"


def wq(h, n, z, sign):
    return wil(f"({h})::double", f"({n})::double", z, sign).replace(str(z * z), f"{z * z!r}::double")


query("i09_wilson", f"""select "window", {q6(wq('sum(hit)', 'count(*)', I.Z_TWO_SIDED_95, '-'))} as wilson_low, {q6(wq('sum(hit)', 'count(*)', I.Z_TWO_SIDED_95, '+'))} as wilson_high from t_cw where hit is not null group by 1""")(
    lambda s, d: out(I.wilson(I.summarize(cw(s, d), W), "hits", "calls"), ["wilson_low", "wilson_high"]).select("window", "wilson_low", "wilson_high"))
query("i10_cohort", f"""
with m as (select pos, sum(hit) as h, count(hit) as n from t_calls group by 1),
a as (select m.pos, coalesce(sum(k.h), 0) as h, coalesce(sum(k.n), 0)::bigint as n, count(case when k.n > 0 then 1 end) as mo, max(case when k.n > 0 then k.pos end) as last from m left join m k on k.pos <= m.pos - 2 group by 1)
select pos as "position", n as history_calls, mo as history_months, case when mo >= 12 then {q6('(h + 1) / (n + 2)')} end as cohort_probability, case when mo >= 12 then {q6(wq('h + 1', 'n + 2', I.Z_ONE_SIDED_95, '-'))} end as cohort_lcb, case when mo >= 12 then last end as fit_through from a""")(
    lambda s, d: out(I.cohort(calls(s, d)), ["cohort_probability", "cohort_lcb"]).drop("panel_id"))
_ed = [0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 1.0]
query("i11_reliability", f"""select "window", {' + '.join(f'(p_up >= {e})::int' for e in _ed[1:-1])} as bucket, count(*) as calls, {q6('avg(p_up)')} as mean_probability, {q6('avg(y)')} as observed,
 {q6(wq('sum(y)', 'count(*)', I.Z_TWO_SIDED_95, '-'))} as wilson_low, {q6(wq('sum(y)', 'count(*)', I.Z_TWO_SIDED_95, '+'))} as wilson_high, {q6(wq('sum(y)', 'count(*)', I.Z_ONE_SIDED_95, '-'))} as wilson_lcb from t_sw where p_up is not null group by 1, 2""")(
    lambda s, d: out(I.reliability(sw(s, d), "p_up", "y_true", W, _ed), ["mean_probability", "observed", "wilson_low", "wilson_high", "wilson_lcb"]))
query("i12_quantile_table", f"""with e as (select "window", {_qe} from t_sw where p_up is not null group by 1)
select t."window", 1 + {' + '.join(f'(p_up > q{i})::int' for i in range(1, 5))} as bucket, count(*) as calls, {q6('avg(p_up)')} as mean_score, {q6('avg(y)')} as observed from t_sw t join e on e."window" = t."window" where p_up is not null group by 1, 2""")(
    lambda s, d: out(I.qcut_table(sw(s, d), "p_up", "y_true", W), ["mean_score", "observed"]))
query("i13_slices", " union all ".join(f"select '{n}:' || {c} as slice, count(*) as calls, {q6('avg(hit)')} as accuracy from t_cw where hit is not null group by 1" for n, c in (("regime_label", "regime_label"), ("direction", "dir"), ("series_id", "s"), ("window", '"window"'))))(
    lambda s, d: out(I.slices(cw(s, d), ["regime_label", "direction", "series_id", "window"]), ["accuracy"]))
query("i14_coverage_curve", " union all ".join(f"""select "window", {t}::double as threshold, sum((p_up >= {t})::int)::bigint as calls, {q6(f'sum((p_up >= {t})::int) / count(*)::double')} as coverage, {q6(f'avg(case when p_up >= {t} then y end)')} as accuracy from t_sw where p_up is not null group by 1""" for t in (0.4, 0.45, 0.5, 0.55, 0.6)))(
    lambda s, d: out(I.coverage_curve(sw(s, d), "p_up", "y_true", W, (0.4, 0.45, 0.5, 0.55, 0.6)), ["coverage", "accuracy"]))
query("i15_diversity", f"""
with b as (select *, (p_up_raw >= 0.5) = (y = 1) as ca, (prior >= 0.5) = (y = 1) as cb, (p_up_raw >= 0.5) <> (prior >= 0.5) as dis, rank() over (partition by "window" order by p_up_raw) + (count(*) over (partition by "window", p_up_raw) - 1) / 2.0::double as ra,
 rank() over (partition by "window" order by prior) + (count(*) over (partition by "window", prior) - 1) / 2.0::double as rb from t_sw where p_up_raw is not null and prior is not null)
select "window", count(*) as n, {q6('corr(p_up_raw, prior)', 5)} as pearson, sum(dis::int) as disagreements, {q6('avg(case when dis then ca::int end)')} as a_accuracy_on_disagreements, {q6('avg(case when dis then cb::int end)')} as b_accuracy_on_disagreements,
 sum((not cb and ca)::int) as b_wrong_a_right, sum((not ca and not cb)::int) as double_faults, {q6('corr(ra, rb)', 5)} as spearman from b group by 1""")(
    lambda s, d: out(out(I.diversity(sw(s, d), "p_up_raw", "prior", "y_true", W), ["a_accuracy_on_disagreements", "b_accuracy_on_disagreements"]), ["pearson", "spearman"], 5))
query("i16_top_n", f"""
with r as (select *, row_number() over (partition by pos order by p_select desc, s) as k from t_sw where p_select is not null)
select "window", n.n, count(y) as calls, {q6('avg(y)')} as precision from r join (select unnest([1, 3, 5, 10]) as n) n on r.k <= n.n group by 1, 2""")(
    lambda s, d: out(I.top_n(sw(s, d), "p_select", "y_true", [1, 3, 5, 10], W), ["precision"]))
query("i17_rank_bands", f"""select "window", b as band, count(*) as calls, sum(hit)::bigint as hits, {q6('avg(hit)')} as accuracy from t_cw join (select 'top' as b, 1 as l, 3 as h union all select 'mid', 4, 5 union all select 'extra', 6, 10) q on rk between l and h where hit is not null group by 1, 2""")(
    lambda s, d: out(I.rank_bands(cw(s, d), {"top": (1, 3), "mid": (4, 5), "extra": (6, 10)}, W), ["accuracy"]))
query("i18_drift", f"""select pos as "position", calls, {q6('a')} as accuracy, {q6('p')} as prevalence, case when count(a) over w >= 6 then {q6('avg(a) over w')} end as rolling_accuracy from (select pos, count(*) as calls, avg(hit) as a, avg(y) as p from t_calls where hit is not null group by 1) window w as (order by pos rows between 11 preceding and current row)""")(
    lambda s, d: out(I.drift(calls(s, d)), ["accuracy", "prevalence", "rolling_accuracy"]).drop("panel_id"))
query("i19_overlap", f"""
with j as (select coalesce(a.pos, b.pos) as pos, coalesce(a.s, b.s) as s, a.s is not null as ina, b.s is not null as inb, a.y as ya, b.y as yb from (select * from t_scores where accepted) a full join t_calls b on a.s = b.s and a.pos = b.pos)
select pos as "position", sum(ina::int) as baseline_calls, sum(inb::int) as candidate_calls, sum((ina and inb)::int) as overlap, coalesce(string_agg(case when inb and not ina then s end, ',' order by s), '') as added,
 coalesce(string_agg(case when ina and not inb then s end, ',' order by s), '') as removed, coalesce(sum(case when inb and not ina then yb end), 0) - coalesce(sum(case when ina and not inb then ya end), 0) as net_hit_change from j group by 1""")(
    lambda s, d: I.overlap(scores(s, d).where("accepted"), calls(s, d)).drop("panel_id"))
query("i20_per_series", f"""
with c as (select s, count(*) as n, avg(hit) as a from t_cw where hit is not null group by 1)
select t.s as series_id, count(*) as "rows", {q6('avg(y)')} as up_rate, {q6('avg(((p_up >= 0.5) = (y = 1))::int)')} as raw_accuracy_blend, max(c.n) as selected_adaptive, {q6('max(c.a)')} as selected_accuracy_adaptive from t_sw t left join c on c.s = t.s group by 1""")(
    lambda s, d: out(I.per_series(sw(s, d), {"adaptive": cw(s, d)}, {"blend": "p_up"}), ["up_rate", "raw_accuracy_blend", "selected_accuracy_adaptive"]))
query("i21_scenarios", f"""
with b as (select t.*, c.dir as d2, c.hit as h2, coalesce(k.valid and k.shock, false) as sh from t_sw t left join t_calls c on c.s = t.s and c.pos = t.pos left join t_shock_brand k on k.s = t.s and k.pos = t.pos)
select "window", coalesce(regime_label, 'all') as regime, count(distinct case when d2 is not null then pos end) as months, count(h2) as calls, coalesce(sum(h2), 0)::bigint as hits, {q6('avg(h2)')} as accuracy, sum(coalesce(d2 = 'Down', false)::int) as down_calls,
 sum(coalesce(d2 = 'Down' and y = 0, false)::int) as down_hits, sum(sh::int) as sudden_drops, sum(coalesce(d2 = 'Down' and sh, false)::int) as sudden_down_calls from b group by grouping sets (("window", regime_label), ("window"))""")(
    lambda s, d: out(I.scenarios(sw(s, d), calls(s, d), T.sudden_drops(target_table(s, d), **SHOCK), W).drop("down_precision", "down_recall", "sudden_drop_recall"), ["accuracy"]))
query("i22_policy_delta")(lambda s, d: out(I.policy_delta(T.in_windows(guarded_calls(s, d), WINDOWS), W), ["accuracy_delta_pp", "down_precision"]))
query("i23_replacement")(lambda s, d: I.replacement(T.in_windows(H.insert_down(arms(s, d), cap="cap", hi=HI, margin=0.0, floor=0.5, max_down=3), WINDOWS), W))
query("i23_down_distribution")(lambda s, d: I.down_distribution(cw(s, d), W).select("window", F.to_json("down_distribution").alias("down_distribution")))
query("i24_cap_distribution", "select cap, count(*) as months from (select pos, count(*) as cap from t_calls group by 1) group by 1")(lambda s, d: I.cap_distribution(calls(s, d)))
query("i25_expansion_only", """select "window", count(*) as calls, sum(hit)::bigint as hits from t_cw where rk > 5 and not repl and hit is not null group by 1""")(lambda s, d: I.expansion_only(cw(s, d), 5, W))
