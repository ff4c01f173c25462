"""Bootstraps and permutation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.operators import metrics as I
from walksieve.operators import resample as J
from walksieve.operators import select as H
from walksieve.operators import targets as T

from .base import WINDOWS, out, q6
from .fixtures import BYK, memo, scores, target_table
from .metrics import calls, sw
from .registry import cte, query
from .selectors import months

cte("t_mon", "select pos, count(*) as calls, sum(hit) as hits, avg(hit) as acc, row_number() over (order by pos) - 1 as i, count(*) over () as n from t_calls where hit is not null group by pos")
cte("t_pair", """select *, row_number() over (order by pos) - 1 as i, count(*) over () as n from (select coalesce(a.pos, b.pos) as pos, coalesce(a.hits, 0) - coalesce(b.hits, 0) as hd, coalesce(a.acc, 0) - coalesce(b.acc, 0) as ad
 from t_mon a full join (select pos, sum(y) as hits, avg(y) as acc from t_scores where accepted and y is not null group by 1) b on a.pos = b.pos)""")
_rnd = lambda rep, k, seed, n: f"((({rep}::bigint * 1103515245 + {k}::bigint * 12345 + {seed}) % 2147483647) % ({n}))"


def boot_sql(src, stat, reps, seed, scheme, block=6, qs=(0.1, 0.5, 0.9), extra=""):
    start = {"circular": _rnd("rep", "k", seed, "n"), "moving": _rnd("rep", "k", seed, f"n - {block} + 1"),
             "fixed": f"{_rnd('rep', 'k', seed, f'ceil(n / {block}.0)::bigint')} * {block}"}[scheme]
    where = f"k * {block} + o < n" if scheme != "fixed" else "st + o < n"
    return f"""
with p as (select max(n) as n from {src}), r as (select rep, k, n, {start} as st from p, (select unnest(range({reps})) as rep), (select unnest(range(1000)) as k) where k < ceil(n / {block}.0)),
d as (select rep, (st + o) % n as i from r, (select unnest(range({block})) as o) where {where}),
v as (select rep, {stat} as v from d join {src} m on m.i = d.i group by 1)
select (select {q6(stat)} from {src}) as observed, (select count(*) from {src}) as months, {', '.join(f"{q6(f'quantile_cont(v, {q})')} as p{int(round(q * 100)):02d}" for q in qs)}{extra}, {q6('avg((v > 0)::int)')} as share_positive from v"""


def shown(df, *more):
    cols = [c for c in df.columns if c not in ("panel_id", "months")]
    return out(df, cols).drop("panel_id")


def mon(s, d):
    return memo("monthly", s, d, lambda: I.monthly(calls(s, d)))


def pair(s, d):
    return memo("pair", s, d, lambda: J.paired_months(calls(s, d), scores(s, d).where("accepted")))


query("j01_circular_bootstrap", boot_sql("t_mon", "avg(acc)", 500, 7, "circular"))(lambda s, d: shown(J.block_bootstrap(mon(s, d), F.avg("accuracy"), reps=500, seed=7)))
query("j02_paired_delta", boot_sql("t_pair", "avg(ad)", 500, 11, "circular"))(lambda s, d: shown(J.block_bootstrap(pair(s, d), F.avg("accuracy_delta"), reps=500, seed=11)))
query("j03_moving_block", boot_sql("t_pair", "sum(hd)", 500, 3, "moving"))(lambda s, d: shown(J.block_bootstrap(pair(s, d), F.sum("hit_delta"), reps=500, seed=3, scheme="moving")))
query("j04_ratio_bootstrap", boot_sql("t_mon", "sum(hits) / sum(calls)", 500, 5, "moving", qs=(0.05, 0.95)))(
    lambda s, d: shown(J.block_bootstrap(mon(s, d), F.sum("hits") / F.sum("calls"), reps=500, seed=5, scheme="moving", qs=(0.05, 0.95))))
query("j05_fixed_blocks", boot_sql("t_pair", "avg(hd)", 500, 13, "fixed"))(lambda s, d: shown(J.block_bootstrap(pair(s, d), F.avg("hit_delta"), reps=500, seed=13, scheme="fixed")))
query("j06_iid_months", boot_sql("t_pair", "avg(ad)", 500, 17, "circular", block=1))(lambda s, d: shown(J.block_bootstrap(pair(s, d), F.avg("accuracy_delta"), reps=500, seed=17, block=1)))
query("j07_metric_bootstrap")(lambda s, d: out(J.metric_bootstrap(scores(s, d), "p_up", "y_true", reps=50), [f"{c}_p{v}" for c in ("auc", "brier", "ece") for v in ("05", "95")]).drop("panel_id"))
query("j08_threshold_shares", boot_sql("t_mon", "sum(hits) / sum(calls)", 500, 19, "moving", extra=f", {q6('avg((v >= 0.5)::int)')} as share_ge_50, {q6('avg((v >= 0.55)::int)')} as share_ge_55"))(
    lambda s, d: shown(J.block_bootstrap(mon(s, d), F.sum("hits") / F.sum("calls"), reps=500, seed=19, scheme="moving", thresholds=(0.5, 0.55))))
query("j09_shift_permutation", f"""
with m as (select *, row_number() over (order by pos) - 1 as i, count(*) over () as n from t_months where stress is not null),
w as (select 6 + {_rnd('rep', '0', 1, 'n - 12 + 1')} as sh, count(*) as w from (select max(n) as n from m), (select unnest(range(500)) as rep) group by 1), a as (select sh, w from w union all select 0, 0),
x as (select a.sh, a.w, m.stress as sc, y.flip_target as yy from a, m join m y on true where y.i = (m.i + a.sh) % m.n),
r as (select *, rank() over (partition by sh order by sc) + (count(*) over (partition by sh, sc) - 1) / 2.0::double as rk, sum(yy) over (partition by sh) as p, count(*) over (partition by sh) as n from x),
v as (select sh, w, (sum(case when yy = 1 then rk end) - max(p) * (max(p) + 1) / 2.0::double) / (max(p) * (max(n) - max(p))) as auc from r group by 1, 2)
select {q6('o.auc')} as observed, {q6('(1 + sum(case when round(v.auc, 12) >= round(o.auc, 12) then v.w else 0 end)) / 501.0::double')} as p_value from v, (select auc from v where sh = 0) o where v.w > 0 group by o.auc""")(
    lambda s, d: out(J.shift_permutation(months(s, d), "stress", "flip_target", reps=500), ["observed", "p_value"]).drop("panel_id"))
query("j10_label_permutation", f"""
with t as (select s, pos, y, month(mo + interval 1 month) as m from t_brand_y where y is not null), cal as (select *, row_number() over (order by pos) - 1 as i from (select distinct pos, m from t)),
p as (select rep, m, row_number() over (partition by rep order by case when rep = 0 then i else ((rep * 7919 * 1103515245::bigint + i * 104729 * 12345::bigint + 1) % 2147483647) end, i) - 1 as j from cal, (select unnest(range(101)) as rep)),
c as (select p.rep, p.m, cal.pos from p join cal on cal.i = p.j), b as (select s, avg(y) as b from t group by 1),
x as (select c.rep, t.s, c.m, count(*) as n, avg(y) as r from t join c on c.pos = t.pos group by 1, 2, 3),
st as (select rep, sum(n * (r - b) * (r - b) / (b * (1 - b))) as v from x join b on b.s = x.s where n >= 3 and b * (1 - b) > 0 group by 1)
select {q6('o.v', 4)} as observed, {q6('median(st.v)', 4)} as null_median, {q6('(1 + sum((st.v >= o.v)::int)) / (1.0::double + count(*))')} as p_value from st, (select v from st where rep = 0) o where rep > 0 group by o.v""")(
    lambda s, d: out(out(J.label_permutation(target_table(s, d), reps=100), ["observed", "null_median"], 4), ["p_value"]).drop("panel_id"))
query("j11_spread_null", f"""
with d as (select s, ((p_up_raw >= 0.5) = (y = 1))::int as a, ((prior >= 0.5) = (y = 1))::int as b from t_scores where y is not null and p_up_raw is not null and prior is not null),
p as (select s, ('0x' || substr(md5(s), 1, 8))::bigint as code, count(*) as n, sum((a <> b)::int) as k, sum((b > a)::int) as lost, avg(a - b) as w from d group by 1),
c as (select s, rep, n, lost, (select coalesce(sum({_rnd('(rep * 7919 + i * 31)', 'code', 1, '2')}), 0) from (select unnest(generate_series(1, k::bigint)) as i)) as coins from p, (select unnest(range(200)) as rep)),
v as (select rep, stddev_samp((coins - lost) / n::double) as v from c group by 1), o as (select stddev_samp(w) as observed, count(*) as series from p)
select {q6('observed')} as observed, series, {q6('quantile_cont(v, 0.5)')} as null_median, {q6('quantile_cont(v, 0.95)')} as null_p95, {q6('avg((v >= observed)::int)')} as p_value from v, o group by observed, series""")(lambda s, d: out(J.spread_null(scores(s, d), "p_up_raw", "prior", reps=200), ["observed", "null_median", "null_p95", "p_value"]).drop("panel_id"))
query("j12_signal_contribution")(lambda s, d: out(_contribution(s, d), ["accuracy"]))


def _contribution(s, d):
    """The same selector on the real score, on a shuffled one and on a constant."""
    x = J.shuffle_within(scores(s, d).where("ready and y_true is not null"), "p_select").withColumn("constant", F.lit(0.5))
    c = H.candidate_scores(x, {"real": "p_select", "shuffled": "shuffled", "constant": "constant"}, 5, hi=5)
    return I.summarize(T.in_windows(c, WINDOWS), ["candidate", "window"]).select("candidate", "window", "calls", "hits", "accuracy")
