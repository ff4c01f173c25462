"""Labels, splits and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import targets as T

from .base import WINDOWS, brand, groups, out, part, price, q6, supplier, table, GROUP_SQL
from .registry import cte, query


@query("b01_direction_targets", f"""
select s as series_id, pos as "position", lead(mo) over (partition by s order by pos) as target_month, {q6('nv - v', 2)} as change,
       y as y_true, nv = v as zero_change, y is not null as target_available from t_part_y""")
def direction(spark, d):
    t = T.direction_targets(part(spark, d))
    return t.select("series_id", "position", "target_month", rnd("change", 2).alias("change"), "y_true",
                    "zero_change", "target_available")


for _h in (1, 2, 3):
    query(f"b02_horizon_targets_{_h}", f"""
select s as series_id, pos as "position", {_h} as horizon,
       case when a is null or b is null then null when b > a then 1.0::double else 0.0::double end as y_true,
       b is not null and a is not null as target_available
from (select s, pos, lead(v, {_h - 1}) over (partition by s order by pos) as a, lead(v, {_h}) over (partition by s order by pos) as b from t_supplier)""")(
        lambda spark, d, h=_h: T.horizon_targets(supplier(spark, d), h).select(
            "series_id", "position", "horizon", "y_true", "target_available"))


@query("b03_target_at", """select s as series_id, pos as "position", y as y_true from t_supplier_y where s = '7' and pos = 40""")
def target_at(spark, d):
    return T.target_at(T.direction_targets(supplier(spark, d)), 40, "7").drop("panel_id")


@query("b04_alignment_audit", """
select s as series_id, pos as "position", 1 - y as y_true from t_supplier_y where pos % 9 = 0 and y is not null""")
def audit(spark, d):
    p = supplier(spark, d)
    t = T.direction_targets(p).withColumn("y_true", F.when(F.col("position") % 9 == 0, 1 - F.col("y_true")).otherwise(F.col("y_true")))
    return T.audit_alignment(p, t).select("series_id", "position", "y_true")


@query("b05_layout", """
with n as (select max(pos) as n from t_supplier)
select 'warmup' as name, 1 as lo, 12 as hi from n union all select 'estimation', 13, 40 from n
union all select 'development', 41, n - 21 from n union all select 'audit', n - 20, n - 1 from n
union all select 'production', n, n from n""")
def layout(spark, d):
    return T.layout(supplier(spark, d), audit=20, estimation=40).drop("panel_id")


@query("b06_causal_train", """
select o.o as origin, count(*) as "rows", cast(sum(y) as bigint) as ups, max(pos) as fit_through
from (select unnest(range(3, 83)) as o) o join t_supplier_y t on t.pos <= o.o - 2 and y is not null group by 1""")
def causal_train(spark, d):
    t = T.direction_targets(supplier(spark, d)).where("y_true is not null")
    tr = T.causal_train(t, T.origins_frame(spark, 3, 82))
    return tr.groupBy(F.col("origin").cast("bigint").alias("origin")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y_true").cast("bigint").alias("ups"), F.max("position").alias("fit_through"))


@query("b06_causal_totals", """
select o.pos as "position", count(t.y) as n, cast(coalesce(sum(t.y), 0) as bigint) as ups
from (select distinct pos from t_supplier) o left join t_supplier_y t on t.pos <= o.pos - 2 group by 1""")
def causal_totals(spark, d):
    t = T.direction_targets(supplier(spark, d))
    return T.causal_totals(t, {"n": F.when(F.col("y_true").isNotNull(), 1).otherwise(0), "ups": F.coalesce("y_true", F.lit(0.0))}).select(
        "position", "n", F.col("ups").cast("bigint").alias("ups"))


@query("b08_eligible", """
select s as series_id, pos as "position", s not in ('3', '17') as data_quality_ok,
       (y is not null and lag(v) over (partition by s order by pos) is not null and pos > 24 and s not in ('3', '17')) as eligible
from t_supplier_y""")
def eligible(spark, d):
    ban = spark.createDataFrame([("3",), ("17",)], "series_id string")
    return T.eligible(T.direction_targets(supplier(spark, d)), exclude=ban).select(
        "series_id", "position", "data_quality_ok", "eligible")


@query("b09_windows", """
select w, count(*) as "rows", cast(sum(y) as bigint) as ups from t_supplier_y
join (select 'early' as w, 36 as lo, 45 as hi union all select 'late', 40, 60 union all select 'all', 36, 80) q on pos between lo and hi group by 1""")
def windows(spark, d):
    w = T.in_windows(T.direction_targets(supplier(spark, d)), {"early": (36, 45), "late": (40, 60), "all": (36, 80)})
    return w.groupBy(F.col("window").alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum("y_true").cast("bigint").alias("ups"))


def shocks_sql(panel):
    """Drop labels with a 36-period memory, at least 18 past returns, lower fifth and half a robust deviation."""
    return f"""
select *, case when r is not null and tail is not null then (r < 0 and r <= tail)::int::double end as extreme,
       coalesce(valid and r < 0 and r <= tail and r <= thr, false) as shock
from (select *, coalesce(r is not null and tail is not null and thr is not null and sc > 0, false) as valid
      from (select *, med - 0.5 * sc as thr
            from (select s, pos, r, case when n >= 18 then t0 end as tail, case when n >= 18 then m0 end as med,
                         case when n >= 18 then 1.4826 * d0 end as sc
                  from (select s, pos, r, count(r) over w as n, quantile_cont(r, 0.2) over w as t0,
                               quantile_cont(r, 0.5) over w as m0, mad(r) over w as d0
                        from (select s, pos, nv / nullif(v, 0) - 1 as r from {panel}_y)
                        window w as (partition by s order by pos rows between 36 preceding and 1 preceding)))))"""


SHOCK = dict(window=36, min_n=18, q=0.2, z=0.5)
cte("t_shock_supplier", shocks_sql("t_supplier"))
cte("t_shock_brand", shocks_sql("t_brand"))


@query("b10_sudden_drops", f"""
select s as series_id, pos as "position", {q6('r')} as target_return, {q6('tail')} as lower_tail,
       {q6('thr')} as robust_threshold, valid as label_valid, shock as sudden_drop from t_shock_supplier""")
def drops(spark, d):
    t = T.sudden_drops(T.direction_targets(supplier(spark, d)), **SHOCK)
    return out(t, ["target_return", "lower_tail", "robust_threshold"]).select(
        "series_id", "position", "target_return", "lower_tail", "robust_threshold", "label_valid", "sudden_drop")


@query("b11_extreme_down", 'select s as series_id, pos as "position", extreme as extreme_down from t_shock_supplier')
def extreme(spark, d):
    return T.sudden_drops(T.direction_targets(supplier(spark, d)), **SHOCK).select("series_id", "position", "extreme_down")


@query("b12_down_target", 'select s as series_id, pos as "position", 1 - y as down_true from t_supplier_y')
def down_target(spark, d):
    return T.direction_targets(supplier(spark, d)).select("series_id", "position", (1 - F.col("y_true")).alias("down_true"))


cte("t_known_brand", f"""
with k as (select s, pos + 2 as pos, {GROUP_SQL} as g, case when valid then shock::int::double end as ps from t_shock_brand)
select k.s, k.pos, k.g, k.ps, m.x as pss, gg.x as pgs from k
join (select pos, avg(ps) as x from k group by 1) m on m.pos = k.pos
join (select pos, g, avg(ps) as x from k group by 1, 2) gg on gg.pos = k.pos and gg.g = k.g""")


@query("b13_known_outcome", f"""
select s as series_id, pos as "position", g as group_id, ps as previous_shock, {q6('pss')} as previous_shock_share,
       {q6('pgs')} as previous_group_shock_share from t_known_brand""")
def known(spark, d):
    p = brand(spark, d)
    k = T.known_outcome(T.sudden_drops(T.direction_targets(p), **SHOCK), groups=groups(p))
    return out(k, ["previous_shock_share", "previous_group_shock_share"]).select(
        "series_id", "position", "group_id", "previous_shock", "previous_shock_share", "previous_group_shock_share")


@query("b14_forecast_month", """
select s as series_id, pos as "position", cast(mo + interval 3 month as date) as forecast_month from t_supplier""")
def forecast_month(spark, d):
    return T.forecast_month(supplier(spark, d), 3).select("series_id", "position", "forecast_month")


@query("b15_target_calendar", """
select distinct pos as "position", cast(month(mo + interval 1 month) as integer) as change_month,
       cast(year(mo + interval 1 month) as integer) as change_year from t_supplier""")
def target_calendar(spark, d):
    return T.target_calendar(supplier(spark, d)).select("position", "change_month", "change_year").distinct()


@query("b16_broad_down", f"""
select pos as "position", {q6('avg(y)')} as breadth, case when avg(y) is null then null else (avg(y) < 0.5)::int::double end as broad_down
from t_supplier_y group by pos""")
def broad(spark, d):
    return out(T.broad_down(T.direction_targets(supplier(spark, d))), ["breadth"]).drop("panel_id")
