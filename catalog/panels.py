"""Scans, sinks and table contracts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators.targets import direction_targets
from walksieve.sources import contracts as C
from walksieve.sources import panel as P
from walksieve.sources import snapshot as S

from .base import WINDOWS, brand, groups, hourly, nation, out, part, price, q6, supplier, table, GROUP_SQL
from .registry import query

CELLS = "select position, month, series_id, value"


def cells(p):
    return p.select("position", "month", "series_id", rnd("value", 2).alias("value"))


def _cells_sql(name):
    return f'select pos as "position", mo as "month", s as series_id, {q6("v", 2)} as value from t_{name}'


for _name, _fn in [("brand", brand), ("supplier", supplier), ("part", part), ("nation", nation), ("hourly", hourly)]:
    query(f"a01_panel_{_name}", _cells_sql(_name))(lambda spark, d, fn=_fn: cells(fn(spark, d)))


def scratch(spark):
    """A new folder below the one that the whole cluster sees. Only a local session without one gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid

        return f"{shared.rstrip('/')}/walksieve-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@query("a02_bounded_scan", """
select pos as "position", s as series_id, (0.0::double + round(v, 2)) as value from t_supplier where pos <= 48
and s in (select s from t_supplier where pos <= 48 and v is not null)""")
def bounded(spark, d):
    p = P.read_panel(spark, f"{d}/lineitem.parquet", time_col="l_shipdate", series_col="l_suppkey",
                     value_col="l_extendedprice", max_position=48)
    return p.select("position", "series_id", rnd("value", 2).alias("value"))


@query("a03_calendar_check", """
with c as (select distinct l_partkey as series_id, cast(date_trunc('month', l_shipdate) as date) as mo from lineitem),
n as (select l_partkey as series_id, cast(date_trunc('month', l_shipdate) as date) as mo, count(*) as n from lineitem group by 1, 2),
g as (select series_id, mo, date_diff('month', lag(mo) over (partition by series_id order by mo), mo) - 1 as gap from c)
select series_id, mo as "month", 'gap_before' as problem, gap as amount from g where gap > 0
union all select series_id, mo, 'duplicate', n - 1 from n where n > 1""")
def calendar(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("series_id"), "l_shipdate")
    return C.check_calendar(li, "l_shipdate", ["series_id"])


@query("a04_numeric_check", """
select 'event_type' as column_name, count(*) as bad_cells from events where event_type is not null and try_cast(event_type as double) is null
union all select 'props', count(*) from events where props is not null and try_cast(props as double) is null""")
def numeric(spark, d):
    return C.check_numeric(table(spark, d, "events"), ["user_id", "event_type", "value", "props"])


@query("a05_name_check", """
with n as (select distinct regexp_extract(s, '(\\d+)$', 1) as k from t_brand)
select 'X' || cast(i as varchar) as name, 'missing' as problem
from (select unnest(range(1, (select count(*) + 1 from n))) as i) where cast(i as varchar) not in (select k from n)""")
def names(spark, d):
    b = brand(spark, d).withColumn("series_id", F.concat(F.lit("X"), F.regexp_extract("series_id", r"(\d+)$", 1)))
    wide = b.groupBy("month").pivot("series_id").agg(F.first("value"))
    return C.check_names(wide, "X")


@query("a06_to_long", """
select l_orderkey, l_linenumber, 'l_quantity' as series_id, l_quantity as value from lineitem
union all select l_orderkey, l_linenumber, 'l_discount', l_discount from lineitem
union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem""")
def long(spark, d):
    return P.to_long(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("a07_to_wide", f"""
select pos as "position", {', '.join(f"round(avg(case when g = 'g{i}' then v end), 4) + 0.0::double as g{i}" for i in range(5))}
from (select *, {GROUP_SQL} as g from t_brand) group by pos""")
def wide(spark, d):
    p = brand(spark, d)
    names_ = [f"g{i}" for i in range(5)]
    w = P.to_wide(p.join(groups(p), "series_id"), "value", names_)
    return out(w.drop("panel_id"), names_, 4)


@query("a08_read_scores", """
select l_orderkey as series_id, l_linenumber as "position", l_quantity as p from lineitem where l_linenumber <= 2""")
def read_scores(spark, d):
    tmp = scratch(spark) + "/scores"
    table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("series_id"), F.col("l_linenumber").alias("position"),
        F.col("l_quantity").alias("p"), "l_tax",
    ).write.parquet(tmp)
    return P.read_scores(spark, tmp, ["series_id", "position", "p"], 2)


@query("a09_snapshot_roundtrip", _cells_sql("supplier"))
def snapshot(spark, d):
    root, params = scratch(spark), {"panel": "supplier", "version": 1}
    S.write_snapshot(cells(supplier(spark, d)), root, params)
    return S.read_snapshot(spark, root, params)


@query("a09_csv_sink", _cells_sql("nation"))
def csv_sink(spark, d):
    root, params = scratch(spark), {"panel": "nation"}
    df = cells(nation(spark, d))
    S.write_snapshot(df, root, params, fmt="csv")
    return S.read_snapshot(spark, root, params, fmt="csv", schema=df.schema)


@query("a10_required_columns", 'select count(*) as "rows" from lineitem')
def required(spark, d):
    df = C.check_columns(table(spark, d, "lineitem"), ["l_orderkey", "l_shipdate"])
    return df.agg(F.count(F.lit(1)).alias("rows"))


@query("a11_unique_keys", """
select l_partkey, l_suppkey, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def unique(spark, d):
    return C.check_unique(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("a12_leakage_check", """
select s as series_id, pos as "position", pos - 1 - (pos % 3) as fit_through from t_supplier where pos - 1 - (pos % 3) > pos - 2""")
def leakage(spark, d):
    p = supplier(spark, d).withColumn("fit_through", F.col("position") - 1 - F.col("position") % 3)
    return C.check_leakage(p, "fit_through").select("series_id", "position", "fit_through")


@query("a13_coverage_check", """
with w as (select unnest(range(0, 100)) as p), h as (select distinct pos as p from t_supplier)
select cast(p as integer) as "position", 'missing' as problem from w where p not in (select p from h)
union all select p, 'extra' from h where p not in (select p from w)""")
def coverage(spark, d):
    return C.check_coverage(supplier(spark, d), 0, 99).select("position", "problem")


def _ready(spark, d):
    t = direction_targets(supplier(spark, d))
    return t.withColumns({"ready": F.col("value").isNotNull(), "score": F.col("value")})


@query("a14_split_outcomes", """
select s as series_id, pos as "position", v is not null as ready,
       case when v is not null then row_number() over (partition by pos, v is not null order by v desc, s) end as base_up_rank
from t_supplier""")
def split(spark, d):
    left, _ = C.split_outcomes(_ready(spark, d), ["ready"], ["y_true", "change"], "score")
    return left.select("series_id", "position", "ready", "base_up_rank")


@query("a15_attach_outcomes", """
select s as series_id, pos as "position", v is not null as ready, y as y_true from t_supplier_y""")
def attach(spark, d):
    left, right = C.split_outcomes(_ready(spark, d), ["ready"], ["y_true"], "score")
    joined, _ = C.attach_outcomes(left, right)
    return joined.select("series_id", "position", "ready", "y_true")


@query("a15_key_audit", """
select s as series_id, pos as "position", 'no_outcome' as problem from t_supplier where pos % 2 = 1""")
def key_audit(spark, d):
    left, right = C.split_outcomes(_ready(spark, d), ["ready"], ["y_true"], "score")
    return C.attach_outcomes(left, right.where("position % 2 = 0"))[1].drop("panel_id")


@query("a16_fingerprint")
def fingerprint(spark, d):
    return S.fingerprint(table(spark, d, "lineitem"))


@query("a16_manifest")
def manifest(spark, d):
    return S.snapshot_manifest(supplier(spark, d), {"panel": "supplier", "lag": 1})


@query("a17_upsert", """
with l as (select o_orderkey as id, o_orderstatus as status, o_totalprice as amount from orders),
n as (select o_orderkey as id, 'X' as status, 0.0::double as amount from orders where o_orderkey % 7 = 0
      union all select -n_nationkey - 1, 'N', 1.0 from nation)
select * from n union all select * from l where id not in (select id from n)""")
def upsert(spark, d):
    led = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
                                           F.col("o_totalprice").alias("amount"))
    new = led.where("id % 7 = 0").select("id", F.lit("X").alias("status"), F.lit(0.0).alias("amount"))
    add = table(spark, d, "nation").select((-F.col("n_nationkey") - 1).cast("bigint").alias("id"),
                                           F.lit("N").alias("status"), F.lit(1.0).alias("amount"))
    return S.upsert(led, new.union(add), "id")


@query("a18_profile", """
select s as series_id, count(v) as observations, min(pos) filter (v is not null) - min(pos) as leading_missing,
       max(pos) filter (v is not null) - min(pos) filter (v is not null) + 1 - count(v) as internal_missing,
       cast(coalesce(sum((v = nv)::int), 0) as bigint) as zero_changes, count(*) filter (v is not null and nv is not null) as target_rows,
       min(mo) filter (v is not null) as first_month, max(mo) filter (v is not null) as last_month
from t_part_y group by s""")
def profile(spark, d):
    return S.profile(part(spark, d)).drop("panel_id")


@query("a19_assert_equal", """
select s as series_id, pos as "position", cast(null as varchar) as missing_side, 'value' as differing from t_supplier
where pos <= 60 and pos % 10 = 0 and v is not null
union all select s, pos, 'right', '' from t_supplier where pos > 60 and v is null
union all select s, pos, 'right', 'value' from t_supplier where pos > 60 and v is not null""")
def equal(spark, d):
    p = supplier(spark, d).select("series_id", "position", "value")
    other = p.where("position <= 60").withColumn(
        "value", F.col("value") + F.when(F.col("position") % 10 == 0, 1.0).otherwise(1e-9))
    return C.assert_equal(p, other, ["series_id", "position"], tol=1e-6)


@query("a20_nest_forecast")
def nest(spark, d):
    from walksieve.functions.ordering import score_order, top_k
    from walksieve.operators.priors import calendar_rate

    t = calendar_rate(direction_targets(supplier(spark, d)), n=24, min_labels=12)
    c = top_k(t.where("prior is not null"), ["panel_id", "position"], score_order("prior"), 5)
    c = c.select("panel_id", F.lit(1).alias("horizon"), "month", "rank", "series_id",
                 F.lit("Up").alias("direction"), F.col("prior").alias("score"))
    return S.nest_forecast(c).select("horizon", "month", F.to_json("selections").alias("selections"))


@query("a21_stamp_active", """
select s as series_id, pos as "position", 'wf-1' as active_model, 'policy-a' as active_policy from t_supplier""")
def stamp(spark, d):
    return S.stamp_active(supplier(spark, d).select("series_id", "position"), {"model": "wf-1", "policy": "policy-a"})


@query("a21_call_coverage", """
with k as (select pos, row_number() over (partition by pos order by v desc, s) as rk from t_brand where v is not null)
select pos as "position", count(*) as calls, count(*) as series from k where rk <= 3 + pos % 20 group by pos having count(*) not between 15 and 20""")
def call_coverage(spark, d):
    from walksieve.functions.ordering import score_order, top_k

    p = brand(spark, d).where("value is not null")
    c = top_k(p, ["panel_id", "position"], score_order("value"), 22).where("rank <= 3 + position % 20")
    return C.calls_per_period(c, 15, 20).drop("panel_id")
