"""Panels of the test tables, shared windows and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import round_cols, rnd
from walksieve.functions.ordering import score_order, top_k
from walksieve.sources.panel import panel_from_facts

from .registry import cte, query

# Evaluation windows of the 83-month test panels.
WINDOWS = {"tuning": (36, 50), "validation": (51, 64), "confirmation": (65, 80)}
WINDOW_SQL = " union all ".join(
    f"select '{k}' as \"window\", {lo} as lo, {hi} as hi" for k, (lo, hi) in WINDOWS.items()
)
cte("t_win", WINDOW_SQL)


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def price():
    return F.col("l_extendedprice").cast("decimal(18,2)")


def brand(spark, d, **kw):
    """25 series: monthly revenue per brand."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    facts = li.join(part, li.l_partkey == part.p_partkey).select("l_shipdate", "p_brand", "l_extendedprice")
    return panel_from_facts(facts, time="l_shipdate", series="p_brand", value=price(),
                            calendar=li.select("l_shipdate"), **kw)


def supplier(spark, d, **kw):
    """One series per supplier: grows with the scale factor."""
    return panel_from_facts(table(spark, d, "lineitem"), time="l_shipdate", series="l_suppkey", value=price(), **kw)


def part(spark, d, **kw):
    """One sparse series per part."""
    return panel_from_facts(table(spark, d, "lineitem"), time="l_shipdate", series="l_partkey", value=price(), **kw)


def nation(spark, d, **kw):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    facts = o.join(c, o.o_custkey == c.c_custkey).select("o_orderdate", "c_nationkey", "o_totalprice")
    return panel_from_facts(facts, time="o_orderdate", series="c_nationkey",
                            value=F.col("o_totalprice").cast("decimal(18,2)"),
                            calendar=o.select("o_orderdate"), **kw)


def hourly(spark, d, **kw):
    return panel_from_facts(table(spark, d, "events"), time="ts", series="event_type",
                            value=F.col("value").cast("decimal(18,6)"), unit="hour", **kw)


def _panel_sql(time, series, value, source, span, unit="month"):
    step = f"interval 1 {unit}"
    cast = "date" if unit == "month" else "timestamp"
    return f"""
with m as (select cast(date_trunc('{unit}', {time}) as {cast}) as mo, cast({series} as varchar) as s,
                  cast(sum({value}) as double) as v from {source} group by 1, 2),
b as (select date_trunc('{unit}', min({time})) as lo, date_trunc('{unit}', max({time})) as hi from {span}),
cal as (select cast(x as {cast}) as mo, cast(row_number() over (order by x) as integer) as pos
        from (select unnest(generate_series(cast(lo as timestamp), cast(hi as timestamp), {step})) as x from b))
select c.pos, c.mo, q.s, m.v from cal c cross join (select distinct s from m) q
left join m on m.mo = c.mo and m.s = q.s"""


_PRICE = "cast(l_extendedprice as decimal(18,2))"
cte("t_brand", _panel_sql("l_shipdate", "p_brand", _PRICE, "lineitem join part on l_partkey = p_partkey", "lineitem"))
cte("t_supplier", _panel_sql("l_shipdate", "l_suppkey", _PRICE, "lineitem", "lineitem"))
cte("t_part", _panel_sql("l_shipdate", "l_partkey", _PRICE, "lineitem", "lineitem"))
cte("t_nation", _panel_sql("o_orderdate", "c_nationkey", "cast(o_totalprice as decimal(18,2))",
                           "orders join customer on o_custkey = c_custkey", "orders"))
cte("t_hourly", _panel_sql("ts", "event_type", "cast(value as decimal(18,6))", "events", "events", "hour"))
for _p in ("brand", "supplier", "part", "nation", "hourly"):
    cte(f"t_{_p}_y", f"""
select *, case when v is null or nv is null then null when nv > v then 1.0::double else 0.0::double end as y
from (select *, lead(v) over (partition by s order by pos) as nv from t_{_p})""")


def q6(x, n=6):
    """SQL text of the common rounding; adding 0.0 folds a negative zero."""
    return f"(0.0::double + round({x}, {n}))"


def pct_sql(c, by="pos"):
    """SQL text of the share of an average-tie rank among the values of a period."""
    return (f"case when {c} is not null then (rank() over (partition by {by}, {c} is null order by {c}) + "
            f"(count(*) over (partition by {by}, {c}) - 1) / 2.0::double) / count({c}) over (partition by {by}) end")


def out(df, cols, places=6):
    return round_cols(df, cols, places)


def groups(panel, k: int = 5):
    """Group dimension of the brand panel: brand number modulo five."""
    n = F.regexp_extract("series_id", r"(\d+)$", 1).cast("int")
    return panel.select("series_id").distinct().withColumn("group_id", F.concat(F.lit("g"), F.pmod(n, F.lit(k)).cast("string")))


GROUP_SQL = "'g' || cast(cast(regexp_extract(s, '(\\d+)$', 1) as integer) % 5 as varchar)"


@query("flagship_hit_rate", f"""
select w."window", count(distinct pos) as months, count(*) as calls, cast(sum(y) as bigint) as hits,
       {q6('avg(y)')} as accuracy
from (select *, row_number() over (partition by pos order by prior desc, s) as rk
      from (select pos, s, y, round(avg(y) over w, 6) as prior, count(y) over w as n from t_brand_y
            window w as (partition by s order by pos range between 25 preceding and 2 preceding)) r
      where n >= 20 and y is not null) k
join t_win w on pos between w.lo and w.hi
where rk <= 5 group by 1""")
def flagship(spark, d):
    from walksieve.operators.priors import calendar_rate
    from walksieve.operators.targets import direction_targets, in_windows

    rate = calendar_rate(direction_targets(brand(spark, d)), n=24, lag=2, min_labels=20)
    pool = rate.where("prior is not null and y_true is not null").withColumn("prior", F.round("prior", 6))
    calls = top_k(pool, ["panel_id", "position"], score_order("prior"), 5)
    return in_windows(calls, WINDOWS).groupBy("window").agg(
        F.count_distinct("position").alias("months"), F.count(F.lit(1)).alias("calls"),
        F.sum("y_true").cast("bigint").alias("hits"), rnd(F.avg("y_true")).alias("accuracy"),
    )
