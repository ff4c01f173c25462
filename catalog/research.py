"""Models on the full feature set, ablation of feature families and the regime-adaptive study."""

from __future__ import annotations

from pyspark.sql import functions as F

from walksieve.functions.columns import rnd
from walksieve.operators import features as X
from walksieve.operators import forecasting
from walksieve.operators import graph as E
from walksieve.operators import localpath
from walksieve.operators import metrics as I
from walksieve.operators import models as Z
from walksieve.operators import priors as G
from walksieve.operators import resample as J
from walksieve.operators import search as K
from walksieve.operators import select as H
from walksieve.operators import targets as T
from walksieve.operators import varying as V
from walksieve.operators.boosting import boosted_forecast
from walksieve.operators.seasonal import existence_tests
from walksieve.plans import ablation, adaptive, answers, correctness, external, local_study, policies, robustness, seasonality, uptrend

from .base import WINDOWS, out, q6
from .fixtures import BYK, brand_table, group_table, memo, scores, target_table
from .metrics import wq
from .registry import cte, query
from .selectors import ADAPT, HI, LO
from .targets import SHOCK

KEYS = [*BYK, "series_id"]
#: First origin with both labels known to the last one with features; the same for every model here.
SPAN = dict(lo=3, hi=82)
#: The frozen graph of the studies knows changes up to here; studies start after it.
GRAPH = 35
INTERNAL = {"early_tuning": (36, 43), "late_tuning": (44, 50)}


def full(s, d):
    """All features and the label of every series and period."""
    def build():
        f = uptrend.structured_features(brand_table(s, d))
        return f.join(target_table(s, d).select(*KEYS, "y_true"), KEYS, "left")
    return memo("full_features", s, d, build)


MODELS = [V.Config("uptrend", tuple(uptrend.UPTREND), effect=True), V.Config("interaction", tuple(uptrend.UPTREND), tuple(uptrend.VARYING), True)]


def models(s, d, name="uptrend"):
    return memo(f"full_{name}", s, d, lambda: V.walk_forward_many(full(s, d), [c for c in MODELS if c.name == name], **SPAN))


def p5(df, *more):
    return df.select("series_id", "position", *more, rnd("p", 5).alias("p"), "fit_through")


query("f01_full_features")(lambda s, d: p5(models(s, d)))
query("f07_varying_slopes")(lambda s, d: p5(models(s, d, "interaction")))
query("f08_varying_coefficients")(lambda s, d: (lambda f: out(f.coefficients(full(s, d)), ["coefficient"], 5).select("origin", "series_id", "term", "coefficient"))(V.fit_many(full(s, d), MODELS[1:], **SPAN)))


def ablated(s, d):
    def build():
        return V.walk_forward_many(full(s, d), ablation.family_models(uptrend.UPTREND, X.FAMILIES, effect=True), **SPAN)
    return memo("ablated", s, d, build)


query("k07_family_models")(lambda s, d: _quality(ablated(s, d)))


def _quality(m):
    m = T.in_windows(m.where("y_true is not null"), WINDOWS)
    a = I.auc(m, "p", "y_true", ["config", "window"])
    b = m.groupBy("config", "window").agg(F.count(F.lit(1)).alias("rows"), I.brier("p", "y_true").alias("brier"))
    return out(a.join(b, ["config", "window"]), ["auc", "brier"], 5)


def breadth(s, d):
    """Forecast of breadth at every origin, 100 trees each."""
    def build():
        names = [f"g{i}" for i in range(5)]
        rows, cols = uptrend.origin_features(full(s, d), target_table(s, d), group_table(s, d), names)
        return boosted_forecast(rows, cols, "breadth_target", **SPAN)
    return memo("breadth", s, d, build)


query("f09_boosted_breadth_all")(lambda s, d: out(breadth(s, d), ["forecast_breadth"], 5).select("position", "forecast_breadth", "train_rows", "fit_through"))


def adapted(s, d):
    """The scored panel with the forecast of breadth that sets the cap."""
    f = breadth(s, d).select(*BYK, F.round("forecast_breadth", 9).alias("forecast_breadth"))
    return scores(s, d).drop("forecast_breadth").join(f, BYK)


def cap():
    return F.coalesce(H.cap_graduated("forecast_breadth", LO, HI, 0.42, 0.56), F.lit(LO))


def ledger(s, d):
    def build():
        names = [c.name for c in ablation.family_models(uptrend.UPTREND, X.FAMILIES)]
        # the study reads the scores in many branches
        scored = memo("rescored", s, d, lambda: ablation.rescored(adapted(s, d).where(F.col("position") > GRAPH), ablated(s, d), E.frozen_graph(brand_table(s, d), upto=GRAPH), names))
        return ablation.study(scored, {**WINDOWS, **INTERNAL}, ["early_tuning", "late_tuning", "validation"], k=LO, cap=cap(), adapt=ADAPT,
                              bands={"core": (1, 5), "middle": (6, 6), "tail": (7, 8)})
    return memo("ablation_ledger", s, d, build)


query("n13_family_ablation")(lambda s, d: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id"))(ledger(s, d)))

GRID = {"down_threshold": [0.5, 0.52, 0.55], "down_margin": [0.0, 0.02], "stress_trigger": [0.4, 0.5], "replacement_margin": [0.02], "max_replacements": [0, 2]}
FIXED = dict(min_cap=LO, max_down_share=0.3, regime_bonus=0.05, shock_bonus=0.03, hard_threshold=0.6)
FALLBACK = {"down_threshold": 0.55, "down_margin": 0.0, "stress_trigger": 0.5, "max_replacements": 0}


def searched(s, d):
    def build():
        return adaptive.search(adapted(s, d), K.grid_frame(s, GRID), {**WINDOWS, **INTERNAL}, list(INTERNAL), cap=cap(), hi=HI, replacement_hi=2, min_down_calls=3,
                               min_down_precision=0.5, min_internal_calls=1, min_internal_precision=0.5, **FIXED)
    return memo("adaptive_search", s, d, build)


def chosen_calls(s, d):
    def build():
        return adaptive.apply_chosen(adapted(s, d), adaptive.choose(searched(s, d), FALLBACK), cap=cap(), hi=HI, replacement_hi=2, **FIXED)
    return memo("adaptive_chosen", s, d, build)


query("n02_adaptive_search")(lambda s, d: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id"))(searched(s, d)))
query("n02_adaptive_calls")(lambda s, d: out(chosen_calls(s, d), ["p_up_base", "p_down_adj", "risk_adjusted_score", "confidence", "regime_stress"]).drop("panel_id"))
query("n02_adaptive_summary")(lambda s, d: _summary(chosen_calls(s, d)))


def _summary(calls):
    c = T.in_windows(calls, {**WINDOWS, **INTERNAL})
    m = I.summarize(c, ["window", "selection_mode"])
    b = J.block_bootstrap(I.monthly(c, ("window",)), F.sum("hits") / F.sum("calls"), by=("window",))
    return out(m.join(b.select("window", "p10", "p50", "p90"), "window"), ["accuracy", "down_precision", "p10", "p50", "p90"])


def n01(s, d):
    """Model, graph, prior and top calls on all features: from the first origin at which the frozen graph (changes up to 48) is known."""
    m = models(s, d).where("position >= 50").select(*KEYS, "y_true", F.col("p").alias("p_raw"), "fit_through")
    g = E.propagate(m, E.frozen_graph(brand_table(s, d), upto=48), p="p_raw", out="p_up_raw")
    prior = G.available_rate(target_table(s, d), n=48, min_labels=24).select(*KEYS, "prior")
    b = G.prior_blend(g.join(prior, KEYS, "left")).where("prior is not null")
    return H.top_k(b.withColumn("ready", F.lit(True)), "p_up", 5)


query("n01_full_uptrend")(lambda s, d: out(n01(s, d), ["p_up", "p_raw"], 5).select("series_id", "position", "rank", "p_up", "p_raw", "y_true", "fit_through"))


# ---- audits and studies on the adaptive selection -----------------------------------


def judged(s, d):
    """Calls of the adaptive selection and of the base selection with every method's probability of being right."""
    def build():
        from .metrics import calls

        live = calls(s, d).select(*KEYS, "y_true", "direction", "rank", "confidence", "regime_label").withColumn("model", F.lit("adaptive"))
        base = H.top_k(scores(s, d), "p_up", LO).select(*KEYS, "y_true", "direction", "rank", F.col("p_up").alias("confidence"), "regime_label").withColumn("model", F.lit("base"))
        both = live.unionByName(base)
        return correctness.candidates(both, lo=14, hi=82, by=("panel_id", "model"))
    return memo("judged", s, d, build)


def audited(s, d, name):
    t = correctness.audit(judged(s, d), WINDOWS, models=["model"], reps=200)[name]
    return out(t, [c for c, k in t.dtypes if k == "double"], 5)


query("l11_methods")(lambda s, d: out(judged(s, d), ["score", "score_in_window", "global_cohort", "rank_cohort", "regime_cohort", "rank_regime_cohort", "platt_score_rank", "isotonic_score"], 5).drop("panel_id", "confidence"))
for _t in ("comparison", "reliability", "slices", "coverage", "bootstrap", "decision"):
    query(f"l11_{_t}")(lambda s, d, t=_t: audited(s, d, t))

POLICIES = {"current": (0.52, 0.01), "strict": (0.55, 0.05), "loose": (0.50, 0.0)}


def robust(s, d):
    fixed = {k: v for k, v in ADAPT.items() if k not in ("hi", "down_threshold", "down_margin", "max_replacements")}
    return robustness.study(adapted(s, d), T.sudden_drops(target_table(s, d), **SHOCK), POLICIES, WINDOWS, max_budget=3, cap=cap(), hi=HI, **fixed)


query("k10_robustness")(lambda s, d: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id"))(robust(s, d)))

query("j10_existence_tests")(lambda s, d: out(existence_tests(target_table(s, d), reps=200, min_labels=24), ["observed", "null_median", "null_p95", "p_value"], 4).drop("panel_id"))


def seasonal(s, d):
    from .metrics import calls

    return seasonality.study(scores(s, d), calls(s, d), target_table(s, d), WINDOWS, hi=HI + 2, reps=200, n=36, ensemble=(12, 24, 36), min_labels=12)


query("n18_seasonal_summary")(lambda s, d: out(seasonal(s, d)[0], ["accuracy", "delta", "p10", "p50", "p90"]).drop("panel_id"))
query("n18_seasonal_gate")(lambda s, d: seasonal(s, d)[1].drop("panel_id"))

LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def contexts(s, d):
    """The changes each series shows at an origin, one row per series and origin."""
    p = X.diff_context(brand_table(s, d))
    return p.where("size(context) >= 2").select("panel_id", "series_id", "position", "context")


def external_rows(s, d):
    def build():
        f = forecasting.forecast_rows(contexts(s, d), forecasting.drift(LEVELS), min_context=6)
        e = Z.quantiles_to_p(f, LEVELS)
        a = scores(s, d).where("ready").select(*KEYS, F.col("p_up").alias("p_active"), "y_true")
        return external.calibrated(e, a, lo=16, hi=82, frozen_after=50, tuning=WINDOWS["tuning"])
    return memo("external", s, d, build)


def external_tables(s, d, name):
    from .metrics import calls

    t = external.evaluate(external_rows(s, d), calls(s, d), WINDOWS, hi=HI + 2, reps=200)[name]
    return out(t, [c for c, k in t.dtypes if k == "double"], 5).drop("panel_id")


query("f23_batched_forecasts")(lambda s, d: forecasting.errors_by_origin(forecasting.forecast_rows(contexts(s, d), forecasting.drift(LEVELS), min_context=6)).select("position", "rows", "failures"))
query("n08_external_scores")(lambda s, d: out(external_rows(s, d), ["p_external", "p_calibrated", "p_active", "p_blend"], 5).select("series_id", "position", "p_external", "p_calibrated", "p_active", "p_blend", "status", "active_weight"))
for _t in ("metrics", "diversity", "matched", "gate"):
    query(f"n08_external_{_t}")(lambda s, d, t=_t: external_tables(s, d, t))


# ---- local, shrunk and interaction models ---------------------------------------------

PENALTIES = [0.1, 0.25, 1.0]


def local_path(s, d):
    return memo("local_path", s, d, lambda: localpath.fit_local_path(full(s, d), localpath.SETS, PENALTIES, min_rows=24, min_class=8, **SPAN))


def interactions(s, d):
    def build():
        m = V.walk_forward_many(full(s, d), [V.Config(str(c), tuple(uptrend.UPTREND), tuple(uptrend.VARYING), True, c) for c in PENALTIES], **SPAN)
        return m.withColumn("c", F.col("config").cast("double"))
    return memo("interactions", s, d, build)


def _local_inputs(s, d):
    a = models(s, d).where(f"position > {GRAPH}").select(*KEYS, "y_true", F.col("p").alias("p_global"))
    prior = G.available_rate(target_table(s, d), n=48, min_labels=24).select(*KEYS, "prior")
    return a, local_path(s, d), interactions(s, d), E.frozen_graph(brand_table(s, d), upto=GRAPH), prior


def tuned(s, d, which):
    def build():
        a, loc, inter, edges, prior = _local_inputs(s, d)
        found = local_study.tune(a, loc, inter, edges, prior, window=WINDOWS["tuning"], min_rows=[24, 36], weights=[0.25, 0.5], references=[36, 60], k=LO)
        return found[which]
    return memo(f"local_tuned_{which}", s, d, build)


def local_families(s, d):
    def build():
        a, loc, inter, *_ = _local_inputs(s, d)
        return local_study.families(a, loc, inter, tuned(s, d, 1))
    return memo("local_families", s, d, build)


query("f05_local_path")(lambda s, d: out(local_path(s, d), ["p_local"], 5).drop("panel_id"))
query("g16_families")(lambda s, d: out(local_families(s, d), ["p"], 5).drop("panel_id"))
query("n07_local_search")(lambda s, d: out(tuned(s, d, 0), ["accuracy"]).drop("panel_id"))
query("n07_local_frozen")(lambda s, d: out(tuned(s, d, 1), ["accuracy"]).drop("panel_id"))


def _local_evaluation(s, d):
    *_, edges, prior = _local_inputs(s, d)
    t = local_study.evaluate(local_families(s, d), edges, prior, WINDOWS, k=LO, reps=200)
    return out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id")


query("n07_local_evaluation")(_local_evaluation)

# ---- evidence -----------------------------------------------------------------------


def answered(s, d):
    from .metrics import calls

    rows = scores(s, d).where("ready")
    market = breadth(s, d).select(*BYK, (1 - F.col("forecast_breadth")).alias("p_broad_down"))
    return answers.score(rows, rows.select(*KEYS, F.col("p_up_raw").alias("p_up")), calls(s, d), market, hi=HI + 2, reps=200)


query("l14_answer_uses")(lambda s, d: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id"))(answered(s, d)))
query("k12_interpretation")(lambda s, d: answers.interpret(answered(s, d)).drop("panel_id"))
_DOWNS = ["p_down_global", "p_down_local", "p_down_pattern", "p_down_prior"]
cte("t_components", " union all ".join(f"select '{c}' as component, {c} as p, 1 - y as o from t_scores where ready and y is not null and {c} is not null" for c in _DOWNS))
_EDGES = [0.0, 0.5, 0.6, 0.65, 0.7, 0.8, 1.0]
_COMPONENT_SQL = {
    "summary": f"""
with a as (select component, (sum(case when o = 1 then r end) - np * (np + 1) / 2) / nullif(np * (n - np), 0) as auc from (
  select *, rank() over (partition by component order by p) + (count(*) over (partition by component, p) - 1) / 2.0::double as r, sum(o) over (partition by component) as np, count(*) over (partition by component) as n from t_components) group by component, np, n),
b as (select component, sum(n * abs(p - o)) / sum(n) as ece from (select component, least(floor(p * 10), 9) as b, count(*) as n, avg(p) as p, avg(o) as o from t_components group by 1, 2) group by 1)
select c.component, count(*) as n, {q6('max(a.auc)', 5)} as auc, {q6('avg((p - o) * (p - o))', 5)} as brier, {q6('max(b.ece)', 5)} as ece, {q6('avg(p)', 5)} as mean, {q6('avg(o)', 5)} as base_rate, {q6('quantile_cont(p, 0.95)', 5)} as p95
from t_components c join a on a.component = c.component join b on b.component = c.component group by 1""",
    "reliability": f"""
select component, {' + '.join(f'(p >= {e}::double)::int' for e in _EDGES[1:-1])} as bucket, count(*) as calls, {q6('avg(p)', 5)} as mean_probability, {q6('avg(o)', 5)} as observed,
 {q6(wq('sum(o)', 'count(*)', I.Z_TWO_SIDED_95, '-'), 5)} as wilson_low, {q6(wq('sum(o)', 'count(*)', I.Z_TWO_SIDED_95, '+'), 5)} as wilson_high, {q6(wq('sum(o)', 'count(*)', I.Z_ONE_SIDED_95, '-'), 5)} as wilson_lcb,
 {q6('avg(p) - avg(o)', 5)} as gap from t_components group by 1, 2"""}
for _i, _n in enumerate(("summary", "reliability")):
    query(f"l10_component_{_n}", _COMPONENT_SQL[_n])(lambda s, d, i=_i: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"], 5).drop("panel_id"))(
        answers.components(scores(s, d).where("ready").withColumn("down", 1 - F.col("y_true")), _DOWNS, "down")[i]))
_CEILING_SQL = {
    "baselines": f"""
with x as (select 'all_calls' as slice, pos, hit as c from t_calls union all select 'same_calls_all_up', pos, y from t_calls union all select 'core', pos, hit from t_calls where rk between 1 and 5
 union all select 'middle', pos, hit from t_calls where rk = 6 union all select 'tail', pos, hit from t_calls where rk between 7 and 8)
select slice, count(*) as calls, sum(c)::bigint as hits, {q6('avg(c)', 5)} as accuracy, count(distinct pos) as months, {q6('count(*)::double / count(distinct pos)', 5)} as calls_per_month from x where c is not null group by 1""",
    "ranks": f'select rk as rank, count(*) as calls, sum(hit)::bigint as hits, {q6("avg(hit)", 5)} as accuracy from t_calls where hit is not null group by 1',
    "drift": f"""select pos as "position", calls, {q6('a', 5)} as accuracy, {q6('p', 5)} as prevalence, case when count(a) over w >= 6 then {q6('avg(a) over w', 5)} end as rolling_accuracy
from (select pos, count(*) as calls, avg(hit) as a, avg(y) as p from t_calls where hit is not null group by 1) window w as (order by pos rows between 11 preceding and current row)""",
    "windows": f"""select "window", count(distinct pos) as months, count(*) as calls, sum(hit)::bigint as hits, {q6('avg(hit)', 5)} as accuracy, sum((dir = 'Up')::int) as up_calls, sum((dir = 'Down')::int) as down_calls,
 coalesce(sum(case when dir = 'Down' then hit end), 0)::bigint as down_hits, {q6("avg(case when dir = 'Down' then hit end)", 5)} as down_precision from t_cw where hit is not null group by 1"""}
for _t in ("baselines", "ranks", "drift", "windows", "bootstrap", "summary", "missing"):
    query(f"l12_ceiling_{_t}", _CEILING_SQL.get(_t))(lambda s, d, t=_t: _ceiling(s, d, t))


def _ceiling(s, d, name):
    from .metrics import calls

    t = answers.ceiling(calls(s, d), WINDOWS, {"core": (1, 5), "middle": (6, 6), "tail": (7, 8)}, reps=200)[name]
    return out(t, [c for c, k in t.dtypes if k == "double"], 5).drop("panel_id")


# ---- parameter studies of the other policies ---------------------------------------------

_RULES = {"no_internal_loss": "early_tuning_hit_delta >= 0 and late_tuning_hit_delta >= 0", "no_validation_loss": "validation_hit_delta >= 0"}
_ORDER = ["-tuning_hit_delta", "-tuning_accuracy"]


def _studies():
    """Name -> (rows, grid, policy, fallback)."""
    from .selectors import controller_input

    c = F.col
    return {
        "n03_directional": (scores, {"threshold": [0.5, 0.54, 0.58], "margin": [0.0, 0.03]}, lambda d, by: H.bidirectional(d, threshold=c("threshold"), margin=c("margin"), k=LO, by=by),
                            {"threshold": 0.58, "margin": 0.03}),
        "n04_risk_gate": (scores, {"penalty": [0.0, 0.1, 0.2, 0.4]}, lambda d, by: H.risk_gate(d, penalty=c("penalty"), k=LO, risk="p_down_global", by=by), {"penalty": 0.0}),
        "n05_controller": (controller_input, {"risk": [0.0, 0.2], "down": [0.0, 0.1], "role": [0.0, 0.05]}, lambda d, by: H.controller(d, risk=c("risk"), down=c("down"), role=c("role"), k=LO, by=by),
                           {"risk": 0.0, "down": 0.0, "role": 0.0}),
    }


def _up_base(s, d):
    return H.top_k(scores(s, d), "p_select", LO)


def policy_search(s, d, name):
    rows, grid, policy, _ = _studies()[name]
    return memo(f"{name}_search", s, d, lambda: policies.search(rows(s, d), K.grid_frame(s, grid), policy, _up_base(s, d), {**WINDOWS, **INTERNAL}, rules=_RULES, order=_ORDER))


def policy_evaluation(s, d, name):
    rows, grid, policy, fallback = _studies()[name]
    calls = policies.apply_chosen(rows(s, d), policy_search(s, d, name), K.grid_frame(s, grid), policy, fallback)
    return policies.evaluate(calls, _up_base(s, d), {**WINDOWS, **INTERNAL}, reps=200)


for _n in ("n03_directional", "n04_risk_gate", "n05_controller"):
    query(f"{_n}_search")(lambda s, d, n=_n: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id"))(policy_search(s, d, n)))
    query(f"{_n}_evaluation")(lambda s, d, n=_n: (lambda t: out(t, [c for c, k in t.dtypes if k == "double"]).drop("panel_id"))(policy_evaluation(s, d, n)))
