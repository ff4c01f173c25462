"""Selection policies: which series are called in each period, and in which direction.

Policies that a program would run as a loop over one month are written as
rankings that are paired by number, so every period (and every candidate of a
parameter grid, through ``by``) is decided at the same time.  A ranking always
has a literal upper bound, which keeps at most that many rows per period in each
map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import BY, clip, col, correct, div, flag, logit, sigmoid, truth, within
from ..functions.ordering import group_quantiles, pct_rank, score_order, top_k as _top_k


def _keys(by):
    return [*by, "position"]


def _w(by, *order):
    return Window.partitionBy(*_keys(by)).orderBy(*order)


def top_k(scores: DataFrame, score: str, k, *, hi: int | None = None, direction: str | None = "Up", by=BY) -> DataFrame:
    """Best ``k`` ready rows per period; ``k`` is a number or a cap column. A cap above ``hi`` is an error, never a cut."""
    limit = k if isinstance(k, int) else hi
    if not limit or limit < 1:
        raise ValueError("a positive cap, or a cap column with its upper bound, is required")
    pool = scores.where(truth(F.col("ready")) & F.col(score).isNotNull())
    c = _top_k(pool, _keys(by), score_order(score), limit)
    if not isinstance(k, int):
        c = c.where(F.col("rank") <= within(k, limit, "cap"))
    c = c.withColumn("score", F.col(score))
    return c if direction is None else c.withColumn("direction", F.lit(direction))


def mark(scores: DataFrame, calls: DataFrame, reason: str = "monthly_cap", by=BY) -> DataFrame:
    """All rows again with accepted, rank and the reason a row was left out."""
    keys = [*_keys(by), "series_id"]
    c = calls.select(*keys, F.col("rank").alias("selection_rank"))
    why = F.when(F.col("selection_rank").isNotNull(), "").when(truth(F.col("ready")), reason).otherwise("insufficient_history")
    return scores.drop("selection_rank").join(c, keys, "left").withColumns({
        "accepted": F.col("selection_rank").isNotNull(), "rejection_reason": why})


# ---- caps -------------------------------------------------------------------


def cap_stress(x, lo: int = 15, hi: int = 20, low: float = 0.35, high: float = 0.75, increases: bool = True):
    f = clip((col(x) - low) / (high - low), 0.0, 1.0)
    f = f if increases else 1.0 - f
    return F.bround(lo + (hi - lo) * f).cast("int")


def cap_binary(x, lo: int = 15, hi: int = 20, threshold: float = 0.65):
    return F.when(truth(col(x) >= threshold), F.lit(hi)).otherwise(F.lit(lo))


def cap_graduated(x, lo: int = 15, hi: int = 20, low: float = 0.52, high: float = 0.68):
    f = clip((col(x) - low) / (high - low), 0.0, 1.0)
    return F.coalesce(F.bround(lo + (hi - lo) * f).cast("int"), F.lit(lo))


def schedule_graduated(x, low: float, high: float, caps=(15, 17, 20)):
    return F.when(truth(col(x) >= high), caps[2]).when(truth(col(x) >= low), caps[1]).otherwise(caps[0])


def schedule_quality(first, second, low: float, high: float, caps=(15, 17, 20)):
    a = truth(col(first) >= low)
    return F.when(a & truth(col(second) >= high), caps[2]).when(a, caps[1]).otherwise(caps[0])


def dynamic_cap(scores: DataFrame, cap, hi: int, *, score: str = "p_select", by=BY) -> DataFrame:
    """Up-only baseline with a cap that changes per period."""
    return top_k(scores.withColumn("cap", cap), score, "cap", hi=hi, by=by)


def fixed_coverage(scores: DataFrame, k: int, w, *, p: str = "p_graph", signal: str = "group_relative_logit", by=BY) -> DataFrame:
    z = logit(F.coalesce(F.col(p), F.col("p_up"))) + col(w) * F.coalesce(F.col(signal), F.lit(0.0)) if not isinstance(w, (int, float)) else \
        logit(F.coalesce(F.col(p), F.col("p_up"))) + float(w) * F.coalesce(F.col(signal), F.lit(0.0))
    return top_k(scores.withColumn("coverage_score", sigmoid(z)), "coverage_score", k, by=by)


# ---- two-directional policies ----------------------------------------------


def down_candidates(scores: DataFrame, *, down_threshold=0.55, down_margin=0.0, stress_trigger=0.5, regime_bonus=0.0, shock_bonus=0.0, hard_threshold=0.8) -> DataFrame:
    """Ready rows with what the regime-adaptive policy weighs: p_up_base, p_down_adj, risk_adjusted_score, confidence, and the flags
    `_cand` (may be called Down) and `_hard` (is, whatever the margin). Numbers may be columns."""
    c = F.col
    num = lambda x: x if not isinstance(x, (int, float)) else F.lit(float(x))
    trigger = num(stress_trigger)
    excess = F.coalesce(clip((c("regime_stress") - trigger) / F.greatest(F.lit(1e-6), 1.0 - trigger), 0.0, 1.0), F.lit(0.0))
    up = clip(F.coalesce(c("p_graph"), c("p_up")), 1e-6, 1 - 1e-6)
    s = scores.withColumns({"_excess": excess, "p_up_base": up, "_sel": clip(F.coalesce(c("p_select"), up), 1e-6, 1 - 1e-6)})
    shock = 0.75 * F.coalesce(c("previous_shock"), F.lit(0.0)) + 0.25 * F.coalesce(c("previous_shock_share"), F.lit(0.0))
    s = s.withColumn("p_down_adj", clip(F.coalesce(c("p_down"), F.lit(0.5)) + num(regime_bonus) * c("_excess") + num(shock_bonus) * shock, 1e-6, 1 - 1e-6))
    hard = c("p_down_adj") >= num(hard_threshold)
    cand = (c("p_down_adj") >= num(down_threshold)) & (c("p_down_adj") >= c("p_up_base") + num(down_margin) - 0.05 * c("_excess"))
    return s.withColumns({
        "_hard": truth(hard), "_cand": truth(cand | hard),
        "risk_adjusted_score": clip(c("_sel") * (1.0 - 0.25 * c("_excess")) - 0.15 * c("p_down_adj"), 1e-6, 1.0),
        "confidence": F.greatest("p_down_adj", "p_up_base"),
    }).where(truth(c("ready")) & c("_sel").isNotNull())


def regime_adaptive(scores: DataFrame, *, cap, hi: int, min_cap: int | None = None, down_threshold=0.55, down_margin=0.0,
                    stress_trigger=0.5, max_down_share=0.3, regime_bonus=0.0, shock_bonus=0.0, hard_threshold=0.8,
                    replacement_margin=0.0, max_replacements=0, replacement_hi: int | None = None, allow_down: bool = True, by=BY) -> DataFrame:
    """Up pool by score, Down flips inside its core, Down replacements of its weakest rows.

    Numeric parameters may be columns, so one job can replay a whole grid.
    ``min_cap`` limits flips to the first rows of the pool when the cap exceeds it.
    ``hi`` bounds the caps and ``replacement_hi`` the replacements of a column (a plain number bounds itself);
    a row beyond its bound is an error.
    """
    c = F.col
    if replacement_hi is None:
        if not isinstance(max_replacements, int):
            raise ValueError("replacement_hi is required where max_replacements is a column")
        replacement_hi = max_replacements
    num = lambda x: x if not isinstance(x, (int, float)) else F.lit(float(x))
    trigger = num(stress_trigger)
    s = scores.withColumns({"cap": within(cap if not isinstance(cap, int) else F.lit(cap), hi, "cap"), "_repl": within(num(max_replacements).cast("int"), replacement_hi, "max_replacements")})
    s = down_candidates(s, down_threshold=down_threshold, down_margin=down_margin, stress_trigger=stress_trigger, regime_bonus=regime_bonus, shock_bonus=shock_bonus, hard_threshold=hard_threshold)
    keys, sid = _keys(by), c("series_id").asc()
    pool = _top_k(s, keys, [c("_sel").desc(), sid], hi, "_pool").where(c("_pool") <= c("cap"))
    core = F.lit(True) if min_cap is None else ((c("cap") <= min_cap) | (c("_pool") <= min_cap))
    whole = Window.partitionBy(*keys)
    # from here on a period holds at most hi rows
    pool = pool.withColumn("_flipable", core & c("_cand") & F.lit(allow_down))
    quota = F.bround(c("cap") * num(max_down_share) * F.greatest(F.lit(0.0), (c("regime_stress") - trigger) / F.greatest(F.lit(1e-6), 1.0 - trigger))).cast("int")
    pool = pool.withColumns({
        "_nhard": F.sum((core & c("_hard")).cast("int")).over(whole),
        "_flip": F.row_number().over(Window.partitionBy(*keys).orderBy(c("_flipable").desc(), c("p_down_adj").desc(), sid)),
        "_weak": F.row_number().over(Window.partitionBy(*keys).orderBy(c("_sel").asc(), sid)),
        "_size": F.count(F.lit(1)).over(whole),
    })
    pool = pool.withColumn("direction", F.when(
        c("_flipable") & (c("_flip") <= F.least(c("cap"), F.greatest(F.coalesce(quota, F.lit(0)), c("_nhard")))), "Down").otherwise("Up"))
    extra = _top_k(s.where(c("_cand") & (c("p_down_adj") >= c("p_up_base") + num(replacement_margin)) & (c("_repl") > 0) & F.lit(allow_down)),
                   keys, [c("p_down_adj").desc(), sid], hi + replacement_hi, "_try")
    extra = extra.join(pool.select(*keys, "series_id"), [*keys, "series_id"], "left_anti")
    extra = extra.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_try"))).where(c("_k") <= c("_repl"))
    taken = extra.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    kept = pool.join(taken, keys, "left").withColumn("_out", F.least(F.coalesce(c("_n"), F.lit(0)), c("_size")))
    size = pool.groupBy(*keys).agg(F.first("_size").alias("_size"))
    extra = extra.join(size, keys).where(c("_k") <= c("_size"))
    cols = [*keys, "series_id", "y_true", "cap", "p_up_base", "p_down_adj", "risk_adjusted_score", "confidence", "regime_stress", "regime_label"]
    calls = kept.where(c("_weak") > c("_out")).select(*cols, "direction", F.lit(False).alias("replacement")).unionByName(
        extra.select(*cols, F.lit("Down").alias("direction"), F.lit(True).alias("replacement")))
    return calls.withColumn("rank", F.row_number().over(_w(by, c("confidence").desc(), sid)))


def with_changes(calls: DataFrame, base: DataFrame, by=BY) -> DataFrame:
    """Rows whose membership or direction differs from a base selection."""
    keys = [*_keys(by), "series_id"]
    a = calls.select(*keys, F.col("direction").alias("_d"))
    b = base.select(*keys, F.col("direction").alias("_b"))
    return a.join(b, keys, "full_outer").select(
        *keys, F.col("_b").isNull().alias("added"), F.col("_d").isNull().alias("removed"),
        truth(F.col("_d") != F.col("_b")).alias("direction_changed"))


def bidirectional(scores: DataFrame, *, threshold: float, margin: float, k: int, p: str = "p_up", by=BY) -> DataFrame:
    """Down where its score is high enough and beats Up by the margin; rank by the chosen score."""
    down = (F.col("p_down") >= threshold) & (F.col("p_down") >= F.col(p) + margin)
    s = scores.where("p_down is not null").withColumns({
        "direction": F.when(down, "Down").otherwise("Up"), "confidence": F.when(down, F.col("p_down")).otherwise(F.col(p))})
    return top_k(s, "confidence", k, direction=None, by=by)


def risk_gate(scores: DataFrame, *, penalty: float, k: int, risk: str = "p_drop", score: str = "p_select", by=BY) -> DataFrame:
    """Subtract the risk percentile from the score of Up candidates."""
    s = pct_rank(scores, _keys(by), risk, "risk_percentile")
    s = s.withColumn("risk_score", F.col(score) - penalty * F.col("risk_percentile"))
    return top_k(s.where((F.col("direction") == "Up") & F.col(risk).isNotNull()), "risk_score", k, by=by)


def force_roles(calls: DataFrame, scores: DataFrame, market: DataFrame, roles: list[str], *, threshold: float,
                breadth: str = "market_breadth_3", score: str = "p_select", by=BY) -> DataFrame:
    """Under stress, ready role series are called Up; the k-th missing one takes the place of the k-th weakest other call."""
    keys = _keys(by)
    order = {r: i for i, r in enumerate(roles)}
    m = market.where(F.col(breadth) <= threshold).select(*keys)
    seat = F.coalesce(*[F.when(F.col("series_id") == r, F.lit(i)) for r, i in order.items()])
    want = scores.where(F.col("series_id").isin(roles) & truth(F.col("ready"))).join(m, keys, "left_semi")
    have = calls.select(*keys, "series_id")
    missing = want.join(have, [*keys, "series_id"], "left_anti").withColumn("_k", F.row_number().over(_w(by, seat)))
    stressed = calls.join(m.withColumn("_s", F.lit(True)), keys, "left")
    is_role = F.col("series_id").isin(roles)
    victims = Window.partitionBy(*keys, is_role).orderBy(F.col(score).asc(), F.col("series_id").asc())
    n = missing.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kept = stressed.withColumn("_v", F.row_number().over(victims)).join(n, keys, "left")
    kept = kept.where(is_role | (F.col("_v") > F.coalesce(F.col("_n"), F.lit(0))))
    kept = kept.withColumns({"forced": truth(is_role & F.col("_s")),
                             "direction": F.when(truth(is_role & F.col("_s")), "Up").otherwise(F.col("direction"))})
    cols = [*keys, "series_id", "y_true", score, "direction", "forced"]
    out = kept.select(*cols).unionByName(missing.withColumns({"direction": F.lit("Up"), "forced": F.lit(True)}).select(*cols))
    return out.withColumn("rank", F.row_number().over(_w(by, F.col(score).desc(), F.col("series_id").asc())))


def controller(scores: DataFrame, *, risk: float, down: float, role: float, k: int, require_risk: bool = True,
               score: str = "p_select", by=BY) -> DataFrame:
    """Score minus risk for Up, plus risk for Down, plus a bonus for listed roles under stress."""
    r = clip(F.coalesce("risk_percentile", F.lit(1.0)), 0.0, 1.0)
    roles = F.transform(F.split("role_list", ","), lambda x: F.trim(x))
    up = F.col("direction") == "Up"
    bonus = F.when(truth(F.col("context_stress")) & F.array_contains(roles, F.col("series_id")) & up, role).otherwise(0.0)
    s = scores.withColumn("controller_score", F.col(score) + F.when(up, -risk * r).otherwise(down * r) + bonus)
    if require_risk:
        s = s.where("risk_percentile is not null")
    return top_k(s.where(truth(F.col("eligible")) & truth(F.col("data_quality_ok"))), "controller_score", k, direction=None, by=by)


def normalized(scores: DataFrame, *, cap: int, core: int, down_threshold: float, stress_trigger: float, hard_threshold: float,
               margin: float = 0.05, max_down: int = 1, by=BY) -> DataFrame:
    """Compare both directions on percentile ranks and allow at most one guarded Down action.

    The action is the best flip inside the core or, if strictly better, the best
    outside series taking the place of the weakest core row.
    """
    keys, c, sid = _keys(by), F.col, F.col("series_id").asc()
    ready = scores.where(truth(c("ready")) & c("p_select").isNotNull() & c("p_down").isNotNull())
    ids = [*keys, "series_id"]
    long = ready.select(*ids, c("p_select").alias("u"), c("p_down").alias("d")).unpivot(ids, ["u", "d"], "_f", "_x")
    r = pct_rank(long, [*keys, "_f"], "_x", "_k").groupBy(*ids).agg(
        F.max(F.when(c("_f") == "u", c("_k"))).alias("up_percentile"), F.max(F.when(c("_f") == "d", c("_k"))).alias("down_percentile"))
    s = ready.join(r, ids).withColumns({
        "_guard": (c("p_down") >= down_threshold) & (truth(c("regime_stress") >= stress_trigger) | (c("p_down") >= hard_threshold)),
        "_adv": c("down_percentile") - c("up_percentile")})
    pool = _top_k(s, keys, [c("p_select").desc(), sid], cap, "_pool")
    flips = pool.where((c("_pool") <= core) & c("_guard") & (c("_adv") >= margin))
    flip = _top_k(flips, keys, [c("_adv").desc(), c("down_percentile").desc(), sid], 1, "_1").select(*keys, c("series_id").alias("flip_id"), c("_adv").alias("flip_adv"))
    weak = _top_k(pool.where(c("_pool") <= core), keys, [c("up_percentile").asc(), sid], 1, "_1").select(
        *keys, c("series_id").alias("victim_id"), c("up_percentile").alias("weak_up"))
    outside = _top_k(s.where(c("_guard")), keys, [c("down_percentile").desc(), sid], cap + 1, "_try").join(
        pool.select(*ids), ids, "left_anti")
    best = _top_k(outside, keys, [c("down_percentile").desc(), sid], 1, "_1").join(weak, keys)
    best = best.withColumn("out_adv", c("down_percentile") - c("weak_up")).where(c("out_adv") >= margin)
    act = weak.select(*keys).join(flip, keys, "left").join(best.select(*keys, c("series_id").alias("new_id"), "victim_id", "out_adv"), keys, "left")
    act = act.withColumn("_use_new", truth(c("out_adv") > F.coalesce(c("flip_adv"), F.lit(float("-inf")))) & F.lit(max_down > 0))
    p = pool.join(act, keys, "left").where(~(truth(c("_use_new")) & (c("series_id") == c("victim_id"))))
    flipped = truth(~c("_use_new") & (c("series_id") == c("flip_id"))) & F.lit(max_down > 0)
    cols = [*ids, "y_true", "up_percentile", "down_percentile"]
    new = best.drop("victim_id", "weak_up").join(act.where("_use_new").select(*keys, c("new_id").alias("series_id")), ids)
    out = p.select(*cols, F.when(flipped, "Down").otherwise("Up").alias("direction"), F.lit(False).alias("replacement")).unionByName(
        new.select(*cols, F.lit("Down").alias("direction"), F.lit(True).alias("replacement")))
    out = out.withColumn("score", F.when(c("direction") == "Down", c("down_percentile")).otherwise(c("up_percentile")))
    return out.withColumn("rank", F.row_number().over(_w(by, c("score").desc(), sid)))


def guarded(calls: DataFrame, *, breadth_gate: float, risk_quantile: float, max_replacements: int, ceiling: float,
            risk: str = "p_extreme_down", p: str = "p_up_base", by=BY) -> DataFrame:
    """Turn the weakest Up calls of a weak-market period to Down.

    The number of high-risk calls bounds how many are turned; which ones is
    decided by the Up score alone.
    """
    keys, c = _keys(by), F.col
    q = group_quantiles(calls, keys, risk, {"_thr": risk_quantile}, buckets=4)
    d = calls.join(q, keys, "left")
    weak = truth((c("direction") == "Up") & (c(p) < ceiling))
    n_risk = F.sum(truth(c(risk) >= c("_thr")).cast("int")).over(Window.partitionBy(*keys))
    order = F.row_number().over(Window.partitionBy(*keys, weak).orderBy(c(p).asc(), c(risk).desc_nulls_last(), c("series_id").asc()))
    turned = truth(weak & (order <= F.least(F.lit(max_replacements), n_risk)) & (c("forecast_breadth") < breadth_gate))
    return d.withColumn("policy_replaced", turned).withColumn(
        "policy_direction", F.when(c("policy_replaced"), "Down").otherwise(c("direction"))).drop("_thr")


def flexible(scores: DataFrame, *, floor: float, margin: float, extra: float, optional: bool, base: int = 15, hi: int = 20,
             max_down: int = 5, cap="cap", by=BY) -> DataFrame:
    """Stronger direction per series, at most ``max_down`` Downs, ``base`` calls and optional extras above a floor.

    Scores are in rank order, so "stop at the first weak extra" and "drop weak
    extras" pick the same rows.
    """
    keys, c, sid = _keys(by), F.col, F.col("series_id").asc()
    down = (c("down_cal") >= floor) & (c("down_cal") >= c("up_cal") + margin)
    s = scores.where(truth(c("ready")) & c("up_cal").isNotNull() & c("down_cal").isNotNull()).withColumns({
        "direction": F.when(down, "Down").otherwise("Up"), "call_score": F.when(down, c("down_cal")).otherwise(c("up_cal"))})
    part = Window.partitionBy(*keys, "direction").orderBy(c("call_score").desc(), sid)
    # per direction at most hi (Up) or max_down (Down) rows can be used
    s = s.withColumn("_d", F.row_number().over(part)).where(c("_d") <= F.lit(max(hi, max_down)))
    s = s.where((c("direction") == "Up") | (c("_d") <= max_down))
    s = s.withColumn("rank", F.row_number().over(_w(by, c("call_score").desc(), sid)))
    limit = within(cap if not isinstance(cap, int) else F.lit(cap), hi, "cap")
    keep = c("rank") <= limit
    if optional:
        keep = keep & ((c("rank") <= base) | (c("call_score") >= extra))
    kept = truth(c("accepted"))
    source = F.when(c("direction") == "Up", "up").when(kept & (c("base_direction") == "Down"), "down_retained").when(kept, "down_overlay").otherwise("down_external")
    return s.where(keep).withColumn("selection_source", source).drop("_d")


def compete(scores: DataFrame, cap, hi: int, by=BY) -> DataFrame:
    """Every series enters its stronger direction; no quota."""
    up, down = F.col("joint_p_up"), F.col("joint_p_down")
    s = scores.where(up.isNotNull() & down.isNotNull()).withColumns({
        "direction": F.when(down > up, "Down").otherwise("Up"), "call_score": F.greatest(up, down)})
    return top_k(s, "call_score", cap, hi=hi, direction=None, by=by)


def insert_down(scores: DataFrame, *, cap, hi: int, margin: float, floor: float, max_down: int = 5, overlay: bool = True,
                insert: bool = True, score: str = "p_select", by=BY) -> DataFrame:
    """Up pool, Down flips inside it, then outside Downs displacing the weakest Up calls.

    The k-th best outside candidate meets the k-th weakest remaining Up call; both
    sequences are monotone, so the first pair that fails ends the rest.
    """
    keys, c, sid = _keys(by), F.col, F.col("series_id").asc()
    s = scores.where(truth(c("ready")) & c(score).isNotNull()).withColumn("_cap", within(F.lit(cap) if isinstance(cap, int) else cap, hi, "cap"))
    s = s.withColumn("_base_dir", F.coalesce(c("base_direction"), F.lit("Up")))
    pool = _top_k(s, keys, [c(score).desc(), sid], hi, "_pool").where(c("_pool") <= c("_cap"))
    strong = truth((c("down_cal") >= c("up_cal") + margin) & (c("down_cal") >= floor))
    flipped = (c("_base_dir") == "Up") & strong & F.lit(overlay)
    pool = pool.withColumns({"_flip": flipped, "is_down": flipped | (c("_base_dir") == "Down")})
    per = pool.groupBy(*keys).agg(F.sum(c("_flip").cast("int")).cast("int").alias("flips"))
    cand = _top_k(s.where(strong & F.lit(insert)), keys, [c("down_cal").desc(), sid], hi + max_down, "_try").join(
        pool.select(*keys, "series_id"), [*keys, "series_id"], "left_anti")
    cand = cand.withColumn("_k", F.row_number().over(_w(by, c("_try")))).where(c("_k") <= max_down)
    weak = pool.where(~c("is_down")).withColumn("_k", F.row_number().over(_w(by, c("up_cal").asc_nulls_last(), c(score).desc(), sid))).select(
        *keys, "_k", c("series_id").alias("victim_id"), c("up_cal").alias("_vu"), c("y_true").alias("victim_y"))
    pairs = cand.join(weak, [*keys, "_k"]).join(per, keys)
    ok = (c("down_cal") >= c("_vu") + margin) & (c("_k") <= max_down - c("flips"))
    good = F.min(truth(ok).cast("int")).over(_w(by, c("_k")).rowsBetween(Window.unboundedPreceding, 0)) == 1
    ins = pairs.withColumn("_ok", good).where(c("_ok"))
    cols = [*keys, "series_id", "y_true", "up_cal", "down_cal"]
    null = F.lit(None)
    out = pool.join(ins.select(*keys, c("victim_id").alias("series_id")), [*keys, "series_id"], "left_anti").select(
        *cols, F.when(c("is_down"), "Down").otherwise("Up").alias("direction"),
        F.when(c("_flip"), "overlay_flip").otherwise("up").alias("source"),
        F.when(c("_flip"), c("series_id")).alias("victim_id"), F.when(c("_flip"), c("y_true")).alias("victim_correct"))
    out = out.unionByName(ins.select(*cols, F.lit("Down").alias("direction"), F.lit("external_insert").alias("source"),
                                     "victim_id", c("victim_y").alias("victim_correct")))
    return out.withColumn("call_correct", correct())


def designs(scores: DataFrame, production: DataFrame, *, cap: int, threshold: float, insert_cap: int, by=BY) -> DataFrame:
    """Four architectures side by side: A production, B limited insertion, C independent pools, D unified score."""
    keys, c, sid = _keys(by), F.col, F.col("series_id").asc()
    cols = [*keys, "series_id", "y_true", "direction"]
    ready = scores.where(truth(c("ready")))
    pool = _top_k(ready, keys, [c("p_select").desc(), sid], cap, "_pool")
    # at most cap + the insertions wanted are looked at, of which at most cap lie in the pool
    outside = _top_k(ready.where(c("p_down") >= threshold), keys, [c("p_down").desc(), sid], cap + max(insert_cap, cap), "_try").join(
        pool.select(*keys, "series_id"), [*keys, "series_id"], "left_anti").withColumn("_k", F.row_number().over(_w(by, c("_try"))))
    n = outside.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(cap)).cast("int").alias("_n"))
    tag = lambda d, name: d.select(*cols).withColumn("design", F.lit(name))
    a = tag(production, "A")
    prod = production.withColumn("_r", F.row_number().over(_w(by, c("p_select").desc(), sid))).join(n, keys, "left")
    b = prod.where(c("_r") <= cap - F.least(F.lit(insert_cap), F.coalesce(c("_n"), F.lit(0))))
    b = tag(b, "B").unionByName(tag(outside.where(c("_k") <= insert_cap).withColumn("direction", F.lit("Down")), "B"))
    nd = F.least(F.coalesce(c("_n"), F.lit(0)), F.lit(cap // 2))
    cu = pool.join(n, keys, "left").where(c("_pool") <= cap - nd).withColumn("direction", F.lit("Up"))
    cd = outside.where(c("_k") <= cap // 2).withColumn("direction", F.lit("Down"))
    uni = ready.withColumns({"direction": F.when(c("p_down") > c("p_up"), "Down").otherwise("Up"), "_u": F.greatest("p_down", "p_up")})
    return a.unionByName(b).unionByName(tag(cu, "C")).unionByName(tag(cd, "C")).unionByName(
        tag(_top_k(uni, keys, [c("_u").desc(), sid], cap, "_r"), "D"))


def matched(scores: DataFrame, calls: DataFrame, *, hi: int, p: str = "p_blend", by=BY) -> DataFrame:
    """As many calls per period as the reference selection made, ranked by distance from 0.5."""
    k = calls.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias("_k"))
    s = scores.join(k, _keys(by)).withColumns({
        "certainty": F.abs(F.col(p) - 0.5), "direction": F.when(F.col(p) >= 0.5, "Up").otherwise("Down")})
    return top_k(s.where("y_true is not null"), "certainty", "_k", hi=hi, direction=None, by=by).drop("_k")


def prior_only(targets: DataFrame, *, n: int = 48, k: int = 15, mode: str = "up", min_labels: int = 24, lag: int = 2, by=BY) -> DataFrame:
    """Rank by the trailing rate alone, calling Up, or the majority direction by its strength."""
    from .priors import calendar_rate

    t = calendar_rate(targets, n=n, lag=lag, min_labels=min_labels, by=by).withColumn("ready", F.col("prior").isNotNull() & F.col("y_true").isNotNull())
    if mode == "up":
        return top_k(t, "prior", k, by=by)
    t = t.withColumns({"direction": F.when(F.col("prior") >= 0.5, "Up").otherwise("Down"), "strength": F.greatest(F.col("prior"), 1 - F.col("prior"))})
    return top_k(t, "strength", k, direction=None, by=by)


def candidate_scores(scores: DataFrame, columns: dict[str, str], k, *, hi: int, by=BY) -> DataFrame:
    """One selection per named score, all at the same cap, in one job."""
    pairs = F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(c).cast("double").alias("candidate_score")) for n, c in columns.items()])
    s = scores.withColumn("_x", F.explode(pairs)).select("*", "_x.candidate", "_x.candidate_score").drop("_x")
    return top_k(s, "candidate_score", k, hi=hi, by=(*by, "candidate"))


def oracles(universe: DataFrame, calls: DataFrame, targets: DataFrame, windows: dict, *, hi: int, by=BY) -> DataFrame:
    """Hits that hindsight would have reached with the same number of calls, per period."""
    from .targets import in_windows

    keys, c = _keys(by), F.col
    w = in_windows(universe, windows)
    k = calls.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("cap"), F.sum(correct()).alias("production"),
                                 F.sum(flag(c("y_true") == 1.0)).alias("_up"), F.sum(flag(c("y_true") == 0.0)).alias("_dn"))
    longrun = targets.groupBy(*by, "series_id").agg(F.avg("y_true").alias("longrun"))
    local = in_windows(targets, windows).groupBy(*by, "window", "series_id").agg(F.avg("y_true").alias("inwindow"))
    u = w.join(longrun, [*by, "series_id"]).join(local, [*by, "window", "series_id"]).join(k, keys)
    picks = candidate_scores(u.withColumn("ready", F.lit(True)), {"longrun": "longrun", "window": "inwindow"}, "cap", hi=hi, by=by)
    p = picks.groupBy(*keys, "candidate").agg(F.sum("y_true").alias("ups"), F.sum(1 - c("y_true")).alias("downs"))
    m = u.groupBy(*keys, "window").agg(F.max("cap").alias("cap"), F.avg("y_true").alias("breadth"), F.sum("y_true").alias("_ones"),
                                       F.max("production").alias("production"), F.max("_up").alias("_up"), F.max("_dn").alias("_dn"))
    q = p.groupBy(*keys).agg(*[F.max(F.when(c("candidate") == n, c(x))).alias(f"{n}_{x}") for n in ("longrun", "window") for x in ("ups", "downs")])
    broad = c("breadth") < 0.5
    return m.join(q, keys).select(
        *keys, "window", "cap", "breadth", broad.alias("broad_down"), "production", c("longrun_ups").alias("longrun_drift"),
        c("window_ups").alias("window_drift"), F.when(broad, c("_dn")).otherwise(c("_up")).alias("breadth_timing"),
        F.when(broad, c("longrun_downs")).otherwise(c("longrun_ups")).alias("longrun_plus_timing"),
        F.least(c("cap").cast("double"), c("_ones")).alias("perfect_up"))


def flip(months: DataFrame, signal: str, q: float, *, min_n: int = 24, by=BY) -> DataFrame:
    """Reverse all calls of a period whose signal exceeds its own earlier (1-q) quantile."""
    from .features import expanding_threshold

    m = expanding_threshold(months, signal, q, min_n=min_n, by=by).withColumn("flip", truth(F.col(signal) >= F.col("threshold")))
    return m.withColumn("gain", F.when(F.col("flip"), F.col("flipped_hits") - F.col("hits")).otherwise(0))


def swap(scores: DataFrame, calls: DataFrame, *, margin: float = 0.0, floor: float = 0.0, down: str = "p_down", up: str = "p_up", by=BY) -> DataFrame:
    """Most bearish outsider against the weakest pick of each period."""
    keys = _keys(by)
    pick = F.struct(F.col("series_id"), F.col("y_true"), F.col(up).alias("p"))
    weak = calls.groupBy(*keys).agg(F.min_by(pick, F.struct(F.col(up), F.col("series_id"))).alias("v"))
    out = scores.where(truth(F.col("ready"))).join(calls.select(*keys, "series_id"), [*keys, "series_id"], "left_anti")
    o = F.struct(F.col("series_id"), F.col("y_true"), F.col(down).alias("p"))
    best = out.groupBy(*keys).agg(F.min_by(o, F.struct(-F.col(down), F.col("series_id"))).alias("o"))
    j = weak.join(best, keys).where((F.col("o.p") >= floor) & (F.col("o.p") >= F.col("v.p") + margin))
    return j.select(*keys, F.col("v.series_id").alias("victim_id"), F.col("o.series_id").alias("outsider_id"),
                    (1 - F.col("o.y_true") - F.col("v.y_true")).alias("hit_delta"))


def forecast_horizons(panel: DataFrame, hs, *, n: int = 24, min_labels: int = 12, k: int = 5, lag: int = 1, by=BY) -> DataFrame:
    """Direct selections for several horizons; a longer horizon waits longer for its labels."""
    from functools import reduce

    from .priors import calendar_rate
    from .targets import horizon_targets

    parts = []
    for h in hs:
        t = calendar_rate(horizon_targets(panel, h, by), n=n, lag=lag + h, min_labels=min_labels, by=by)
        parts.append(t.withColumn("fit_through", F.col("position") - lag - h))
    t = reduce(lambda a, b: a.unionByName(b), parts)
    c = top_k(t.withColumn("ready", F.col("prior").isNotNull()), "prior", k, by=(*by, "horizon"))
    return c.withColumn("forecast_month", F.add_months("month", F.col("horizon")))
