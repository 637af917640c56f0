"""Registered queries: information coefficients, inference, selection and the feature lab."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import ic as ics
from tidepanel.operators import interactions as inter
from tidepanel.operators import selection as sel
from tidepanel.plans.panel import PANEL, T, avg, dev, panel, rank_pct, roll
from tidepanel.registry import query

c = F.col

FEATURES = ["ret_pct_1", "ret_pct_5", "ret_pct_21", "ret_pct_63", "std_21", "std_63", "rel_volume_21", "pct_from_high"]

_WIDE = f"""{PANEL}, wide AS (
  SELECT dt, ticker, {', '.join(f'(close / lag(close, {k}) OVER {T} - 1) * 100.0 AS ret_pct_{k}' for k in (1, 5, 21, 63))}, {dev('x', 21)} AS std_21, {dev('x', 63)} AS std_63,
    volume / {avg('volume', 21, 10)} AS rel_volume_21, close / {roll('max({x})', 'close', 252, 126)} - 1 AS pct_from_high, lead(close, 21) OVER {T} / close - 1 AS y FROM panel
)"""
_LONG = f"""{_WIDE}, lng AS (SELECT dt, ticker, feature, value, y FROM (UNPIVOT wide ON {', '.join(FEATURES)} INTO NAME feature VALUE value) WHERE y IS NOT NULL
), rk AS (SELECT dt, feature, value, y, {rank_pct('value', 'dt, feature')} AS rx, {rank_pct('y', 'dt, feature')} AS ry FROM lng
), ic AS (SELECT dt, feature, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic, count(*) AS n FROM rk GROUP BY 1, 2 HAVING count(*) >= 3)"""


def wide(spark, sf_dir):
    """Eight base features and y, the forward return over 21 bars."""
    df = panel(spark, sf_dir)
    made = {f"ret_pct_{k}": (w.ratio(c("close"), w.lag("close", k)) - 1) * 100.0 for k in (1, 5, 21, 63)} | {f"std_{n}": w.std(c("x"), n) for n in (21, 63)}
    made |= {"rel_volume_21": c("volume") / w.mean(c("volume"), 21, 10), "pct_from_high": c("close") / w.most(c("close"), 252, 126) - 1, "y": w.ratio(F.lead("close", 21).over(w.history()), c("close")) - 1}
    return df.withColumns(made).select("dt", "ticker", *FEATURES, "y")


def daily(spark, sf_dir):
    return ics.daily_ic(wide(spark, sf_dir), FEATURES, "y")


@query("c02_daily_ic", f"WITH {_LONG} SELECT dt, feature, round(ic, 6) + 0.0 AS ic, n FROM ic")
def daily_ic(spark, sf_dir):
    return daily(spark, sf_dir).select("dt", "feature", w.rounded("ic"), "n")


@query("flagship", f"WITH {_LONG} SELECT dt, round(ic, 6) + 0.0 AS ic, n FROM ic WHERE feature = 'ret_pct_21'")
def flagship(spark, sf_dir):
    """Weekly rank correlation of 21-bar momentum with the next 21-bar return."""
    return ics.daily_ic(wide(spark, sf_dir), ["ret_pct_21"], "y").select("dt", w.rounded("ic"), "n")


_POOLED = f"""
WITH {_WIDE}, lng AS (SELECT feature, value, y FROM (UNPIVOT wide ON {', '.join(FEATURES)} INTO NAME feature VALUE value) WHERE y IS NOT NULL
), rk AS (SELECT feature, {rank_pct('value', 'feature')} AS rx, {rank_pct('y', 'feature')} AS ry FROM lng)
SELECT feature, round(coalesce(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 0), 6) + 0.0 AS ic, count(*) AS n FROM rk GROUP BY 1
"""


@query("c01_pooled_ic", _POOLED)
def pooled_ic(spark, sf_dir):
    return ics.pooled_ic(wide(spark, sf_dir), FEATURES, "y").select("feature", w.rounded("ic"), "n")


def _nw(weight: str) -> str:
    lags = " + ".join(f"CASE WHEN n - 1 > {k} THEN 2 * {1 - k / 6!r} * coalesce(s{k}, 0) / n ELSE 0 END" for k in range(1, 6))
    return f"""{_LONG}, w0 AS (SELECT *, {weight} AS w FROM ic WHERE ic IS NOT NULL
), w1 AS (SELECT *, count(*) OVER f AS n_, sum(w * ic) OVER f / sum(w) OVER f AS m, sum(w) OVER f AS sw FROM w0 WINDOW f AS (PARTITION BY feature)
), w2 AS (SELECT *, ic - m AS e, w * n_ / sw AS v FROM w1
), w3 AS (SELECT *, {', '.join(f'lag(e, {k}) OVER o AS e{k}' for k in range(1, 6))} FROM w2 WINDOW o AS (PARTITION BY feature ORDER BY dt)
), w4 AS (SELECT feature, max(n_) AS n, max(m) AS ic_mean, sum(v * e * e) AS s0, {', '.join(f'sum(v * e * e{k}) AS s{k}' for k in range(1, 6))} FROM w3 GROUP BY 1
), nw AS (SELECT feature, ic_mean, n, CASE WHEN n < 3 THEN 0 ELSE ic_mean / sqrt(greatest((s0 / n + {lags}) / n, 1e-20)) END AS t_nw FROM w4)"""


@query("c04_c05_newey_west", f"WITH {_nw('1.0')} SELECT feature, round(ic_mean, 6) + 0.0 AS ic_mean, round(t_nw, 5) + 0.0 AS t_nw, n FROM nw")
def newey_west(spark, sf_dir):
    return ics.newey_west(daily(spark, sf_dir)).select("feature", w.rounded("ic_mean"), w.rounded("t_nw", 5), "n")


_DECAYED = _nw("exp(-ln(2) / 365.0 * datediff('day', dt, max(dt) OVER (PARTITION BY feature)))")


@query("c12_decayed_newey_west", f"WITH {_DECAYED} SELECT feature, round(ic_mean, 6) + 0.0 AS ic_mean, round(t_nw, 5) + 0.0 AS t_nw, n FROM nw")
def decayed(spark, sf_dir):
    return ics.newey_west(daily(spark, sf_dir), half_life=365.0).select("feature", w.rounded("ic_mean"), w.rounded("t_nw", 5), "n")


# Student's t by its finite series, which holds for whole degrees of freedom

_T = "atan(abs(t_nw) / sqrt(n - 1))"
_ODD = "list_sum(list_transform(range(0, CAST((n - 2) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos({a}), 2 * k + 1)))".format(a=_T)
_EVEN = "list_sum(list_transform(range(0, CAST((n - 1) // 2 AS BIGINT)), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(cos({a}), 2 * k)))".format(a=_T)
_P = f"CASE WHEN n <= 2 THEN 1.0 WHEN (n - 1) % 2 = 1 THEN 1 - 2 / pi() * ({_T} + sin({_T}) * coalesce({_ODD}, 0)) ELSE 1 - sin({_T}) * {_EVEN} END"

_FORMATION = f"""
WITH {_nw('1.0')}, tp AS (SELECT *, greatest(0, {_P}) AS p_value FROM nw
), dd AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS total FROM (SELECT DISTINCT dt FROM ic)
), bl AS (SELECT dt, greatest(2, floor(total / 100.0)) AS blocks, ceil((i + 1) * greatest(2, floor(total / 100.0)) / total) - 1 AS block FROM dd
), bs AS (SELECT feature, block, max(blocks) AS blocks, avg(ic) AS mean, CASE WHEN count(*) > 2 THEN avg(ic) / greatest(stddev_samp(ic) / sqrt(count(*)), 1e-10) END AS t FROM ic JOIN bl USING (dt) GROUP BY 1, 2
), bc AS (
  SELECT feature, count(*) FILTER (sign(mean) = sign(ic_mean) OR ic_mean = 0) / max(blocks) AS consistency, max(blocks) AS blocks,
    count(*) FILTER ((sign(mean) = sign(ic_mean) OR ic_mean = 0) AND (abs(mean) >= 0.01 OR abs(coalesce(t, 0)) >= 1.5)) AS block_passes FROM bs JOIN nw USING (feature) GROUP BY 1
), bh AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS r, count(*) OVER () AS total FROM tp
), ad AS (SELECT *, least(1, min(p_value * total / r) OVER (ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM bh)
SELECT feature, round(ic_mean, 6) + 0.0 AS ic_mean, round(t_nw, 5) + 0.0 AS t_nw, n, round(p_value, 6) + 0.0 AS p_value, round(p_adjusted, 6) + 0.0 AS p_adjusted, p_adjusted <= 0.1 AS fdr_reject,
  round(consistency, 6) + 0.0 AS consistency, block_passes, p_adjusted <= 0.1 AND abs(ic_mean) >= 0.02 AND consistency >= 0.6 AND block_passes >= least(2, blocks) AS approved
FROM ad JOIN bc USING (feature)
"""


@query("l01_c06_c09_formation", _FORMATION)
def formation(spark, sf_dir):
    out = ics.formation(daily(spark, sf_dir), block=100)
    return out.select("feature", w.rounded("ic_mean"), w.rounded("t_nw", 5), "n", w.rounded("p_value"), w.rounded("p_adjusted"), "fdr_reject", w.rounded("consistency"), "block_passes", "approved")


_SUMMARY = f"""
WITH {_LONG} SELECT feature, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) + 0.0 AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS ir, round(avg((ic > 1e-12)::INT), 6) + 0.0 AS hit_rate,
  round(avg(abs(ic)), 6) + 0.0 AS abs_mean, count(*) AS n FROM ic WHERE ic IS NOT NULL GROUP BY 1
"""


@query("c10_ic_summary", _SUMMARY)
def ic_summary(spark, sf_dir):
    return ics.summary(daily(spark, sf_dir)).select("feature", *(w.rounded(k) for k in ("ic_mean", "ic_std", "ir", "hit_rate", "abs_mean")), "n")


_ROLLED = f"WITH {_LONG} SELECT dt, feature, round(avg(ic) OVER (PARTITION BY feature ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) + 0.0 AS ic_12 FROM ic WHERE ic IS NOT NULL"


@query("w67_rolling_ic", _ROLLED)
def rolling_ic(spark, sf_dir):
    over = Window.partitionBy("feature").orderBy("dt").rowsBetween(-11, 0)
    return daily(spark, sf_dir).where("ic is not null").withColumn("ic_12", F.avg("ic").over(over)).select("dt", "feature", w.rounded("ic_12"))


_FOLDS = f"""
WITH {_LONG}, d AS (SELECT dt, floor((row_number() OVER (ORDER BY dt) - 1) * 5.0 / count(*) OVER ()) AS fold FROM (SELECT DISTINCT dt FROM ic)
), f AS (SELECT feature, fold, avg(ic) AS m FROM ic JOIN d USING (dt) GROUP BY 1, 2), o AS (SELECT feature, median(m) AS mid FROM f GROUP BY 1)
SELECT feature, round(avg(m), 6) + 0.0 AS cv_ic, round(avg((sign(m) = sign(mid))::INT), 6) + 0.0 AS agreement, count(*) AS folds FROM f JOIN o USING (feature) GROUP BY 1
"""


@query("c11_fold_ic", _FOLDS)
def fold_ic(spark, sf_dir):
    return sel.fold_agreement(daily(spark, sf_dir), 5).select("feature", w.rounded("cv_ic"), w.rounded("agreement"), "folds")


_NAMES = sorted(FEATURES)
_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]


def _pair_sql(source: str) -> str:
    both = lambda a, b, x: f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {x} END"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(covar_samp({both(a, b, a)}, {both(a, b, b)}) / nullif(stddev_samp({both(a, b, a)}) * stddev_samp({both(a, b, b)}), 0), 6) + 0.0 AS corr, count({both(a, b, a)}) AS n FROM {source}"
        for a, b in _PAIRS
    )


@query("a16_j11_pair_correlations", f"WITH {_WIDE} {_pair_sql('wide')}")
def pair_correlations(spark, sf_dir):
    return ics.pair_correlations(wide(spark, sf_dir), FEATURES).select("feature_a", "feature_b", w.rounded("corr"), "n")


_SPEARMAN = f"{_WIDE}, ranked AS (SELECT {', '.join(rank_pct(f, '1').replace('PARTITION BY 1, ', 'PARTITION BY ').replace('PARTITION BY 1 ', '').replace('PARTITION BY 1)', ')') + f' AS {f}' for f in FEATURES)} FROM wide WHERE dt = DATE '1998-06-01')"


@query("x17_section_spearman", f"WITH {_SPEARMAN} {_pair_sql('ranked')}")
def section_spearman(spark, sf_dir):
    one = wide(spark, sf_dir).where(c("dt") == F.lit("1998-06-01").cast("date"))
    return ics.pair_correlations(one, FEATURES, ranked=True).select("feature_a", "feature_b", w.rounded("corr"), "n")


_CORR_SUMMARY = f"""
WITH {_WIDE}, p AS ({_pair_sql('wide')})
SELECT count(*) AS pairs, round(avg(corr), 5) + 0.0 AS mean, round(median(corr), 5) + 0.0 AS mid, round(max(abs(corr)), 5) + 0.0 AS most, round(stddev_samp(corr), 5) + 0.0 AS sd,
  round(avg((abs(corr) > 0.5)::INT), 5) + 0.0 AS above_50, round(avg((abs(corr) > 0.8)::INT), 5) + 0.0 AS above_80 FROM p
"""


@query("a17_correlation_summary", _CORR_SUMMARY)
def correlation_summary(spark, sf_dir):
    p = ics.pair_correlations(wide(spark, sf_dir), FEATURES)
    out = p.agg(F.count("*").alias("pairs"), F.avg("corr").alias("mean"), F.median("corr").alias("mid"), F.max(F.abs("corr")).alias("most"), F.stddev("corr").alias("sd"), F.avg((F.abs("corr") > 0.5).cast("int")).alias("above_50"), F.avg((F.abs("corr") > 0.8).cast("int")).alias("above_80"))
    return out.select("pairs", *(w.rounded(k, 5) for k in ("mean", "mid", "most", "sd", "above_50", "above_80")))


@query("l06_redundancy")
def redundancy(spark, sf_dir):
    """Features that stay when the weaker of each correlated pair goes."""
    df = wide(spark, sf_dir)
    score = {r.feature: abs(r.ic_mean) for r in ics.summary(ics.daily_ic(df, FEATURES, "y")).collect()}  # a row a feature
    pairs = [(r.feature_a, r.feature_b, r["corr"]) for r in ics.pair_correlations(df, FEATURES).collect()]  # a row a pair of features
    kept = sel.drop_redundant(FEATURES, score, pairs, 0.6)
    return spark.createDataFrame([(f, float(score.get(f, 0.0)), f in kept) for f in FEATURES], "feature string, score double, kept boolean")


_STANDARD = f"""
WITH {_WIDE}, m AS (SELECT {', '.join(f'median({f}) AS m_{f}' for f in FEATURES)} FROM wide), s AS (SELECT {', '.join(f'median(abs({f} - m_{f})) AS s_{f}' for f in FEATURES)} FROM wide, m)
SELECT dt, ticker, {', '.join(f'round(({f} - m_{f}) / (CASE WHEN s_{f} < 1e-10 THEN 1 ELSE s_{f} END), 5) + 0.0 AS {f}' for f in FEATURES)} FROM wide, m, s
"""


@query("l11_robust_standardise", _STANDARD)
def robust(spark, sf_dir):
    df = wide(spark, sf_dir)
    return sel.robust_standardise(df, FEATURES).select("dt", "ticker", *(w.rounded(f, 5) for f in FEATURES))


_RANKED = f"""
WITH {_LONG}, d AS (SELECT dt, floor((row_number() OVER (ORDER BY dt) - 1) * 3.0 / count(*) OVER ()) AS block FROM (SELECT DISTINCT dt FROM ic)
), b AS (SELECT feature, block, avg(ic) AS m FROM ic JOIN d USING (dt) GROUP BY 1, 2), g AS (SELECT feature, avg(ic) AS ic_mean FROM ic GROUP BY 1
), s AS (SELECT feature, ic_mean, abs(ic_mean) * (0.5 + 0.5 * count(*) FILTER (sign(m) = sign(ic_mean)) / count(*)) AS score FROM b JOIN g USING (feature) GROUP BY 1, 2)
SELECT feature, round(ic_mean, 6) + 0.0 AS ic_mean, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, feature) AS place FROM s QUALIFY place <= 5
"""


@query("l05_soft_ranking", _RANKED)
def soft_ranking(spark, sf_dir):
    out = sel.soft_rank(daily(spark, sf_dir), blocks=3, top=5)
    return out.select("feature", w.rounded("ic_mean"), w.rounded("score"), c("place").cast("long").alias("place"))


# interactions

_A, _B = ["ret_pct_5", "ret_pct_21"], ["std_21", "std_63"]
_INTER = f"""
WITH {_WIDE}, i AS (SELECT dt, ticker, {', '.join(f'{a} * {b} AS {a}_x_{b}, {a} / nullif({b}, 0) AS {a}_div_{b}' for a in _A for b in _B)}, ret_pct_5 - ret_pct_21 AS ret_pct_5_minus_ret_pct_21,
  {', '.join(f'{f} * {f} AS {f}_sq, {f} * {f} * {f} AS {f}_cb' for f in _A)} FROM wide)
SELECT feature, count(value) AS n, round(avg(value), 4) + 0.0 AS mean, round(stddev_samp(value), 3) + 0.0 AS sd FROM (UNPIVOT i ON COLUMNS(* EXCLUDE (dt, ticker)) INTO NAME feature VALUE value) GROUP BY 1
"""


@query("i01_i06_interactions", _INTER)
def interactions(spark, sf_dir):
    df = wide(spark, sf_dir).select("dt", "ticker", *_A, *_B)
    out = inter.interactions(df, {f: "momentum" for f in _A} | {f: "volatility" for f in _B})
    out = out.where("value is not null").groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"))
    return out.select("feature", "n", w.rounded("mean", 4), w.rounded("sd", 3))


@query("l02_interaction_screen")
def interaction_screen(spark, sf_dir):
    """Interactions whose parents, false-discovery test, size, fold agreement and novelty let them through."""
    df = wide(spark, sf_dir)
    return inter.screen(df, {f: "momentum" for f in _A} | {f: "volatility" for f in _B}, "y")


@query("l12_lasso_stability")
def lasso_stability(spark, sf_dir):
    """Share of time folds in which the lasso keeps each feature, fold by fold in its own task."""
    return sel.lasso_stability(wide(spark, sf_dir), FEATURES, "y", folds=5)


@query("l13_window_models")
def window_models(spark, sf_dir):
    """A model for each rebalance date, fitted on the year before it."""
    from tidepanel.plans.cross import rebalance_grid

    df = wide(spark, sf_dir)
    return sel.window_models(df, rebalance_grid(df, 130), FEATURES, "y", days=364, embargo=21)


@query("b01_b02_alpha_gates")
def alpha_gates(spark, sf_dir):
    """Feature-lab gates and the first that each feature fails."""
    from tidepanel.operators.lab import alpha_gates as gates

    return gates(wide(spark, sf_dir), FEATURES, "y")


_AUC = f"""
WITH {_WIDE}, f AS (SELECT dt, std_21 AS x, CASE WHEN y < 0 THEN 1 ELSE 0 END AS hit FROM wide WHERE std_21 IS NOT NULL AND y IS NOT NULL
), r AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY x) + (count(*) OVER (PARTITION BY dt, x) - 1) / 2.0 AS r FROM f
), a AS (SELECT dt, (sum(r) FILTER (hit = 1) - sum(hit) * (sum(hit) + 1) / 2.0) / nullif(sum(hit) * (count(*) - sum(hit)), 0) AS auc FROM r GROUP BY dt)
SELECT dt, round(greatest(auc, 1 - auc), 6) + 0.0 AS auc FROM a WHERE auc IS NOT NULL
"""


@query("a20_daily_auc", _AUC)
def daily_auc(spark, sf_dir):
    from tidepanel.operators.lab import daily_auc as auc

    df = wide(spark, sf_dir).withColumn("hit", F.when(c("y").isNotNull(), (c("y") < 0).cast("int")))
    return auc(df, "std_21", "hit").select("dt", w.rounded("auc"))


_RESID = f"""
WITH {_WIDE}, f AS (SELECT dt, std_21 AS x, ret_pct_21 AS b, y FROM wide WHERE std_21 IS NOT NULL AND ret_pct_21 IS NOT NULL AND y IS NOT NULL
), g AS (SELECT dt, covar_samp(b, x) / nullif(var_samp(b), 0) AS slope, avg(x) - covar_samp(b, x) / nullif(var_samp(b), 0) * avg(b) AS level FROM f GROUP BY dt
), e AS (SELECT dt, x - slope * b - level AS e, y FROM f JOIN g USING (dt) WHERE slope IS NOT NULL
), k AS (SELECT dt, {rank_pct('e')} AS rx, {rank_pct('y')} AS ry FROM e)
SELECT dt, round(covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0), 6) + 0.0 AS ic, count(*) AS n FROM k GROUP BY dt HAVING count(*) >= 3
"""


@query("x18_residual_ic", _RESID)
def residual_ic(spark, sf_dir):
    from tidepanel.operators.lab import residual_ic as resid

    return resid(wide(spark, sf_dir), "std_21", "ret_pct_21", "y").select("dt", w.rounded("ic"), "n")

