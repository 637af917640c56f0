"""Registered queries: macro groups, validation, and the walk-forward study with a learned model."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import backtest as bt
from tidepanel.operators import checks as ck
from tidepanel.operators import ic as ics
from tidepanel.operators import macro as mc
from tidepanel.operators import performance as perf
from tidepanel.operators import pipelines as pl
from tidepanel.operators import regime as rg
from tidepanel.operators import timeseries as ts
from tidepanel.operators import xsection as xs
from tidepanel.plans.cross import _BASIC_FROM, _RISK_FROM, basic, rebalance_grid, with_market
from tidepanel.plans.features import _beta
from tidepanel.plans.panel import BARS, PANEL, SERIES, T, avg, bars, co, dev, frame, panel, rank_pct, read, roll, select, series, shown
from tidepanel.plans.research import _LONG, FEATURES, wide
from tidepanel.plans.trading import _PERIODS, _STATE, RULES, _dated, market, periods
from tidepanel.registry import query

c = F.col

# Macro series are not among the tables: monthly figures of orders stand in, one for each series.

_KINDS = {p: f"o_orderpriority LIKE '{p}-%'" for p in range(1, 6)} | {s: f"o_orderstatus = '{s}'" for s in "FOP"}
_STANDINS = {
    "tsy_2y": (1, "mean"), "tsy_10y": (2, "mean"), "tsy_30y": (3, "mean"), "tsy_3mo": (4, "mean"), "breakeven_10y": (5, "mean"), "hy_spread": ("F", "mean"), "ig_spread": ("O", "mean"), "vix": ("P", "mean"),
    "initial_claims": (1, "n"), "indpro": (2, "n"), "retail_sales": (3, "n"), "cpi_index": (4, "n"), "pce_index": (5, "n"), "unemployment_rate": ("F", "n"), "umich_sentiment": ("O", "n"), "epu_daily": ("P", "n"),
}
_DERIVED = {"chicago_fci": "tsy_2y - tsy_10y", "stl_fsi": "tsy_3mo - tsy_30y", "baa_yield": "tsy_2y + 1.0D", "aaa_yield": "tsy_30y"}


def macro_series(spark, sf_dir):
    """(dt, a column a stand-in): means of order totals, in ten thousands, and numbers of orders, by month."""
    orders = read(spark, sf_dir, "orders").withColumn("dt", F.date_trunc("month", "o_orderdate").cast("date")).withColumn("cents", F.round(c("o_totalprice") * 100).cast("long"))
    made = {}
    for name, (kind, what) in _STANDINS.items():
        mine = F.expr(_KINDS[kind])
        n = F.count(F.when(mine, 1)).cast("double")
        made[name] = n if what == "n" else F.coalesce(F.try_divide(F.sum(F.when(mine, c("cents"))).cast("double"), n * 1e6), F.lit(0.0))
    monthly = orders.groupBy("dt").agg(*(v.alias(k) for k, v in made.items()))
    return monthly.withColumns({k: F.expr(v) for k, v in _DERIVED.items()})


_PICKED = ", ".join(
    f"CAST(count(*) FILTER ({_KINDS[k]}) AS DOUBLE) AS {n}" if what == "n" else f"coalesce(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER ({_KINDS[k]}) AS DOUBLE) / nullif(count(*) FILTER ({_KINDS[k]}) * 1e6, 0), 0) AS {n}"
    for n, (k, what) in _STANDINS.items()
)
_Y, _Q, _M = 52, 13, 4
_lag = lambda x, n: f"lag({x}, {n}) OVER (ORDER BY dt)"
_z = lambda x: f"({x} - {_dated('avg({x})', x, _Y, _Y // 2)}) / ({_dated('stddev_samp({x})', x, _Y, _Y // 2)} + 1e-8)"
_over = lambda x, q, n: f"CASE WHEN {x} > {_dated('quantile_cont({x}, ' + str(q) + ')', x, n)} THEN 1.0 ELSE 0.0 END"
_yes = lambda x: f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"
_yoy = lambda x: f"({x} / nullif({_lag(x, _Y)}, 0) - 1) * 100"
_COLUMNS = {
    "yc_slope_10_2": "s", "yc_slope_momentum_21": f"s - {_lag('s', _M)}", "yc_inverted": _yes("s < 0"), "yc_slope_zscore": _z("s"), "yc_curvature": "tsy_2y + tsy_30y - 2 * tsy_10y", "real_rate_10y": "tsy_10y - breakeven_10y",
    "yc_slope_10_3mo": "s3", "yc_slope_10_3mo_zscore": _z("s3"), "yc_inverted_3mo": _yes("s3 < 0"), "short_rate_3mo": "tsy_3mo",
    "hy_spread_momentum_21": f"hy_spread - {_lag('hy_spread', _M)}", "hy_spread_zscore": _z("hy_spread"), "credit_stress": _over("hy_spread", 0.8, _Y), "quality_spread": "hy_spread - ig_spread",
    "baa_aaa_spread": "ba", "baa_aaa_spread_momentum_21": f"ba - {_lag('ba', _M)}", "baa_aaa_spread_zscore": _z("ba"), "credit_stress_baa_aaa": _over("ba", 0.8, _Y),
    "fci": "tsy_2y - tsy_10y", "fci_momentum_21": f"(tsy_2y - tsy_10y) - {_lag('(tsy_2y - tsy_10y)', _M)}", "fci_tight": _yes("tsy_2y - tsy_10y > 0"), "fsi": "tsy_3mo - tsy_30y", "fsi_stress": _yes("tsy_3mo - tsy_30y > 0"),
    "consumer_sentiment": "umich_sentiment", "sentiment_momentum_63": f"umich_sentiment - {_lag('umich_sentiment', _Q)}", "sentiment_zscore": _z("umich_sentiment"),
    "epu": "epu_daily", "epu_zscore": _z("epu_daily"), "epu_spike": _over("epu_daily", 0.9, _Y),
    "claims_4wk_ma": "cl", "claims_momentum_4w": f"cl / nullif({_lag('cl', 4)}, 0) - 1", "claims_zscore": _z("cl"),
    "unemployment_change_12m": f"unemployment_rate - {_lag('unemployment_rate', _Y)}", "unemployment_zscore": _z("unemployment_rate"), "unemployment_elevated": _over("unemployment_rate", 0.75, _Y),
    "indpro_yoy": "ip", "indpro_yoy_zscore": _z("ip"), "growth_positive": _yes("ip > 0"), "retail_yoy": "re", "retail_yoy_zscore": _z("re"), "cpi_yoy": "cp", "cpi_yoy_zscore": _z("cp"), "inflation_high": _over("cp", 0.8, 2 * _Y),
    "pce_yoy": "pc", "pce_yoy_zscore": _z("pc"), "breakeven_10y_zscore": _z("breakeven_10y"), "vix_zscore": "vz",
    "macro_regime_score": "score", "risk_on": _yes("score >= 2"), "risk_off": _yes("score <= -2"),
}
_MACRO = f"""
WITH {BARS}, monthly AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, {_PICKED} FROM orders GROUP BY 1
), d AS (SELECT DISTINCT dt FROM bars), al AS (SELECT d.dt, m.* EXCLUDE (dt) FROM d ASOF LEFT JOIN monthly m ON d.dt >= m.dt
), lv AS (SELECT *, tsy_10y - tsy_2y AS s, tsy_10y - tsy_3mo AS s3, tsy_2y + 1.0 - tsy_30y AS ba, {_dated('avg({x})', 'initial_claims', 4, 2)} AS cl, {_yoy('indpro')} AS ip, {_yoy('retail_sales')} AS re, {_yoy('cpi_index')} AS cp, {_yoy('pce_index')} AS pc, {_z('vix')} AS vz,
  list(hy_spread) OVER (ORDER BY dt ROWS BETWEEN {_Y - 1} PRECEDING AND CURRENT ROW) AS seen FROM al
), pl AS (SELECT *, list_filter(seen, lambda x: x IS NOT NULL) AS vals FROM lv
), pr AS (SELECT *, CASE WHEN hy_spread IS NOT NULL AND len(vals) >= {_Y // 2} THEN (len(list_filter(vals, lambda x: x < hy_spread)) + (len(list_filter(vals, lambda x: x = hy_spread)) + 1) / 2.0) / len(vals) END AS pct FROM pl
), sc AS (SELECT *, CAST((CASE WHEN s > 0.5 THEN 1 WHEN s < 0 THEN -1 ELSE 0 END) + (CASE WHEN pct < 0.3 THEN 1 WHEN pct > 0.7 THEN -1 ELSE 0 END) + (CASE WHEN vz < -0.5 THEN 1 WHEN vz > 1 THEN -1 ELSE 0 END) AS DOUBLE) AS score FROM pr)
SELECT dt, {', '.join(f'round({e}, 4) + 0.0 AS {n}' for n, e in _COLUMNS.items())} FROM sc
"""


@query("m02_m10_macro_groups", _MACRO)
def macro_groups(spark, sf_dir):
    days = bars(spark, sf_dir).select("dt").distinct()
    wide_series = macro_series(spark, sf_dir)
    names = [n for n in wide_series.columns if n != "dt"]
    long = wide_series.select("dt", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), c(n).alias("value")) for n in names))))
    df = mc.macro_groups(xs.asof(days, long, names), mc.Rows(_M, _Q, _Y))
    return df.select("dt", *(w.rounded(n, 4) for n in _COLUMNS))


# validation

_START, _END = datetime.date(1996, 4, 20), datetime.date(2001, 9, 24)
_NEED = ck.requirements(_START, _END, 0.5, 0.5, 63, 21)
_REQUIRED = f"""
WITH {BARS}, s AS (SELECT ticker, min(dt) AS first, max(dt) AS last FROM bars GROUP BY 1), g AS (SELECT *, CAST(greatest(0, datediff('day', DATE '{_NEED.earliest}', first)) AS INT) AS late_days, CAST(greatest(0, datediff('day', last, DATE '{_NEED.latest}')) AS INT) AS short_days FROM s)
SELECT *, late_days <= 5 AND short_days <= 5 AS fine FROM g
"""


@query("p15_requirements", _REQUIRED)
def against_requirements(spark, sf_dir):
    return ck.against_requirements(bars(spark, sf_dir), _NEED)


_ELIGIBLE = f"""
WITH {BARS}, h AS (SELECT dt, ticker, CASE WHEN volume >= 30 THEN close END AS close FROM bars), f AS (SELECT ticker FROM h GROUP BY 1 HAVING min(dt) <= DATE '1995-04-10' - INTERVAL 94 DAY + INTERVAL 5 DAY
), p AS (SELECT ticker, avg((close IS NULL)::INT) AS share FROM h WHERE ticker IN (FROM f) GROUP BY 1 HAVING avg((close IS NULL)::INT) <= 0.4)
SELECT ticker, count(*) AS n, count(close) AS closes FROM h WHERE ticker IN (SELECT ticker FROM p) GROUP BY 1
"""


@query("p04_p05_eligible", _ELIGIBLE)
def eligible(spark, sf_dir):
    """Entities listed early enough whose closes, those of thin weeks left out, are dense enough."""
    df = bars(spark, sf_dir).select("dt", "ticker", F.when(c("volume") >= 30, c("close")).alias("close"))
    df = ck.dense_entities(ck.listed_in_time(df, datetime.date(1995, 4, 10), 63), "close", 0.4)
    return df.groupBy("ticker").agg(F.count("*").alias("n"), F.count("close").alias("closes"))


_HEALTH = f"""
WITH {_BASIC_FROM}, l AS (SELECT feature, value FROM (SELECT CAST(close AS DOUBLE) AS close, mom, CAST(vol AS DOUBLE) AS vol, fwd_21, close * 0 + 1.0 AS flat FROM b0) UNPIVOT INCLUDE NULLS (value FOR feature IN (close, mom, vol, fwd_21, flat))
), m AS (SELECT feature, median(value) AS mid FROM l GROUP BY 1), h AS (SELECT feature, count(value) AS n, avg((value IS NULL)::INT) AS null_share, median(abs(value - mid)) AS mad FROM l JOIN m USING (feature) GROUP BY 1)
SELECT feature, n, round(null_share, 6) + 0.0 AS null_share, round(mad, 6) + 0.0 AS mad, null_share <= 0.10 AS dense, null_share <= 0.20 AND n >= 10 AND mad >= 1e-10 AS lively, null_share <= 0 AS whole FROM h
"""


@query("p10_p13_columns", _HEALTH)
def columns(spark, sf_dir):
    """Which columns each rule keeps: nulls under a tenth; under a fifth and not flat; none at all."""
    health = ck.column_health(basic(spark, sf_dir).withColumn("flat", c("close") * 0 + 1), ["close", "mom", "vol", "fwd_21", "flat"])
    for name, rule in (("dense", (0.10,)), ("lively", (0.20, 10, 1e-10)), ("whole", (0.0,))):
        health = ck.kept_columns(health, *rule).withColumnRenamed("kept", name)
    return health.select("feature", "n", w.rounded("null_share"), w.rounded("mad"), "dense", "lively", "whole")


_DIAGNOSED = f"""
WITH {_BASIC_FROM}, y AS (SELECT dt, ticker, fwd_21 AS y_raw, fwd_21 - avg(fwd_21) OVER (PARTITION BY dt) AS y_cs FROM b0), l AS (SELECT dt, label, value FROM y UNPIVOT INCLUDE NULLS (value FOR label IN (y_raw, y_cs))
), d AS (SELECT label, max(abs(m)) AS max_abs_daily_mean, avg(s) AS mean_daily_std FROM (SELECT label, dt, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY 1, 2) GROUP BY 1)
SELECT l.label, count(*) AS n, count(value) AS n_valid, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS least, round(max(value), 6) + 0.0 AS most,
  round(quantile_cont(value, 0.01), 6) + 0.0 AS q01, round(quantile_cont(value, 0.99), 6) + 0.0 AS q99, round(max(max_abs_daily_mean), 6) + 0.0 AS max_abs_daily_mean, round(max(mean_daily_std), 6) + 0.0 AS mean_daily_std FROM l JOIN d USING (label) GROUP BY 1
"""


@query("p21_label_diagnostics", _DIAGNOSED)
def label_diagnostics(spark, sf_dir):
    df = xs.labels(basic(spark, sf_dir), controls=None)
    out = ck.label_diagnostics(df, ["y_raw", "y_cs"])
    return out.select("label", "n", "n_valid", *(w.rounded(k) for k in ("mean", "std", "least", "most", "q01", "q99", "max_abs_daily_mean", "mean_daily_std")))


# residuals to three controls: the normal equations, eliminated step by step in SQL

_X = ["1.0", "a", "b", "k"]
_SUMS = ", ".join(f"sum({_X[i]} * {_X[j]}){' + 1e-6' if i == j else ''} AS m{i}{j}" for i in range(4) for j in range(4)) + ", " + ", ".join(f"sum({_X[i]} * y_cs) AS m{i}4" for i in range(4))


def _eliminated(p: int) -> str:
    cells = [f"m{i}{j} - m{i}{p} * m{p}{j} / m{p}{p} AS m{i}{j}" if i != p else f"m{i}{j}" for i in range(4) for j in range(5)]
    return f"e{p + 1} AS (SELECT dt, n, {', '.join(cells)} FROM e{p})"


_THREE = f"""
WITH {_RISK_FROM}, g0 AS (SELECT dt, ticker, beta_mkt_63 AS a, {dev('res', 63, 31)} AS b, volume / 100.0 AS k, lead(close, 21) OVER {T} / close - 1 AS y_raw FROM k1
), g1 AS (SELECT *, y_raw - avg(y_raw) OVER (PARTITION BY dt) AS y_cs FROM g0
), e0 AS (SELECT dt, count(*) AS n, {_SUMS} FROM g1 WHERE a IS NOT NULL AND b IS NOT NULL AND k IS NOT NULL AND y_cs IS NOT NULL GROUP BY dt
), {', '.join(_eliminated(p) for p in range(4))}
SELECT g1.dt, ticker, round(CASE WHEN coalesce(n, 0) < 20 THEN y_cs ELSE y_cs - (m04 / m00 + m14 / m11 * a + m24 / m22 * b + m34 / m33 * k) END, 6) + 0.0 AS y_resid FROM g1 LEFT JOIN e4 USING (dt)
"""


@query("x07_three_controls", _THREE)
def three_controls(spark, sf_dir):
    df = ts.market_risk(with_market(spark, sf_dir)).withColumns({"fwd_21": w.ratio(F.lead("close", 21).over(w.history()), c("close")) - 1, "size": c("volume") / 100.0})
    df = xs.residual(df.withColumn("y_cs", xs.demeaned("fwd_21")), "y_cs", ("beta_mkt_63", "idio_vol_63", "size"))
    return df.select("dt", "ticker", w.rounded("y_resid"))


# the walk-forward study: weights learned from each window's past, universe, regime, book, costs and capital

_AFTER_BARS = _STATE.replace(BARS, "").strip().lstrip(",")
_STUDY = f"""
WITH RECURSIVE {_LONG}, {_AFTER_BARS}, run AS (
  SELECT i, 'range' AS regime, 1 AS held FROM st WHERE i = 1
  UNION ALL SELECT s.i, CASE WHEN s.state <> r.regime AND r.held >= 21 THEN s.state ELSE r.regime END, CASE WHEN s.state <> r.regime AND r.held >= 21 THEN 1 ELSE r.held + 1 END FROM run r JOIN st s ON s.i = r.i + 1
), kn AS (SELECT dt, coalesce(lag(regime) OVER (ORDER BY dt), 'range') AS known FROM st JOIN run USING (i)
), d AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM bars)
), grid AS (SELECT CAST(row_number() OVER (ORDER BY dt) AS INT) AS window_id, dt AS day, i AS day_row FROM d WHERE i > 60 AND (i - 61) % 21 = 0
), md AS (SELECT window_id, CASE known WHEN 'bull' THEN 'long_only' WHEN 'bear' THEN 'short_only' ELSE 'ls' END AS mode FROM grid JOIN kn ON kn.dt = day
), wt AS (
  SELECT window_id, feature, count(ic) AS n, avg(ic) AS m, stddev_samp(ic) AS s, avg((ic > 0)::INT) AS up, avg((ic < 0)::INT) AS down
  FROM ic JOIN d USING (dt) JOIN grid ON d.i <= day_row - 21 AND d.dt >= day - INTERVAL 364 DAY WHERE ic IS NOT NULL GROUP BY 1, 2
), gt AS (SELECT window_id, feature, m FROM wt WHERE n >= 12 AND abs(m) >= 0.02 AND abs(m / nullif(s, 0) * sqrt(n)) >= 1.96 AND CASE WHEN m > 0 THEN up ELSE down END >= 0.55
), u0 AS (SELECT dt, ticker, avg(close * volume) OVER (PARTITION BY ticker ORDER BY dt ROWS 62 PRECEDING) AS adv, min(dt) OVER (PARTITION BY ticker) AS listed FROM panel
), u1 AS (SELECT dt, ticker, listed, {rank_pct('adv')} AS adv_rank FROM u0
), el AS (SELECT window_id, wide.* FROM wide JOIN u1 USING (dt, ticker) JOIN grid ON wide.dt = day WHERE adv_rank >= 0.2 AND datediff('day', listed, dt) >= 252
), lf AS (SELECT window_id, dt, ticker, feature, value FROM el UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(FEATURES)}))
), rf AS (SELECT *, {rank_pct('value', 'window_id, feature')} - 0.5 AS r FROM lf
), s0 AS (SELECT window_id, dt, ticker, sum(m * coalesce(r, 0)) AS learned, max(r) FILTER (feature = 'ret_pct_21') AS plain FROM rf LEFT JOIN gt USING (window_id, feature) GROUP BY 1, 2, 3
), s1 AS (SELECT window_id, dt, ticker, round(coalesce(learned, plain), 10) AS score FROM s0 WHERE coalesce(learned, plain) IS NOT NULL
), s2 AS (SELECT s1.*, mode, CASE mode WHEN 'ls' THEN 0.5 WHEN 'long_only' THEN 1.0 ELSE 0.0 END AS gl, CASE mode WHEN 'ls' THEN 0.5 WHEN 'short_only' THEN 1.0 ELSE 0.0 END AS gs, count(*) OVER (PARTITION BY window_id) AS n,
    row_number() OVER (PARTITION BY window_id ORDER BY score DESC, ticker) AS up, row_number() OVER (PARTITION BY window_id ORDER BY score, ticker) AS down FROM s1 JOIN md USING (window_id)
), s3 AS (SELECT *, greatest(1, floor(n * (1 - 0.67))) AS nl, greatest(1, floor(n * 0.33)) AS ns FROM s2 WHERE n >= 10
), s4 AS (SELECT *, CASE WHEN up <= nl AND gl > 0 THEN 'long' WHEN down <= ns AND gs > 0 THEN 'short' END AS side FROM s3
), s5 AS (SELECT *, CASE WHEN side = 'long' THEN gl ELSE gs END AS gross, least(CASE WHEN side = 'long' THEN gl / nl ELSE gs / ns END, 0.15) AS w0 FROM s4 WHERE side IS NOT NULL
), book AS (SELECT window_id, dt, ticker, side, w0 * gross / sum(w0) OVER (PARTITION BY window_id, side) * CASE WHEN side = 'long' THEN 1 ELSE -1 END AS w FROM s5
), h AS (SELECT book.*, coalesce(y, 0) AS y FROM book LEFT JOIN wide USING (dt, ticker)
), pr AS (
  SELECT window_id, coalesce(sum(w * y) FILTER (side = 'long'), 0) AS long_ret, coalesce(sum(w * y) FILTER (side = 'short'), 0) AS short_ret, coalesce(sum(w) FILTER (side = 'long'), 0) AS wl, coalesce(-sum(w) FILTER (side = 'short'), 0) AS ws,
    count(*) FILTER (side = 'long') AS n_long, count(*) FILTER (side = 'short') AS n_short FROM h GROUP BY 1
), ch AS (
  SELECT window_id, sum(abs(x)) AS change FROM (
    SELECT window_id, ticker, sum(w) AS x FROM (SELECT window_id, ticker, w FROM book UNION ALL SELECT window_id + 1, ticker, -w FROM book WHERE window_id < (SELECT max(window_id) FROM grid)) GROUP BY 1, 2
  ) GROUP BY 1
), f AS (SELECT window_id, count(*) AS n_features FROM gt GROUP BY 1
), pd AS (
  SELECT window_id, day AS dt, mode, coalesce(n_features, 0) AS n_features, coalesce(n_long, 0) AS n_long, coalesce(n_short, 0) AS n_short, coalesce(long_ret, 0) AS long_ret, coalesce(short_ret, 0) AS short_ret,
    coalesce(change, 0) * CASE WHEN window_id = 1 THEN 1.0 ELSE 0.5 END AS turnover, greatest(0, 1 - coalesce(wl, 0) - coalesce(ws, 0)) AS cash, coalesce(ws, 0) AS ws
  FROM grid JOIN md USING (window_id) LEFT JOIN pr USING (window_id) LEFT JOIN ch USING (window_id) LEFT JOIN f USING (window_id)
), nr AS (SELECT *, long_ret + short_ret + cash * 0.034 * 21 / 365.0 - turnover * 8 / 1e4 - ws * 0.01 * 21 / 365.0 AS net_ret FROM pd)
SELECT window_id, dt, mode, n_features, n_long, n_short, round(long_ret, 6) + 0.0 AS long_ret, round(short_ret, 6) + 0.0 AS short_ret, round(turnover, 6) + 0.0 AS turnover, round(net_ret, 6) + 0.0 AS net_ret,
  round(product(1 + net_ret) OVER (ORDER BY window_id ROWS UNBOUNDED PRECEDING), 5) + 0.0 AS capital FROM nr
"""


@query("t07_walk_forward_learned", _STUDY)
def walk_forward(spark, sf_dir):
    """From bars to capital over all windows: daily coefficients, learned weights, universe, regime, book, costs."""
    df = wide(spark, sf_dir).persist()  # one panel and one table of coefficients serve all steps
    grid = rebalance_grid(df).persist()
    days = df.select("dt").distinct().withColumn("_row", F.row_number().over(Window.orderBy("dt")))
    ic = ics.daily_ic(df, FEATURES, "y").join(F.broadcast(days), "dt").persist()
    known = rg.steadied(rg.market_state(market(spark, sf_dir))).withColumn("known", rg.lagged()).select("dt", "known")
    modes = grid.join(known, c("at") == c("dt")).select("window_id", bt.mode_of(c("known")).alias("mode")).persist()
    out = bt.walk_forward(df, ic, grid, modes, FEATURES, "y", "ret_pct_21", RULES, bars=panel(spark, sf_dir))
    return out.select("window_id", "dt", "mode", "n_features", "n_long", "n_short", *(w.rounded(k) for k in ("long_ret", "short_ret", "turnover", "net_ret")), w.rounded("capital", 5))


_FAMILY_SHARES = f"""
WITH {_PERIODS}
SELECT family, count(*) FILTER (side = 'long') AS n_long, count(*) FILTER (side = 'short') AS n_short, round(coalesce(avg(w) FILTER (side = 'long'), 0), 6) + 0.0 AS mean_long, round(coalesce(avg(-w) FILTER (side = 'short'), 0), 6) + 0.0 AS mean_short,
  round(sum(net_ret * w), 6) + 0.0 AS contribution FROM book JOIN nr USING (window_id) GROUP BY 1
"""


@query("r06_family_attribution", _FAMILY_SHARES)
def family_attribution(spark, sf_dir):
    out, book, df = periods(spark, sf_dir)
    families = df.select("dt", "ticker", "family")
    return perf.by_family(book.join(families, ["dt", "ticker"]), out).select("family", "n_long", "n_short", *(w.rounded(k) for k in ("mean_long", "mean_short", "contribution")))


@query("l08_multicollinearity")
def multicollinearity(spark, sf_dir):
    """Which features are left when of each pair too much alike the one that says less goes, and those that say nothing."""
    df = wide(spark, sf_dir)
    mi = {r.feature: r.mi for r in pl.mutual_information(df, FEATURES, "y").groupBy("feature").agg(F.avg("mi").alias("mi")).collect()}
    pairs = [(r.feature_a, r.feature_b, r["corr"]) for r in ics.pair_correlations(df, FEATURES, ranked=True).collect()]
    kept = pl.most_informative(FEATURES, mi, pairs)
    return spark.createDataFrame([(f, mi.get(f), f in kept) for f in FEATURES], "feature string, mi double, kept boolean")


# two references: an index of two entities, where both have a return, and the levels of two series

_PAIR = ("Brand#12", "Brand#13")
_BOTH_FROM = f"""{PANEL}, {SERIES}, syn AS (SELECT a.dt, (a.ret + b.ret) / 2 AS syn FROM panel a JOIN panel b USING (dt) WHERE a.ticker = '{_PAIR[0]}' AND b.ticker = '{_PAIR[1]}' AND a.ret IS NOT NULL AND b.ret IS NOT NULL
), cal AS (SELECT d.dt, syn.syn, p.value AS price, o.value AS orders FROM (SELECT DISTINCT dt FROM panel) d ASOF LEFT JOIN syn ON d.dt >= syn.dt ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'price') p ON d.dt >= p.dt ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'orders') o ON d.dt >= o.dt
), both_ AS (SELECT panel.*, syn, price, orders, max(CASE WHEN ticker = 'Brand#2' THEN ret END) OVER (PARTITION BY dt) AS b FROM panel JOIN cal USING (dt)
), rs AS (SELECT *, {', '.join(f"(CASE WHEN count(ret) OVER {frame(n)} >= {n // 2} THEN sum(ret - b) OVER {frame(n)} END) AS rs_{n}" for n in (21, 63, 126))} FROM both_)"""
_BOTH = {f"beta_syn_{n}": _beta("ret", "syn", n, n // 2) for n in (21, 63, 126)} | {"corr21_syn": co("ret", "syn", 21, 10)} | {f"corr_{s}_{n}": co("ret", s, n, n // 2) for s in ("price", "orders") for n in (21, 63)}
_BOTH |= {f"rs_{n}": f"rs_{n}" for n in (21, 63, 126)} | {f"rs_{n}_z": f"(rs_{n} - {avg(f'rs_{n}', 252, 126)}) / ({dev(f'rs_{n}', 252, 126)} + 1e-8)" for n in (21, 63, 126)} | {f"corr_b_{n}": co("ret", "b", n, n // 2) for n in (63, 126)}
_BOTH |= {f"return_skew_{n}": roll("skewness({x})", "ret", n) for n in (63, 126)} | {f"return_kurt_{n}": roll("kurtosis({x})", "ret", n) for n in (63, 126)}


@query("j06_w50_w58_two_references", select(_BOTH, 5, "rs", with_=_BOTH_FROM))
def two_references(spark, sf_dir):
    df = panel(spark, sf_dir)
    index = ts.pair_index(df, *_PAIR).select(F.lit("syn").alias("name"), "dt", "value")
    df = xs.asof(df, index.unionByName(series(spark, sf_dir)), ["syn", "price", "orders"])
    other = df.where(c("ticker") == "Brand#2").select("dt", c("ret").alias("b"))
    df = df.join(F.broadcast(other), "dt", "left")  # one row a date
    df = ts.reference_risk(df, "syn").withColumns({f"beta_syn_{n}": c(f"beta_ref_{n}") for n in (21, 63, 126)})
    made = {"corr21_syn": w.corr(c("ret"), c("syn"), 21, 10)} | {f"corr_{s}_{n}": w.corr(c("ret"), c(s), n, n // 2) for s in ("price", "orders") for n in (21, 63)}
    made |= {f"corr_b_{n}": w.corr(c("ret"), c("b"), n, n // 2) for n in (63, 126)} | {f"return_skew_{n}": w.skew(c("ret"), n) for n in (63, 126)} | {f"return_kurt_{n}": w.kurt(c("ret"), n) for n in (63, 126)}
    df = ts.relative_strength(df.withColumns(made), "b")
    return shown(df, list(_BOTH), 5)
