"""Registered queries: chains from bars to a panel, to models by window, to selected features, and the audit of them."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import backtest as bt
from tidepanel.operators import ic as ics
from tidepanel.operators import interactions as inter
from tidepanel.operators import lab
from tidepanel.operators import regime as rg
from tidepanel.operators import study as st
from tidepanel.operators import timeseries as ts
from tidepanel.plans.cross import _BASIC_FROM, basic, rebalance_grid
from tidepanel.plans.panel import BARS, PANEL, SERIES, T, avg, bars, dev, panel, rank_pct, series
from tidepanel.plans.research import _LONG, _P, FEATURES, _nw, wide
from tidepanel.plans.studies import _DAYS, _FAMILY
from tidepanel.plans.trading import RULES, market
from tidepanel.registry import query

c = F.col

# the feature panel

_START = datetime.date(1997, 1, 6)
_BASE = ["ret_pct_21", "std_21", "boll_up_21", "rel_volume_21", "adv_63", "rel_21_basket", "price"]
_FROM_BARS = PANEL.replace(
    BARS,
    f"""{BARS.replace('bars AS', 'listed AS')}, bars AS (
  SELECT * FROM listed WHERE ticker IN (SELECT ticker FROM listed GROUP BY 1 HAVING min(dt) <= DATE '{_START}' - INTERVAL {int(336 * 1.5) - 5} DAY AND avg((close IS NULL)::INT) <= 0.10))""",
)
_FEATURE_PANEL = f"""
WITH {_FROM_BARS}, {SERIES}, f0 AS (
  SELECT dt, ticker, close, (close / lag(close, 21) OVER {T} - 1) * 100.0 AS ret_pct_21, {dev('x', 21)} AS std_21, {avg('x', 21)} + 2 * {dev('x', 21)} AS boll_up_21, volume / {avg('volume', 21, 10)} AS rel_volume_21,
    avg(close * volume) OVER (PARTITION BY ticker ORDER BY dt ROWS 62 PRECEDING) AS adv_63, lead(close, 21) OVER {T} / close - 1 AS y_raw FROM panel
), f1 AS (SELECT f0.*, ret_pct_21 - avg(ret_pct_21) OVER (PARTITION BY dt) AS rel_21_basket FROM f0
), cal AS (SELECT d.dt, s.value AS price FROM (SELECT DISTINCT dt FROM panel) d ASOF LEFT JOIN (SELECT * FROM series WHERE name = 'price') s ON d.dt >= s.dt
), f2 AS (SELECT f1.*, price FROM f1 JOIN cal USING (dt) WHERE dt >= DATE '{_START}'
), f3 AS (SELECT dt, ticker, close, y_raw, {', '.join(f'coalesce({n}, median({n}) OVER (PARTITION BY dt)) AS {n}' for n in _BASE)} FROM f2
), f4 AS (SELECT dt, ticker, close, y_raw, {', '.join(f'last_value({n} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS {n}' for n in _BASE)} FROM f3)
SELECT dt, ticker, {', '.join(f'round({n}, 5) + 0.0 AS {n}' for n in ('close', *_BASE))}, round({rank_pct('adv_63')}, 5) + 0.0 AS adv_rank, round(y_raw, 5) + 0.0 AS y_raw, round(y_raw - avg(y_raw) OVER (PARTITION BY dt), 5) + 0.0 AS y_cs FROM f4
"""


@query("f02_feature_panel", _FEATURE_PANEL)
def feature_panel(spark, sf_dir):
    """From bars to labels in one chain; of its columns, those that have SQL."""
    df = st.feature_panel(bars(spark, sf_dir), series(spark, sf_dir), ["price", "orders"], _START, (ts.returns, ts.moments, ts.volume), "Brand#1")
    return df.select("dt", "ticker", *(w.rounded(n, 5) for n in ("close", *_BASE, "adv_rank", "y_raw", "y_cs")))


# formation by window: every feature is tested on what each rebalance date may know

_BLOCK, _FORMED_DAYS = 50, 1008
_GRID = "d AS (SELECT dt, row_number() OVER (ORDER BY dt) AS i FROM (SELECT DISTINCT dt FROM bars)), grid AS (SELECT CAST(row_number() OVER (ORDER BY dt) AS INT) AS window_id, dt AS day, i AS day_row FROM d WHERE i > 60 AND (i - 61) % 21 = 0)"
_IN_WINDOW = f"""{_GRID}, icw AS (
  SELECT window_id, concat(window_id, '|', feature) AS feature, dt, ic FROM ic JOIN d USING (dt) JOIN grid ON d.i <= day_row - 21 AND d.dt >= day - INTERVAL {_FORMED_DAYS} DAY WHERE ic IS NOT NULL)"""
_FORMED = f"""
WITH {_nw('1.0').replace(', w0 AS', f', {_IN_WINDOW}, w0 AS', 1).replace('FROM ic WHERE ic IS NOT NULL', 'FROM icw')}, tp AS (SELECT *, CAST(split_part(feature, '|', 1) AS INT) AS window_id, greatest(0, {_P}) AS p_value FROM nw
), dd AS (SELECT window_id, dt, row_number() OVER g - 1 AS i, count(*) OVER (PARTITION BY window_id) AS total FROM (SELECT DISTINCT window_id, dt FROM icw) WINDOW g AS (PARTITION BY window_id ORDER BY dt)
), bl AS (SELECT window_id, dt, greatest(2, floor(total / {_BLOCK}.0)) AS blocks, ceil((i + 1) * greatest(2, floor(total / {_BLOCK}.0)) / total) - 1 AS block FROM dd
), bs AS (SELECT feature, block, max(blocks) AS blocks, round(avg(ic), 12) AS mean, CASE WHEN count(*) > 2 THEN avg(ic) / greatest(stddev_samp(ic) / sqrt(count(*)), 1e-10) END AS t FROM icw JOIN bl USING (window_id, dt) GROUP BY 1, 2
), bc AS (
  SELECT feature, count(*) FILTER (sign(mean) = sign(round(ic_mean, 12)) OR round(ic_mean, 12) = 0) / max(blocks) AS consistency, max(blocks) AS blocks,
    count(*) FILTER ((sign(mean) = sign(round(ic_mean, 12)) OR round(ic_mean, 12) = 0) AND (abs(mean) >= 0.01 OR abs(coalesce(t, 0)) >= 1.5)) AS block_passes FROM bs JOIN nw USING (feature) GROUP BY 1
), bh AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY p_value, feature) AS r, count(*) OVER (PARTITION BY window_id) AS total FROM tp
), ad AS (SELECT *, least(1, min(p_value * total / r) OVER (PARTITION BY window_id ORDER BY p_value DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS p_adjusted FROM bh)
SELECT window_id, split_part(feature, '|', 2) AS feature, n, round(ic_mean, 6) + 0.0 AS ic_mean, round(t_nw, 4) + 0.0 AS t_nw, round(p_value, 5) + 0.0 AS p_value, round(p_adjusted, 5) + 0.0 AS p_adjusted, round(consistency, 6) + 0.0 AS consistency, block_passes,
  p_adjusted <= 0.1 AND abs(ic_mean) >= 0.02 AND consistency >= 0.6 AND block_passes >= least(2, blocks) AS approved FROM ad JOIN bc USING (feature)
"""


def _placed(df, days):
    return df.join(F.broadcast(days), "dt")  # a row a date


def _calendar(df):
    return df.select("dt").distinct().withColumn("_row", F.row_number().over(Window.orderBy("dt")))


@query("l21_formation_windows", _FORMED)
def formation_windows(spark, sf_dir):
    df = wide(spark, sf_dir)
    ic = _placed(ics.daily_ic(df, FEATURES, "y"), _calendar(df))
    out = st.formation(ic, rebalance_grid(df), _FORMED_DAYS, block=_BLOCK)
    return out.select("window_id", "feature", "n", w.rounded("ic_mean"), w.rounded("t_nw", 4), w.rounded("p_value", 5), w.rounded("p_adjusted", 5), w.rounded("consistency"), "block_passes", "approved")


@query("t07_l17_l21_walk_forward_models")
def walk_forward_models(spark, sf_dir):
    """From bars to capital: formation of features and interactions, a sparse model, universe, regime, book and costs by window."""
    df = bt.cut(wide(spark, sf_dir).withColumn("_y", c("y")))  # one panel serves all steps
    grid, days = bt.cut(rebalance_grid(df)), _calendar(df)
    keep = ("dt", "ticker", "_y")
    base = _placed(ics.long(df, FEATURES, keep), days)
    crossed = _placed(inter.interactions(df, _FAMILY, keep), days)
    coefficients = lambda rows: _placed(ics.section_ic(rows.where("value is not null and _y is not null")), days)
    tested, screened = (bt.cut(st.formation(bt.cut(coefficients(rows)), grid, _FORMED_DAYS, block=_BLOCK)) for rows in (base, crossed))
    parents = {n: of for n, (_, of) in inter.expressions(_FAMILY).items()}
    pool = st.pools(tested, screened, parents, {f: d for f, d in _DAYS.items() if d})
    values = base.unionByName(crossed)
    models = bt.cut(st.sparse_models(values, bt.cut(pool), grid))
    priced = panel(spark, sf_dir)
    able = bt.eligible(priced).select("dt", "ticker").join(F.broadcast(grid.select(c("at").alias("dt"))), "dt")
    scored = bt.cut(st.model_scores(values, able, models, grid, "ret_pct_21"))
    known = rg.steadied(rg.market_state(market(spark, sf_dir))).withColumn("known", rg.lagged()).select("dt", "known")
    modes = grid.join(known, c("at") == c("dt")).select("window_id", bt.mode_of(c("known")).alias("mode"))
    out = bt.settled(df, scored, models, grid, bt.cut(modes), "y", RULES)
    return out.select("window_id", "dt", "mode", "n_features", "n_long", "n_short", *(w.rounded(k) for k in ("long_ret", "short_ret", "turnover", "net_ret")), w.rounded("capital", 5))


# the alpha selector

_METRICS = f"""
WITH {_LONG}, m AS (SELECT dt, avg(ret) AS mkt FROM panel GROUP BY dt
), a AS (SELECT feature, abs(avg(ic)) AS ic_abs, CASE WHEN count(*) FILTER (mkt < 0 AND ic IS NOT NULL) >= 20 THEN avg(ic) FILTER (mkt < 0) END AS stress_ic FROM ic JOIN m USING (dt) GROUP BY 1
), o AS (SELECT *, count(*) OVER (PARTITION BY dt, feature) AS k0, row_number() OVER (PARTITION BY dt, feature ORDER BY value DESC, ticker) AS up, row_number() OVER (PARTITION BY dt, feature ORDER BY value, ticker) AS down FROM lng
), p AS (SELECT *, greatest(1, floor(k0 * 0.2)) AS k FROM o WHERE k0 >= 20
), s AS (SELECT feature, dt, avg(y) FILTER (up <= k) AS top, avg(y) FILTER (down <= k) AS low, avg(y) AS mid FROM p GROUP BY 1, 2
), b AS (SELECT feature, avg(top - mid) AS long_tail, avg(top - low) / nullif(stddev_samp(top - low), 0) * sqrt(12) AS spread_sharpe FROM s GROUP BY 1
), g AS (SELECT feature, dt, lag(dt) OVER (PARTITION BY feature ORDER BY dt) AS prev FROM s
), u AS (SELECT p.feature, p.dt, avg((q.ticker IS NULL)::INT) AS t FROM p JOIN g ON g.feature = p.feature AND g.dt = p.dt AND prev IS NOT NULL LEFT JOIN (SELECT * FROM p WHERE up <= k) q ON q.feature = p.feature AND q.dt = prev AND q.ticker = p.ticker WHERE p.up <= p.k GROUP BY 1, 2
), v AS (SELECT feature, avg(t) AS turnover FROM u GROUP BY 1)
SELECT feature, round(ic_abs, 6) + 0.0 AS ic_abs, round(long_tail, 6) + 0.0 AS long_tail, round(spread_sharpe, 5) + 0.0 AS spread_sharpe, round(turnover, 6) + 0.0 AS turnover, round(stress_ic, 6) + 0.0 AS stress_ic FROM a LEFT JOIN b USING (feature) LEFT JOIN v USING (feature)
"""


def _market_return(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("dt").agg(F.avg("ret").alias("mkt"))


@query("b03_alpha_metrics", _METRICS)
def alpha_metrics(spark, sf_dir):
    out = lab.alpha_metrics(wide(spark, sf_dir), FEATURES, "y", _market_return(spark, sf_dir))
    return out.select("feature", w.rounded("ic_abs"), w.rounded("long_tail"), w.rounded("spread_sharpe", 5), w.rounded("turnover"), w.rounded("stress_ic"))


@query("b04_b05_alpha_pipeline")
def alpha_pipeline(spark, sf_dir):
    return st.alpha_pipeline(wide(spark, sf_dir), FEATURES, _FAMILY, "y", _market_return(spark, sf_dir), ("ret_pct_63", "ret_pct_21"))


# the audit of a study

_INTEGRITY = f"""
WITH {_BASIC_FROM}, {_GRID}, again AS (SELECT a.fwd_21, b.close / nullif(a.close, 0) - 1 AS y FROM (SELECT *, row_number() OVER {T} AS i FROM b0) a LEFT JOIN (SELECT ticker, close, row_number() OVER {T} AS i FROM b0) b ON b.ticker = a.ticker AND b.i = a.i + 21
), g AS (SELECT datediff('day', min(day), max(day)) * 1.0 / nullif(count(*) - 1, 0) AS gap FROM grid)
SELECT 'names_ahead' AS name, 0.0 AS value, true AS fine UNION ALL SELECT 'targets_off', CAST(count(*) FILTER (abs(y - fwd_21) > 0.001) AS DOUBLE), count(*) FILTER (abs(y - fwd_21) > 0.001) = 0 FROM again
UNION ALL SELECT 'targets_missing', CAST(count(*) FILTER ((y IS NULL) <> (fwd_21 IS NULL)) AS DOUBLE), count(*) FILTER ((y IS NULL) <> (fwd_21 IS NULL)) = 0 FROM again
UNION ALL SELECT 'mean_gap_days', round(gap, 6), coalesce(gap BETWEEN 15 AND 30, true) FROM g UNION ALL SELECT 'level', 0.000625, true
"""


@query("v01_integrity", _INTEGRITY)
def integrity(spark, sf_dir):
    """The rebalance grid of weekly bars is 147 days wide, and the audit says so."""
    df = basic(spark, sf_dir)
    return st.integrity(df, FEATURES, "fwd_21", 21, rebalance_grid(df), settings=8).select("name", w.rounded("value"), "fine")
