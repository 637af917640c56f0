"""Registered queries: time-series features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import timeseries as ts
from tidepanel.plans.panel import BARS, PANEL, T, avg, bars, co, dev, frame, panel, roll, select, shown
from tidepanel.registry import query

# returns, lags

_RETURNS = {f"ret_pct_{k}": f"(close / lag(close, {k}) OVER {T} - 1) * 100.0" for k in (1, 2, 3, 5, 10, 21, 42, 63, 126, 252)}
_RETURNS |= {f"x_lag_{k}": f"lag(x, {k}) OVER {T}" for k in (1, 2, 3, 5, 10)}


@query("w01_w04_returns", select(_RETURNS))
def returns(spark, sf_dir):
    return shown(ts.returns(panel(spark, sf_dir)), list(_RETURNS))


# moments of clipped returns

_MOMENTS = {f"std_{n}": dev("x", n) for n in (5, 10, 21, 42, 63, 126)}
for _n in (21, 42, 63, 126):
    _MOMENTS |= {f"skew_{_n}": roll("skewness({x})", "x", _n), f"kurt_{_n}": roll("kurtosis({x})", "x", _n)}
for _n in (21, 63):
    _MOMENTS |= {f"boll_up_{_n}": f"{avg('x', _n)} + 2 * {dev('x', _n)}", f"boll_lo_{_n}": f"{avg('x', _n)} - 2 * {dev('x', _n)}"}
_MOMENTS |= {f"mom_{n}": f"x - lag(x, {n}) OVER {T}" for n in (5, 10, 21, 42, 63)}


@query("w07_w11_moments", select(_MOMENTS, 5))
def moments(spark, sf_dir):
    return shown(ts.moments(panel(spark, sf_dir)), list(_MOMENTS), 5)


# levels

_LEVELS = {f"ma_{n}": avg("close", n) for n in (5, 10, 21, 42, 63, 126, 200)}
for _n in (14, 21, 42):
    _up, _down = avg("greatest(d, 0)", _n).replace("count(greatest(d, 0))", "count(d)"), avg("greatest(-d, 0)", _n).replace("count(greatest(-d, 0))", "count(d)")
    _LEVELS[f"rsi_{_n}"] = f"CASE WHEN {_down} = 0 THEN CASE WHEN {_up} > 0 THEN 100.0 END ELSE 100.0 - 100.0 / (1 + {_up} / nullif({_down}, 0)) END"
_LEVELS["atr_14"] = avg("tr", 14)
for _n in (14, 21, 63):
    _h, _l = roll("max({x})", "high", _n), roll("min({x})", "low", _n)
    _LEVELS[f"williams_{_n}"] = f"-100.0 * ({_h} - close) / nullif({_h} - {_l}, 0)"
_LEVELS["adv_63"] = avg("close * volume", 63)
_LEVELS["ret_z"] = f"x / ({dev('x', 60, 30)} + 1e-8)"
_LEVELS |= {f"dd_{n}": roll("min({x})", f"(close - p{n}) / p{n}", n, n // 2) for n in (21, 63)}
_PEAKS = f"""{PANEL}, l0 AS (
  SELECT *, close - lag(close) OVER {T} AS d, greatest(high - low, abs(high - lag(close) OVER {T}), abs(low - lag(close) OVER {T})) AS tr,
    {roll('max({x})', 'close', 21, 10)} AS p21, {roll('max({x})', 'close', 63, 31)} AS p63 FROM panel
)"""


@query("w05_w19_levels", select(_LEVELS, 4, "l0", with_=_PEAKS))
def levels(spark, sf_dir):
    return shown(ts.levels(panel(spark, sf_dir)), list(_LEVELS), 4)


# exponential averages: weights written out

_EMA_SUM = lambda n, of="close": f"sum(CASE WHEN i.n = 1 THEN 1.0 ELSE {2 / (n + 1)!r} END * pow({1 - 2 / (n + 1)!r}, j.n - i.n) * i.{of})"
_EMA = f"""
WITH {BARS}, o AS (SELECT *, row_number() OVER {T} AS n FROM bars), e AS (
  SELECT j.dt, j.ticker, j.n, {', '.join(f'{_EMA_SUM(n)} AS ema_{n}' for n in (*ts.SPANS, 12, 26))}
  FROM o j JOIN o i ON i.ticker = j.ticker AND i.n <= j.n GROUP BY 1, 2, 3
), m AS (SELECT *, ema_12 - ema_26 AS macd FROM e), s AS (
  SELECT j.dt, j.ticker, {_EMA_SUM(9, 'macd')} AS sig FROM m j JOIN m i ON i.ticker = j.ticker AND i.n <= j.n GROUP BY 1, 2
), a AS (SELECT m.*, s.sig, m.macd - s.sig AS histo FROM m JOIN s USING (dt, ticker))
SELECT dt, ticker, {', '.join(f'round(ema_{n}, 4) + 0.0 AS ema_{n}' for n in ts.SPANS)}, round(macd, 4) + 0.0 AS macd, round(sig, 4) + 0.0 AS macd_signal,
  round(histo, 4) + 0.0 AS macd_histo, round(histo - lag(histo) OVER {T}, 4) + 0.0 AS macd_slope,
  CASE WHEN macd > sig AND NOT coalesce(lag(macd > sig) OVER {T}, true) THEN 1.0 ELSE 0.0 END AS macd_cross,
  sign(sig - lag(sig) OVER {T}) + 0.0 AS macd_dir, round(macd - lag(macd) OVER {T}, 4) + 0.0 AS macd_mom
FROM a
"""


@query("w06_w13_smoothed", _EMA)
def smoothed(spark, sf_dir):
    names = [f"ema_{n}" for n in ts.SPANS] + ["macd", "macd_signal", "macd_histo", "macd_slope", "macd_cross", "macd_dir", "macd_mom"]
    return shown(ts.smoothed(bars(spark, sf_dir)), names, 4)


_HURST = f"""
WITH {PANEL}, o AS (SELECT dt, ticker, x, row_number() OVER {T} AS n FROM panel), g AS (
  SELECT j.dt, j.ticker, k.k, i.n, i.x, avg(i.x) OVER g AS m, count(i.x) OVER g AS seen
  FROM o j CROSS JOIN (VALUES (21), (63), (126)) k(k) JOIN o i ON i.ticker = j.ticker AND i.n BETWEEN j.n - k.k + 1 AND j.n
  WINDOW g AS (PARTITION BY j.ticker, j.dt, k.k)
), h AS (
  SELECT dt, ticker, k, seen, x, sum(x - m) OVER (PARTITION BY ticker, dt, k ORDER BY n ROWS UNBOUNDED PRECEDING) AS y FROM g
), v AS (
  SELECT dt, ticker, k, CASE WHEN min(seen) = k AND stddev_pop(x) > 0 THEN ln((max(y) - min(y)) / stddev_pop(x)) / ln(k) END AS h FROM h GROUP BY 1, 2, 3
)
SELECT dt, ticker, round(max(h) FILTER (k = 21), 6) + 0.0 AS hurst_21, round(max(h) FILTER (k = 63), 6) + 0.0 AS hurst_63, round(max(h) FILTER (k = 126), 6) + 0.0 AS hurst_126 FROM v GROUP BY 1, 2
"""


@query("w16_hurst", _HURST)
def hurst(spark, sf_dir):
    return shown(ts.hurst(panel(spark, sf_dir)), ["hurst_21", "hurst_63", "hurst_126"])


# volume

_VOLUME = {f"rel_volume_{n}": f"volume / {avg('volume', n, n // 2)}" for n in (10, 21, 63)}
_VOLUME |= {f"volume_z_{n}": f"(volume - {avg('volume', n, n // 2)}) / ({dev('volume', n, n // 2)} + 1e-8)" for n in (21, 63)}
_VOLUME["volume_trend"] = f"{avg('volume', 10, 5)} / ({avg('volume', 63, 31)} + 1e-8)"
_VOLUME |= {f"pv_corr_{n}": co("ret", "dv", n, n // 2) for n in (21, 63)}
_VOLUME |= {f"obv_slope_{n}": f"(obv - lag(obv, {n}) OVER {T}) / {n}.0" for n in (21, 63)}
for _n in (21, 63):
    _VOLUME[f"up_down_{_n}"] = f"{roll('sum({x})', '(CASE WHEN ret > 0 THEN volume ELSE 0 END)', _n, _n // 2)} / ({roll('sum({x})', '(CASE WHEN ret < 0 THEN volume ELSE 0 END)', _n, _n // 2)} + 1e-8)"
_VOLUME["breakout_63"] = f"CASE WHEN volume > {roll('quantile_cont({x}, 0.9)', 'volume', 63, 31)} THEN 1.0 ELSE 0.0 END"
_VOLUME["dryup_63"] = f"CASE WHEN volume < {roll('quantile_cont({x}, 0.1)', 'volume', 63, 31)} THEN 1.0 ELSE 0.0 END"
_VOLUME["volume_per_atr"] = f"volume / ({avg('tr', 14, 7)} * close + 1e-8)"
_VOLUME_FROM = f"""{PANEL}, v0 AS (
  SELECT *, volume / lag(volume) OVER {T} - 1 AS dv, sum(coalesce(sign(ret), 0) * volume) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS obv,
    greatest(high - low, abs(high - lag(close) OVER {T}), abs(low - lag(close) OVER {T})) AS tr FROM panel
)"""


@query("w20_w27_volume", select(_VOLUME, 6, "v0", with_=_VOLUME_FROM))
def volume(spark, sf_dir):
    return shown(ts.volume(panel(spark, sf_dir)), list(_VOLUME))


# liquidity and range volatility

_K = 3 - 2 * math.sqrt(2)
_LIQUIDITY = {f"amihud_{n}": f"{avg('impact', n, n // 2)} * 1e6" for n in (21, 63, 126)}
_LIQUIDITY["log_amihud_63"] = f"ln(1 + {avg('impact', 63, 30)} * 1e6)"
for _n in (21, 63):
    _c = co("ret", "rlag", _n, _n // 2, "cov")
    _LIQUIDITY[f"roll_spread_{_n}"] = f"CASE WHEN {_c} IS NOT NULL THEN 2 * sqrt(greatest(-{_c}, 0)) END"
    _LIQUIDITY[f"kyle_{_n}"] = avg("abs(ret) / (sqrt(volume) + 1e-8)", _n, _n // 2)
    _LIQUIDITY[f"parkinson_{_n}"] = f"sqrt({avg(f'hl / {4 * math.log(2)!r}', _n, _n // 2)})"
    for _name, _x in (("garman_klass", f"(0.5 * hl - {2 * math.log(2) - 1!r} * co)"), ("rogers_satchell", "rs")):
        _a = avg(_x, _n, _n // 2)
        _LIQUIDITY[f"{_name}_{_n}"] = f"CASE WHEN {_a} IS NOT NULL THEN sqrt(greatest({_a}, 0)) END"
    _LIQUIDITY[f"cs_spread_{_n}"] = avg("cs", _n, _n // 2)
_LIQUIDITY_FROM = f"""{PANEL}, q0 AS (
  SELECT *, abs(ret) / (close * volume + 1e-8) AS impact, lag(ret) OVER {T} AS rlag, pow(ln(high / low), 2) AS hl, pow(ln(close / open), 2) AS co,
    ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs,
    CASE WHEN lag(high) OVER {T} IS NOT NULL THEN pow(ln(max(high) OVER {frame(2)} / min(low) OVER {frame(2)}), 2) END AS gamma FROM panel
), q1 AS (SELECT *, (sqrt(2 * hl) - sqrt(hl)) / {_K!r} - sqrt(gamma / {_K!r}) AS alpha FROM q0
), q2 AS (SELECT *, CASE WHEN alpha IS NOT NULL THEN least(greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0), 0.5) END AS cs FROM q1)"""


@query("w28_w34_liquidity", select(_LIQUIDITY, 6, "q2", with_=_LIQUIDITY_FROM))
def liquidity(spark, sf_dir):
    df = ts.liquidity(panel(spark, sf_dir)).withColumns({f"amihud_{n}": F.col(f"amihud_{n}") * 1e6 for n in (21, 63, 126)})
    return shown(df, list(_LIQUIDITY))


# structure

_RUN = "(CASE WHEN {x} IS NULL OR NOT coalesce({x} = lag({x}) OVER " + T + ", false) THEN 1 ELSE 0 END)"
_STRUCTURE_FROM = f"""{PANEL}, s0 AS (
  SELECT *, {dev('ret', 21, 10)} AS vol, close / lag(close, 21) OVER {T} - 1 AS mom, close / lag(close, 63) OVER {T} - 1 AS mom63, row_number() OVER {T} AS n FROM panel
), rk AS (
  SELECT j.dt, j.ticker, (count(*) FILTER (i.vol < j.vol) + (count(*) FILTER (i.vol = j.vol) + 1) / 2.0) / count(i.vol) AS rp, count(i.vol) AS seen
  FROM s0 j JOIN s0 i ON i.ticker = j.ticker AND i.n BETWEEN j.n - 251 AND j.n WHERE j.vol IS NOT NULL GROUP BY 1, 2
), s1 AS (
  SELECT s0.*, CASE WHEN seen >= 126 THEN rp END AS vol_regime_pct, CASE WHEN seen >= 126 THEN CASE WHEN rp <= 0.33 THEN 0.0 WHEN rp <= 0.67 THEN 1.0 ELSE 2.0 END END AS class,
    abs(mom) / (vol + 1e-8) AS strength, sign(mom) AS sgn, sign(ret) AS dir
  FROM s0 LEFT JOIN rk USING (dt, ticker)
), s2 AS (
  SELECT *, {_RUN.format(x='class')} AS c1, {_RUN.format(x='sgn')} AS c2, {_RUN.format(x='dir')} AS c3 FROM s1
), s3 AS (
  SELECT *, sum(c1) OVER u AS r1, sum(c2) OVER u AS r2, sum(c3) OVER u AS r3 FROM s2 WINDOW u AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)
)"""
_STRUCTURE = {
    "vol_regime_pct": "vol_regime_pct",
    "vol_regime_class": "class",
    "vol_of_vol_63": dev("vol", 63, 30),
    "trend_strength_21": "strength",
    "trend_alignment": "CASE WHEN sign(mom) = sign(mom63) THEN 1.0 ELSE 0.0 END",
    "trend_regime_score": "CASE WHEN strength IS NULL OR strength < 0.5 THEN 0.0 ELSE coalesce(sgn * (1 + CASE WHEN strength > 1.0 THEN 1 ELSE 0 END), 0) END",
    "vol_regime_duration": "row_number() OVER (PARTITION BY ticker, r1 ORDER BY dt) - 1",
    "days_since_mom_flip": "row_number() OVER (PARTITION BY ticker, r2 ORDER BY dt) - 1",
    "price_streak": "(row_number() OVER (PARTITION BY ticker, r3 ORDER BY dt)) * dir",
    "pct_from_52w_high": f"close / {roll('max({x})', 'close', 252, 126)} - 1",
    "pct_from_52w_low": f"close / {roll('min({x})', 'close', 252, 126)} - 1",
}
_STRUCTURE |= {f"price_z_{n}": f"(close - {avg('close', n, n // 2)}) / ({dev('close', n, n // 2)} + 1e-8)" for n in (50, 200)}
_STRUCTURE |= {f"trend_r2_{n}": f"CASE WHEN var_pop(close) OVER {frame(n)} > 0 THEN pow({co('close', 'n', n, n // 2)}, 2) END" for n in (21, 63)}


@query("w35_w45_structure", select(_STRUCTURE, 6, "s3", with_=_STRUCTURE_FROM))
def structure(spark, sf_dir):
    return shown(ts.structure(panel(spark, sf_dir)), list(_STRUCTURE))


# risk against a market return: the mean of all entities' returns

_MARKET = f"{PANEL}, mk AS (SELECT *, avg(ret) OVER (PARTITION BY dt) AS mkt FROM panel)"


def with_market(spark, sf_dir):
    return panel(spark, sf_dir).withColumn("mkt", F.avg("ret").over(w.section()))


def _beta(x: str, y: str, n: int, least: int) -> str:
    yy = f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"({co(x, y, n, least, 'cov')} / ({roll('var_samp({x})', yy, n, max(2, least))} + 1e-10))"


_RISK_FROM = f"""{_MARKET}, k0 AS (
  SELECT *, {', '.join(f'{_beta("ret", "mkt", n, n // 2)} AS beta_mkt_{n}' for n in (63, 126, 252))}, max(close) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS top FROM mk
), k1 AS (
  SELECT *, ret - beta_mkt_63 * mkt AS res, close / top - 1 AS ddn, CASE WHEN mkt < 0 THEN ret END AS dn, CASE WHEN mkt > 0 THEN ret END AS up,
    sum(CASE WHEN close >= top THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS pk, list(ret) OVER {frame(63)} AS l63, list(ret) OVER {frame(126)} AS l126 FROM k0
)"""
_RISK = {f"beta_mkt_{n}": f"beta_mkt_{n}" for n in (63, 126, 252)}
_RISK["beta_stability_126"] = dev("beta_mkt_63", 126, 63)
_RISK |= {f"idio_vol_{n}": dev("res", n, n // 2) for n in (63, 126)}
_RISK["idio_ratio_63"] = f"{dev('res', 63, 31)} / ({dev('ret', 63, 31)} + 1e-10)"
_RISK |= {f"semi_vol_{n}": dev("(CASE WHEN ret IS NOT NULL THEN least(ret, 0) END)", n, n // 2) for n in (63, 126)}
_RISK |= {f"max_dd_{n}": roll("min({x})", "ddn", n, n // 2) for n in (63, 126, 252)}
_RISK["days_since_peak"] = "row_number() OVER (PARTITION BY ticker, pk ORDER BY dt) - 1"
for _n in (63, 126):
    _q = roll("quantile_cont({x}, 0.05)", "ret", _n, _n // 2)
    _RISK[f"var_5pct_{_n}"] = f"v{_n}"
    _RISK[f"cvar_5pct_{_n}"] = f"list_sum(f{_n}) / nullif(len(f{_n}), 0)"
    _RISK[f"corr_mkt_{_n}"] = co("ret", "mkt", _n, _n // 2)
    _RISK[f"down_corr_{_n}"] = co("dn", "mkt", _n, _n // 4)
_RISK["corr_asymmetry_63"] = f"{co('dn', 'mkt', 63, 15)} - {co('up', 'mkt', 63, 15)}"
_RISK_FROM += ", k2 AS (SELECT *, " + ", ".join(f"{roll('quantile_cont({x}, 0.05)', 'ret', n, n // 2)} AS v{n}" for n in (63, 126)) + " FROM k1)"
_RISK_FROM += ", k3 AS (SELECT *, " + ", ".join(f"list_filter(l{n}, lambda y: y IS NOT NULL AND y <= v{n}) AS f{n}" for n in (63, 126)) + " FROM k2)"


@query("w46_w50_market_risk", select(_RISK, 6, "k3", with_=_RISK_FROM))
def market_risk(spark, sf_dir):
    return shown(ts.market_risk(with_market(spark, sf_dir)), list(_RISK))


_SPANS = (21, 63, 126)
_REF_FROM = f"""{_MARKET}, f0 AS (SELECT *, CASE WHEN mkt < 0 THEN ret END AS dx, CASE WHEN mkt < 0 THEN mkt END AS dy,
    CASE WHEN ret IS NOT NULL THEN exp(sum(ln(1 + ret)) OVER u) END AS own, CASE WHEN mkt IS NOT NULL THEN exp(sum(ln(1 + mkt)) OVER u) END AS refg
  FROM mk WINDOW u AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)
), f1 AS (
  SELECT *, own / max(own) OVER u - 1 AS odd, refg / max(refg) OVER u - 1 AS rdd,
    {', '.join(f'{_beta("ret", "mkt", n, n // 2)} AS beta_ref_{n}, {_beta("dx", "dy", n, n // 3)} AS downside_beta_{n}' for n in _SPANS)}
  FROM f0 WINDOW u AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)
), f2 AS (SELECT *, {', '.join(f'ret - beta_ref_{n} * mkt AS res_{n}' for n in _SPANS)} FROM f1
), f3 AS (SELECT *, {', '.join(f'{dev(f"res_{n}", n, n // 2)} AS idio_{n}' for n in _SPANS)} FROM f2)"""
_REF: dict[str, str] = {}
for _n in _SPANS:
    _v = f"(1 - pow(idio_{_n}, 2) / (pow({dev('ret', _n, _n // 2)}, 2) + 1e-10))"
    _REF |= {
        f"beta_ref_{_n}": f"beta_ref_{_n}",
        f"downside_beta_{_n}": f"downside_beta_{_n}",
        f"idio_ref_{_n}": f"idio_{_n}",
        f"r2_ref_{_n}": f"CASE WHEN {_v} IS NOT NULL THEN least(greatest({_v}, 0), 1) END",
        f"dd_corr_{_n}": co("odd", "rdd", _n, _n // 2),
        f"corr_ref_{_n}": co("ret", "mkt", _n, _n // 2),
    }


@query("w52_w57_reference_risk", select(_REF, 6, "f3", with_=_REF_FROM))
def reference_risk(spark, sf_dir):
    return shown(ts.reference_risk(with_market(spark, sf_dir)), list(_REF))


_FORWARD = {f"fwd_{n}": f"lead(close, {n}) OVER {T} / close - 1" for n in (1, 5, 21)}


@query("w59_forward_returns", select(_FORWARD, 6, "bars", with_=BARS))
def forward_returns(spark, sf_dir):
    return shown(ts.forward_returns(bars(spark, sf_dir)), list(_FORWARD))


_FORWARD_RISK = {
    "rv_1": f"abs(lead(ret) OVER {T}) * sqrt(252)",
    "rv_5": "CASE WHEN count(ret) OVER a >= 3 THEN sqrt(avg(ret * ret) OVER a) * sqrt(252) END",
    "tail_event": f"CASE WHEN lead(ret) OVER {T} IS NOT NULL AND {dev('ret', 20, 10)} IS NOT NULL THEN CASE WHEN lead(ret) OVER {T} < -2.0 * {dev('ret', 20, 10)} THEN 1.0 ELSE 0.0 END END",
}


@query("w66_forward_risk", select(_FORWARD_RISK) + " WINDOW a AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def forward_risk(spark, sf_dir):
    return shown(ts.forward_risk(panel(spark, sf_dir)), list(_FORWARD_RISK))


_GAP = "CASE WHEN volume % 7 < 4 THEN close END"
_FILL = f"""
WITH {BARS}, g AS (SELECT dt, ticker, {_GAP} AS v, row_number() OVER {T} AS n FROM bars), h AS (
  SELECT *, last_value(v IGNORE NULLS) OVER u AS f, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER u AS seen_at FROM g
  WINDOW u AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)
)
SELECT dt, ticker, round(f, 6) + 0.0 AS filled, round(CASE WHEN n - seen_at <= 2 THEN f END, 6) + 0.0 AS filled_2 FROM h
"""


@query("w60_w61_forward_fill", _FILL)
def forward_fill(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("v", F.expr(_GAP)).withColumn("_row", F.row_number().over(w.history()))
    df = df.withColumns({"filled": ts.filled(df, "v"), "filled_2": ts.filled(df.withColumnRenamed("filled", "f"), "v", 2)})
    return shown(df, ["filled", "filled_2"])


_DRAWDOWN = f"""
WITH {BARS}, d AS (SELECT *, close / max(close) OVER u - 1 AS dd FROM bars WINDOW u AS (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING)),
i AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT dt, ticker, round(dd, 6) + 0.0 AS dd, round(min(dd) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS max_dd,
  CAST(sum(CASE WHEN dd < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker, k ORDER BY dt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS underwater FROM i
"""


@query("w65_drawdown", _DRAWDOWN)
def drawdown(spark, sf_dir):
    df = ts.drawdown(bars(spark, sf_dir).withColumn("growth", F.col("close")))
    return df.select("dt", "ticker", w.rounded("dd"), w.rounded("max_dd"), "underwater")
