"""Time-series features of an entity's own bars: each function adds columns to a panel.

A panel has dt, ticker, open, high, low, close and volume, and with_returns() adds ret, pct
and x. All features look back only, over rows of the entity, except the clip of x, which
uses the entity's whole history unless it is asked to expand.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w

c = F.col


def with_returns(bars: DataFrame, clip: float = 5.0, clip_mode: str = "full_sample") -> DataFrame:
    """Add ret (simple return), pct (per cent) and x (pct within ``clip`` deviations of the entity)."""
    over = w.whole() if clip_mode == "full_sample" else w.upto()
    df = bars.withColumn("ret", w.ratio(c("close"), w.lag("close")) - 1).withColumn("pct", (w.ratio(c("close"), w.lag("close")) - 1) * 100.0)
    most = F.stddev("pct").over(over) * clip
    return df.withColumn("x", F.when(c("pct").isNotNull(), F.least(F.greatest(c("pct"), -most), most)))


def returns(df: DataFrame, spans=(1, 2, 3, 5, 10, 21, 42, 63, 126, 252), lags=(1, 2, 3, 5, 10)) -> DataFrame:
    return df.withColumns({f"ret_pct_{k}": (w.ratio(c("close"), w.lag("close", k)) - 1) * 100.0 for k in spans} | {f"x_lag_{k}": w.lag("x", k) for k in lags})


def moments(df: DataFrame, spans=(21, 42, 63, 126)) -> DataFrame:
    """Deviation, skewness and kurtosis of x, bands around its mean, and its momentum."""
    x = c("x")
    made = {f"std_{n}": w.std(x, n) for n in (5, 10, *spans)}
    made |= {f"skew_{n}": w.skew(x, n) for n in spans} | {f"kurt_{n}": w.kurt(x, n) for n in spans}
    for n in (21, 63):
        made |= {f"boll_up_{n}": w.mean(x, n) + 2 * w.std(x, n), f"boll_lo_{n}": w.mean(x, n) - 2 * w.std(x, n)}
    return df.withColumns(made | {f"mom_{n}": x - w.lag(x, n) for n in (5, 10, 21, 42, 63)})


def levels(df: DataFrame) -> DataFrame:
    """Moving averages, strength index, true range, range position, traded value, drawdown and shock."""
    close, high, low = c("close"), c("high"), c("low")
    df = df.withColumns({"_d": close - w.lag(close), "_pc": w.lag(close)})
    made = {f"ma_{n}": w.mean(close, n) for n in (5, 10, 21, 42, 63, 126, 200)}
    for n in (14, 21, 42):
        gain, loss = w.mean(F.greatest(c("_d"), F.lit(0.0)), n), w.mean(F.greatest(-c("_d"), F.lit(0.0)), n)
        # the first row has no change: greatest() would take 0 for it
        gain, loss = (F.when(F.count("_d").over(w.last(n)) >= n, v) for v in (gain, loss))
        made[f"rsi_{n}"] = F.when(loss == 0, F.when(gain > 0, F.lit(100.0))).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gain, loss)))
    made["atr_14"] = w.mean(F.greatest(high - low, F.abs(high - c("_pc")), F.abs(low - c("_pc"))), 14)
    for n in (14, 21, 63):
        made[f"williams_{n}"] = F.try_divide(-100.0 * (w.most(high, n) - close), w.most(high, n) - w.fewest(low, n))
    made["adv_63"] = w.mean(close * c("volume"), 63)
    made["ret_z"] = c("x") / (w.std(c("x"), 60, 30) + 1e-8)
    made |= {f"_peak_{n}": w.most(close, n, max(1, n // 2)) for n in (21, 63)}
    df = df.withColumns(made)
    return df.withColumns({f"dd_{n}": w.fewest(w.ratio(close - c(f"_peak_{n}"), c(f"_peak_{n}")), n, max(1, n // 2)) for n in (21, 63)})


SPANS = (5, 10, 21, 42, 63, 126)


def _smoothed(bars: pd.DataFrame) -> pd.DataFrame:
    bars = bars.sort_values("dt")
    ewm = lambda s, n: s.ewm(span=n, adjust=False).mean()
    out = bars[["dt", "ticker"]].copy()
    for n in SPANS:
        out[f"ema_{n}"] = ewm(bars["close"], n)
    line = ewm(bars["close"], 12) - ewm(bars["close"], 26)
    signal = ewm(line, 9)
    out["macd"], out["macd_signal"], out["macd_histo"] = line, signal, line - signal
    out["macd_slope"] = out["macd_histo"].diff()
    return out


def smoothed(bars: DataFrame) -> DataFrame:
    """Exponential averages of close and the convergence lines: a recursion along each entity's
    own history, so it runs entity by entity in pandas; (dt, ticker, ema_*, macd_*)."""
    names = [f"ema_{n}" for n in SPANS] + ["macd", "macd_signal", "macd_histo", "macd_slope"]
    df = bars.select("dt", "ticker", "close").groupBy("ticker").applyInPandas(_smoothed, "dt date, ticker string, " + ", ".join(f"{n} double" for n in names))
    above = c("macd") > c("macd_signal")
    return df.withColumns(
        {
            "macd_cross": w.flag(above & ~F.coalesce(w.lag(above), F.lit(True))),
            "macd_dir": F.signum(c("macd_signal") - w.lag("macd_signal")),
            "macd_mom": c("macd") - w.lag("macd"),
        }
    )


def hurst(df: DataFrame, spans=(21, 63, 126)) -> DataFrame:
    """Rescaled range: ln(R / S) / ln(n) of x; null if a value is missing or nothing varies."""

    def one(n: int) -> Column:
        values = F.when(F.count("x").over(w.last(n)) >= n, F.collect_list("x").over(w.last(n)))
        mean = F.avg("x").over(w.last(n))
        start = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("double").alias("low"))

        def step(a: Column, v: Column) -> Column:
            at = a["at"] + (v["x"] - v["m"])
            return F.struct(at.alias("at"), F.greatest(a["top"], at).alias("top"), F.least(a["low"], at).alias("low"))

        range_ = F.aggregate(F.transform(values, lambda v: F.struct(v.alias("x"), mean.alias("m"))), start, step, lambda a: a["top"] - a["low"])
        ratio = F.try_divide(range_, F.stddev_pop("x").over(w.last(n)))
        return F.when(ratio > 0, F.ln(ratio) / math.log(n))

    return df.withColumns({f"hurst_{n}": one(n) for n in spans})


def volume(df: DataFrame) -> DataFrame:
    close, v, ret = c("close"), c("volume"), c("ret")
    high, low = c("high"), c("low")
    sign = F.coalesce(F.signum(ret), F.lit(0.0))
    df = df.withColumns({"_dv": w.ratio(v, w.lag(v)) - 1, "_obv": F.sum(sign * v).over(w.upto()), "_pc": w.lag(close)})
    made = {f"rel_volume_{n}": w.ratio(v, w.mean(v, n, n // 2)) for n in (10, 21, 63)}
    made |= {f"volume_z_{n}": w.zscore(v, n, n // 2) for n in (21, 63)}
    made["volume_trend"] = w.mean(v, 10, 5) / (w.mean(v, 63, 31) + 1e-8)
    made |= {f"pv_corr_{n}": w.corr(ret, c("_dv"), n, n // 2) for n in (21, 63)}
    made |= {f"obv_slope_{n}": (c("_obv") - w.lag("_obv", n)) / n for n in (21, 63)}
    zero = F.lit(0.0)
    for n in (21, 63):
        up, down = F.when(ret > 0, v).otherwise(zero), F.when(ret < 0, v).otherwise(zero)
        made[f"up_down_{n}"] = w.total(up, n, n // 2) / (w.total(down, n, n // 2) + 1e-8)
    made["breakout_63"] = w.flag(v > w.quantile(v, 0.9, 63, 31))
    made["dryup_63"] = w.flag(v < w.quantile(v, 0.1, 63, 31))
    span = F.greatest(high - low, F.abs(high - c("_pc")), F.abs(low - c("_pc")))
    made["volume_per_atr"] = v / (w.mean(span, 14, 7) * close + 1e-8)
    return df.withColumns(made)


def liquidity(df: DataFrame) -> DataFrame:
    close, v, ret = c("close"), c("volume"), c("ret")
    o, h, low = c("open"), c("high"), c("low")
    two = math.log(2)
    r_lag = w.lag(ret)
    h2, l2 = F.max("high").over(w.last(2)), F.min("low").over(w.last(2))
    df = df.withColumns(
        {
            "_impact": F.abs(ret) / (close * v + 1e-8),
            "_lambda": F.abs(ret) / (F.sqrt(v) + 1e-8),
            "_rlag": r_lag,
            "_hl": F.pow(F.ln(w.ratio(h, low)), 2),
            "_co": F.pow(F.ln(w.ratio(close, o)), 2),
            "_rs": F.ln(w.ratio(h, close)) * F.ln(w.ratio(h, o)) + F.ln(w.ratio(low, close)) * F.ln(w.ratio(low, o)),
            "_gamma": F.when(F.lag("high").over(w.history()).isNotNull(), F.pow(F.ln(w.ratio(h2, l2)), 2)),
        }
    )
    k = 3 - 2 * math.sqrt(2)
    beta = c("_hl")
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(c("_gamma") / k)
    df = df.withColumn("_cs", F.when(c("_gamma").isNotNull(), F.least(F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0)), F.lit(0.5))))
    made = {f"amihud_{n}": w.mean(c("_impact"), n, n // 2) for n in (21, 63, 126)}
    made["log_amihud_63"] = F.log1p(w.mean(c("_impact"), 63, 30) * 1e6)
    for n in (21, 63):
        made[f"roll_spread_{n}"] = 2 * F.sqrt(F.greatest(-w.cov(ret, c("_rlag"), n, n // 2), F.lit(0.0)) * F.when(w.cov(ret, c("_rlag"), n, n // 2).isNotNull(), 1.0))
        made[f"kyle_{n}"] = w.mean(c("_lambda"), n, n // 2)
        made[f"parkinson_{n}"] = F.sqrt(w.mean(c("_hl") / (4 * two), n, n // 2))
        made[f"garman_klass_{n}"] = F.sqrt(F.greatest(F.lit(0.0), w.mean(0.5 * c("_hl") - (2 * two - 1) * c("_co"), n, n // 2)))
        made[f"rogers_satchell_{n}"] = F.sqrt(F.greatest(F.lit(0.0), w.mean(c("_rs"), n, n // 2)))
        made[f"cs_spread_{n}"] = w.mean(c("_cs"), n, n // 2)
        # greatest() skips nulls: before there are enough rows there is no value
        for name, of in ((f"garman_klass_{n}", "_hl"), (f"rogers_satchell_{n}", "_rs")):
            made[name] = F.when(F.count(of).over(w.last(n)) >= n // 2, made[name])
    return df.withColumns(made)


def structure(df: DataFrame) -> DataFrame:
    """Volatility regimes, trends, runs, distance from extremes."""
    close, ret = c("close"), c("ret")
    df = df.withColumns({"_vol": w.std(ret, 21, 10), "_mom": w.ratio(close, w.lag(close, 21)) - 1, "_mom63": w.ratio(close, w.lag(close, 63)) - 1, "_n": F.row_number().over(w.history()).cast("double")})
    seen = F.collect_list("_vol").over(w.last(252))
    rank = F.size(F.filter(seen, lambda v: v < c("_vol"))) + (F.size(F.filter(seen, lambda v: v == c("_vol"))) + 1) / F.lit(2.0)
    df = df.withColumn("vol_regime_pct", F.when(c("_vol").isNotNull() & (F.count("_vol").over(w.last(252)) >= 126), rank / F.size(seen)))
    pct = c("vol_regime_pct")
    df = df.withColumns(
        {
            "vol_regime_class": F.when(pct.isNull(), None).when(pct <= 0.33, 0.0).when(pct <= 0.67, 1.0).otherwise(2.0),
            "vol_of_vol_63": w.std(c("_vol"), 63, 30),
            "trend_strength_21": F.abs(c("_mom")) / (c("_vol") + 1e-8),
            "_sign": F.signum("_mom"),
            "_dir": F.signum("ret"),
        }
    )
    # a missing value differs from everything, itself included: each starts a run of its own
    differs = lambda v: (~v.eqNullSafe(w.lag(v))) | v.isNull()
    df = df.withColumns({f"_run_{n}": F.sum(differs(c(of)).cast("int")).over(w.upto()) for n, of in (("vol", "vol_regime_class"), ("mom", "_sign"), ("dir", "_dir"))})
    since = lambda n: F.row_number().over(Window.partitionBy(w.ENTITY, f"_run_{n}").orderBy(w.TIME)) - 1
    made = {
        "trend_alignment": w.flag(F.signum("_mom") == F.signum("_mom63")),
        "trend_regime_score": F.when(F.coalesce(c("trend_strength_21") < 0.5, F.lit(True)), 0.0).otherwise(F.coalesce(c("_sign") * (1 + w.flag(c("trend_strength_21") > 1.0)), F.lit(0.0))),
        "vol_regime_duration": since("vol").cast("double"),
        "days_since_mom_flip": since("mom").cast("double"),
        "price_streak": (since("dir") + 1) * c("_dir"),
        "pct_from_52w_high": w.ratio(close, w.most(close, 252, 126)) - 1,
        "pct_from_52w_low": w.ratio(close, w.fewest(close, 252, 126)) - 1,
    }
    made |= {f"price_z_{n}": w.zscore(close, n, n // 2) for n in (50, 200)}
    for n in (21, 63):
        varies = F.var_pop("close").over(w.last(n)) > 0
        made[f"trend_r2_{n}"] = F.when(varies, w.guarded(F.regr_r2(close, c("_n")), close, n, n // 2))
    return df.withColumns(made)


def _below(values: Column, limit: Column) -> Column:
    return F.filter(values, lambda v: v <= limit)


def market_risk(df: DataFrame, market: str = "mkt") -> DataFrame:
    """Market betas, own volatility, drawdown, tails and correlations against the column ``market``."""
    ret, m, close = c("ret"), c(market), c("close")
    beta = lambda n, least=None: w.cov(ret, m, n, n // 2 if least is None else least) / (w.guarded(F.var_samp(w.pair(m, ret)[0]), w.pair(m, ret)[0], n, max(2, n // 2)) + 1e-10)
    df = df.withColumns({f"beta_mkt_{n}": beta(n) for n in (63, 126, 252)} | {"_top": F.max("close").over(w.upto())})
    df = df.withColumns({"_res": ret - c("beta_mkt_63") * m, "_dd": w.ratio(close, c("_top")) - 1, "_at_top": (close >= c("_top")).cast("int")})
    df = df.withColumn("_peak_run", F.sum("_at_top").over(w.upto()))
    made = {"beta_stability_126": w.std(c("beta_mkt_63"), 126, 63), "days_since_peak": (F.row_number().over(Window.partitionBy(w.ENTITY, "_peak_run").orderBy(w.TIME)) - 1).cast("double")}
    made |= {f"idio_vol_{n}": w.std(c("_res"), n, n // 2) for n in (63, 126)}
    made["idio_ratio_63"] = w.std(c("_res"), 63, 31) / (w.std(ret, 63, 31) + 1e-10)
    made |= {f"semi_vol_{n}": w.std(F.least(ret, F.when(ret.isNotNull(), 0.0)), n, n // 2) for n in (63, 126)}
    made |= {f"max_dd_{n}": w.fewest(c("_dd"), n, n // 2) for n in (63, 126, 252)}
    down, up = F.when(m < 0, ret), F.when(m > 0, ret)
    for n in (63, 126):
        limit = w.quantile(ret, 0.05, n, n // 2)
        tail = F.collect_list("ret").over(w.last(n))
        made[f"var_5pct_{n}"] = limit
        low = _below(tail, limit)
        made[f"cvar_5pct_{n}"] = F.try_divide(F.aggregate(low, F.lit(0.0), lambda a, v: a + v), F.when(limit.isNotNull(), F.size(low)))
        made[f"corr_mkt_{n}"] = w.corr(ret, m, n, n // 2)
        made[f"down_corr_{n}"] = w.corr(down, m, n, n // 4)
    made["corr_asymmetry_63"] = w.corr(down, m, 63, 15) - w.corr(up, m, 63, 15)
    return df.withColumns(made)


def reference_risk(df: DataFrame, reference: str = "mkt", spans=(21, 63, 126)) -> DataFrame:
    """Beta, downside beta, own volatility, r squared and drawdown correlation against a reference return."""
    ret, m = c("ret"), c(reference)

    def beta(x: Column, y: Column, n: int, least: int) -> Column:
        y_ = w.pair(y, x)[0]
        return w.cov(x, y, n, least) / (w.guarded(F.var_samp(y_), y_, n, max(2, least)) + 1e-10)

    down_x, down_y = F.when(m < 0, ret), F.when(m < 0, m)
    df = df.withColumns({f"beta_ref_{n}": beta(ret, m, n, n // 2) for n in spans} | {f"downside_beta_{n}": beta(down_x, down_y, n, n // 3) for n in spans})
    df = df.withColumns({f"_res_{n}": ret - c(f"beta_ref_{n}") * m for n in spans})
    for name, of in (("_own", ret), ("_ref", m)):
        df = df.withColumn(name, F.when(of.isNotNull(), F.exp(F.sum(F.log1p(of)).over(w.upto()))))
        df = df.withColumn(f"{name}_dd", w.ratio(c(name), F.max(name).over(w.upto())) - 1)
    made = {}
    for n in spans:
        own = w.std(c(f"_res_{n}"), n, n // 2)
        made[f"idio_ref_{n}"] = own
        value = 1 - F.pow(own, 2) / (F.pow(w.std(ret, n, n // 2), 2) + 1e-10)
        made[f"r2_ref_{n}"] = F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
        made[f"dd_corr_{n}"] = w.corr(c("_own_dd"), c("_ref_dd"), n, n // 2)
        made[f"corr_ref_{n}"] = w.corr(ret, m, n, n // 2)
    return df.withColumns(made)


def pair_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """(dt, value): mean return of two entities on the dates on which both have one."""
    both = df.where(c("ticker").isin(a, b) & c("ret").isNotNull()).groupBy("dt").agg(F.max(F.when(c("ticker") == a, c("ret"))).alias("_a"), F.max(F.when(c("ticker") == b, c("ret"))).alias("_b"))
    return both.where("_a is not null and _b is not null").select("dt", ((c("_a") + c("_b")) / 2).alias("value"))


def relative_strength(df: DataFrame, reference: str, spans=(21, 63, 126), name: str = "rs") -> DataFrame:
    """Sums of returns over a reference's over each span, and their z-scores over a year of rows."""
    gap = c("ret") - c(reference)
    df = df.withColumns({f"{name}_{n}": F.when(F.count("ret").over(w.last(n)) >= n // 2, F.sum(gap).over(w.last(n))) for n in spans})
    return df.withColumns({f"{name}_{n}_z": w.zscore(c(f"{name}_{n}"), 252, 126) for n in spans})


def forward_returns(df: DataFrame, spans=(1, 5, 21)) -> DataFrame:
    return df.withColumns({f"fwd_{n}": w.ratio(F.lead("close", n).over(w.history()), c("close")) - 1 for n in spans})


def forward_risk(df: DataFrame, k: float = 2.0) -> DataFrame:
    """Next volatility over one and five rows, and whether the next return is in the left tail."""
    ret, year = c("ret"), math.sqrt(252)
    after = w.history().rowsBetween(1, 5)
    sq = F.pow(ret, 2)
    df = df.withColumns({"_sd": w.std(ret, 20, 10), "_next": F.lead("ret").over(w.history())})
    return df.withColumns(
        {
            "rv_1": F.abs(c("_next")) * year,
            "rv_5": F.when(F.count(sq).over(after) >= 3, F.sqrt(F.avg(sq).over(after))) * year,
            "tail_event": F.when(c("_next").isNotNull() & c("_sd").isNotNull(), (c("_next") < -k * c("_sd")).cast("double")),
        }
    )


def filled(df: DataFrame, name: str, limit: int | None = None) -> Column:
    """``name`` carried forward along an entity, over at most ``limit`` missing rows."""
    value = F.last(name, True).over(w.upto())
    if limit is None:
        return value
    row = F.row_number().over(w.history())
    return F.when(row - F.last(F.when(c(name).isNotNull(), c("_row")), True).over(w.upto()) <= limit, value)


def drawdown(df: DataFrame, growth: str = "growth") -> DataFrame:
    """Drawdown from the running peak of ``growth``, deepest so far, and length of the present run under water."""
    df = df.withColumn("dd", w.ratio(c(growth), F.max(growth).over(w.upto())) - 1)
    df = df.withColumn("_island", F.sum((c("dd") >= 0).cast("int")).over(w.upto()))
    length = F.sum((c("dd") < 0).cast("int")).over(Window.partitionBy(w.ENTITY, "_island").orderBy(w.TIME).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"max_dd": F.min("dd").over(w.upto()), "underwater": length.cast("long")})
