"""Market regimes and series of the whole market: one row a date, so single windows over dates are small."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def dates(n: int | None = None):
    order = Window.orderBy("dt")
    return order.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)


def rolled(call, x: Column, n: int, least: int | None = None) -> Column:
    return F.when(F.count(x).over(dates(n)) >= (n if least is None else least), call(x).over(dates(n)))


def zscore(x: Column, n: int = 252, least: int = 126) -> Column:
    return (x - rolled(F.avg, x, n, least)) / (rolled(F.stddev, x, n, least) + 1e-8)


def market_state(market: DataFrame, ma: int = 200, span: int = 63, limit: float = 0.02) -> DataFrame:
    """Add ma, ret_span, vol and state of a market series (dt, close): bull, bear or range."""
    order = Window.orderBy("dt")
    df = market.withColumns({"_r": c("close") / F.lag("close").over(order) - 1, "ma": rolled(F.avg, c("close"), ma), "ret_span": c("close") / F.lag("close", span).over(order) - 1})
    above = F.coalesce(c("close") > c("ma"), F.lit(False))  # without an average a price is not above it
    state = F.when(above & (c("ret_span") > limit), "bull").when(~above & (c("ret_span") < -limit), "bear").otherwise("range")
    return df.withColumns({"vol": rolled(F.stddev, c("_r"), 21), "state": state}).drop("_r")


def steadied(states: DataFrame, stay: int = 21) -> DataFrame:
    """Add regime: the state, changed only after ``stay`` rows in the present one; it starts as range."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("dt")
        now, held, out = "range", 0, []
        for i, state in enumerate(part["state"]):
            if i and state != now and held >= stay:
                now, held = state, 0
            held += 1
            out.append(now)
        return pd.DataFrame({"dt": part["dt"], "regime": out})

    one = states.select("dt", "state").withColumn("_k", F.lit(0)).groupBy("_k").applyInPandas(run, "dt date, regime string")  # one market: a row a date
    return states.join(one, "dt")


def lagged(regime: str = "regime") -> Column:
    """The regime known before each date."""
    return F.coalesce(F.lag(regime).over(Window.orderBy("dt")), F.lit("range"))


def trading_mode(regime: Column) -> Column:
    return F.when(regime == "bull", "long_only").when(regime == "bear", "short_only").when(regime == "range", "cash").otherwise("ls")


def macro(series: DataFrame) -> DataFrame:
    """Regime flags and composites of a wide frame (dt, price, orders) aligned to the panel's dates."""
    order = Window.orderBy("dt")
    change = c("price") / F.lag("price").over(order) - 1
    df = series.withColumns({"_ch": change, "slope": c("price") - rolled(F.avg, c("price"), 63, 31)})
    df = df.withColumns({"level_z": zscore(c("price")), "orders_z": zscore(c("orders")), "_vol": rolled(F.stddev, c("_ch"), 60, 30)})
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    df = df.withColumns(
        {
            "crash_flag": flag(c("_ch") < -2.5 * c("_vol")),
            "meltup_flag": flag(c("_ch") > 2.5 * c("_vol")),
            "high_level": flag(c("level_z") > 1),
            "low_level": flag(c("level_z") < -1),
            "momentum_21": c("price") - F.lag("price", 21).over(order),
            "yoy": (c("price") / F.lag("price", 52).over(order) - 1) * 100,
            "stress": flag(c("price") > rolled(lambda x: F.percentile(x, F.lit(0.8)), c("price"), 252, 126)),
            "orders_mean_4": rolled(F.avg, c("orders"), 4, 2),
        }
    )
    score = F.signum("slope") + F.signum(F.coalesce("level_z", F.lit(0.0))) - F.signum(F.coalesce("orders_z", F.lit(0.0)))
    return df.withColumn("score", score).withColumns({"risk_on": flag(c("score") >= 2), "risk_off": flag(c("score") <= -2)}).drop("_ch", "_vol")
