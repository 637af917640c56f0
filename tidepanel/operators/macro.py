"""Groups of macro-economic columns from aligned series: one row a date, so windows over all dates are small.

Every group needs its series and is left out where one is missing. Rows are those of the panel's calendar, on
which slower series have been carried forward: a month, a quarter and a year are numbers of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.regime import dates, rolled

c = F.col


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double")


class Rows:
    """Lengths in rows of the calendar."""

    def __init__(self, month: int = 21, quarter: int = 63, year: int = 252) -> None:
        self.month, self.quarter, self.year = month, quarter, year

    def lag(self, x: str, n: int) -> Column:
        return F.lag(x, n).over(Window.orderBy("dt"))

    def change(self, x: str, n: int) -> Column:
        return c(x) - self.lag(x, n)

    def growth(self, x: str, n: int) -> Column:
        return F.try_divide(c(x), self.lag(x, n)) - 1

    def z(self, x: str) -> Column:
        half = self.year // 2
        return (c(x) - rolled(F.avg, c(x), self.year, half)) / (rolled(F.stddev, c(x), self.year, half) + 1e-8)

    def above(self, x: str, share: float, n: int) -> Column:
        """Whether the value is above a quantile of its last n rows, which must all be there."""
        return flag(c(x) > rolled(lambda v: F.percentile(v, F.lit(share)), c(x), n))

    def place(self, x: str) -> Column:
        """Percent rank of the value among its last year's, ties at their mean."""
        seen = F.collect_list(x).over(dates(self.year))
        less, same = F.size(F.filter(seen, lambda v: v < c(x))), F.size(F.filter(seen, lambda v: v == c(x)))
        return F.when(c(x).isNotNull() & (F.size(seen) >= self.year // 2), (less + (same + 1) / F.lit(2.0)) / F.size(seen))


def macro_groups(df: DataFrame, rows: Rows | None = None) -> DataFrame:
    """Add all groups whose series ``df`` (dt and a column a series) has."""
    r, have = rows or Rows(), set(df.columns)
    made: list[dict[str, Column]] = [{}, {}, {}]

    def add(step: int, needs: str, **columns) -> bool:
        fine = have.issuperset(needs.split())
        if fine:
            made[step] |= columns
        return fine

    def spread(name: str, needs: str, value, z: str) -> bool:
        """A level and its z-score."""
        add(1, needs, **{z: lambda: r.z(name)})
        return add(0, needs, **{name: value})

    # yield curve
    spread("yc_slope_10_2", "tsy_10y tsy_2y", lambda: c("tsy_10y") - c("tsy_2y"), "yc_slope_zscore")
    add(1, "tsy_10y tsy_2y", yc_slope_momentum_21=lambda: r.change("yc_slope_10_2", r.month), yc_inverted=lambda: flag(c("yc_slope_10_2") < 0))
    add(0, "tsy_30y tsy_10y tsy_2y", yc_curvature=lambda: c("tsy_2y") + c("tsy_30y") - 2 * c("tsy_10y"))
    add(0, "tsy_10y breakeven_10y", real_rate_10y=lambda: c("tsy_10y") - c("breakeven_10y"))
    spread("yc_slope_10_3mo", "tsy_10y tsy_3mo", lambda: c("tsy_10y") - c("tsy_3mo"), "yc_slope_10_3mo_zscore")
    add(1, "tsy_10y tsy_3mo", yc_inverted_3mo=lambda: flag(c("yc_slope_10_3mo") < 0))
    add(0, "tsy_3mo", short_rate_3mo=lambda: c("tsy_3mo"))
    # credit
    add(0, "hy_spread", hy_spread_momentum_21=lambda: r.change("hy_spread", r.month), hy_spread_zscore=lambda: r.z("hy_spread"), credit_stress=lambda: r.above("hy_spread", 0.8, r.year))
    add(0, "hy_spread ig_spread", quality_spread=lambda: c("hy_spread") - c("ig_spread"))
    spread("baa_aaa_spread", "baa_yield aaa_yield", lambda: c("baa_yield") - c("aaa_yield"), "baa_aaa_spread_zscore")
    add(1, "baa_yield aaa_yield", baa_aaa_spread_momentum_21=lambda: r.change("baa_aaa_spread", r.month), credit_stress_baa_aaa=lambda: r.above("baa_aaa_spread", 0.8, r.year))
    # conditions
    add(0, "chicago_fci", fci=lambda: c("chicago_fci"), fci_momentum_21=lambda: r.change("chicago_fci", r.month), fci_tight=lambda: flag(c("chicago_fci") > 0))
    add(0, "stl_fsi", fsi=lambda: c("stl_fsi"), fsi_stress=lambda: flag(c("stl_fsi") > 0))
    # sentiment and uncertainty
    add(0, "umich_sentiment", consumer_sentiment=lambda: c("umich_sentiment"), sentiment_momentum_63=lambda: r.change("umich_sentiment", r.quarter), sentiment_zscore=lambda: r.z("umich_sentiment"))
    add(0, "epu_daily", epu=lambda: c("epu_daily"), epu_zscore=lambda: r.z("epu_daily"), epu_spike=lambda: r.above("epu_daily", 0.9, r.year))
    # labour: four rows, whatever the calendar
    add(0, "initial_claims", claims_4wk_ma=lambda: rolled(F.avg, c("initial_claims"), 4, 2))
    add(1, "initial_claims", claims_momentum_4w=lambda: r.growth("claims_4wk_ma", 4), claims_zscore=lambda: r.z("claims_4wk_ma"))
    add(0, "unemployment_rate", unemployment_change_12m=lambda: r.change("unemployment_rate", r.year), unemployment_zscore=lambda: r.z("unemployment_rate"), unemployment_elevated=lambda: r.above("unemployment_rate", 0.75, r.year))
    # growth and inflation over a year, in per cent
    for series, name in (("indpro", "indpro_yoy"), ("retail_sales", "retail_yoy"), ("cpi_index", "cpi_yoy"), ("pce_index", "pce_yoy")):
        spread(name, series, lambda s=series: r.growth(s, r.year) * 100, f"{name}_zscore")
    add(1, "indpro", growth_positive=lambda: flag(c("indpro_yoy") > 0))
    add(1, "cpi_index", inflation_high=lambda: r.above("cpi_yoy", 0.8, 2 * r.year))
    add(0, "breakeven_10y", breakeven_10y_zscore=lambda: r.z("breakeven_10y"))
    # composite of curve, credit and implied volatility
    add(0, "vix", vix_zscore=lambda: r.z("vix"))
    step = lambda x, good, bad: F.when(good(x), 1).when(bad(x), -1).otherwise(0)
    if add(
        2,
        "tsy_10y tsy_2y hy_spread vix",
        macro_regime_score=lambda: (
            step(c("yc_slope_10_2"), lambda x: x > 0.5, lambda x: x < 0) + step(c("_place"), lambda x: x < 0.3, lambda x: x > 0.7) + step(c("vix_zscore"), lambda x: x < -0.5, lambda x: x > 1)
        ).cast("double"),
    ):
        made[1]["_place"] = lambda: r.place("hy_spread")
        made.append({"risk_on": lambda: flag(c("macro_regime_score") >= 2), "risk_off": lambda: flag(c("macro_regime_score") <= -2)})
    for columns in made:
        if columns:
            df = df.withColumns({k: v() for k, v in columns.items()})
    return df.drop("_place")
