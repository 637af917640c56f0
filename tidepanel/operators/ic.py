"""Information coefficients by date, and inference on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import windows as w
from tidepanel.functions.stats import t_two_sided

c = F.col


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate of complete pairs; null without variance."""
    x, y = w.pair(x, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev(x) * F.stddev(y))


def long(df: DataFrame, features: list[str], keep: tuple[str, ...] = ("dt", "ticker")) -> DataFrame:
    """(keep..., feature, value): one narrow row for each value, however many features there are."""
    return df.select(*keep, *(c(f).cast("double").alias(f) for f in features)).unpivot(list(keep), features, "feature", "value")


def daily_ic(df: DataFrame, features: list[str], target: str, least: int = 3, ranked: bool = True) -> DataFrame:
    """(dt, feature, ic, n): rank correlation of each feature with the target across each date.

    Only complete pairs count; ties take average ranks; null without variance or below ``least`` pairs.
    """
    pairs = long(df.withColumn("_y", c(target)), features, ("dt", "ticker", "_y")).where("value is not null and _y is not null")
    return section_ic(pairs, least, ranked)


def section_ic(pairs: DataFrame, least: int = 3, ranked: bool = True) -> DataFrame:
    """As daily_ic, of complete pairs in long form: dt, feature, value, _y."""
    x, y = c("value"), c("_y")
    if ranked:
        pairs = pairs.withColumns({"rx": w.percent_rank(x, keys=("dt", "feature")), "ry": w.percent_rank(y, keys=("dt", "feature"))})
        x, y = c("rx"), c("ry")
    return pairs.groupBy("dt", "feature").agg(safe_corr(x, y).alias("ic"), F.count("*").alias("n")).where(c("n") >= least)


def decay(half_life: float | None, end: Column, dt: Column) -> Column:
    """Weight of a date: halved every ``half_life`` days before the end, or 1."""
    return F.lit(1.0) if half_life is None else F.exp(F.datediff(end, dt) * F.lit(-np.log(2) / half_life))


def newey_west(ic: DataFrame, lags: int = 5, half_life: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., feature, ic_mean, t_nw, n): weighted mean and its t statistic under autocorrelation (Bartlett).

    Lags run over the dates that have a value. Below three values t is 0. ``by``: further keys, such as a window's.
    """
    ic = ic.where("ic is not null")
    of = Window.partitionBy(*by, "feature")
    order = of.orderBy("dt")
    ic = ic.withColumn("_w", decay(half_life, F.max("dt").over(of), c("dt")))
    ic = ic.withColumns({"_n": F.count("*").over(of), "_m": F.sum(c("_w") * c("ic")).over(of) / F.sum("_w").over(of), "_sw": F.sum("_w").over(of)})
    ic = ic.withColumns({"_e": c("ic") - c("_m"), "_v": c("_w") * c("_n") / c("_sw")})
    ic = ic.withColumns({f"_e{k}": F.lag("_e", k).over(order) for k in range(1, lags + 1)})
    out = ic.groupBy(*by, "feature").agg(
        F.max("_n").alias("n"), F.max("_m").alias("ic_mean"), F.sum(c("_v") * c("_e") * c("_e")).alias("_s0"), *(F.sum(c("_v") * c("_e") * c(f"_e{k}")).alias(f"_s{k}") for k in range(1, lags + 1))
    )
    total = c("_s0") / c("n")
    for k in range(1, lags + 1):
        total = total + F.when(c("n") - 1 > k, 2 * (1 - k / (lags + 1)) * F.coalesce(f"_s{k}", F.lit(0.0)) / c("n")).otherwise(0.0)
    error = F.sqrt(F.greatest(total / c("n"), F.lit(1e-20)))
    return out.select(*by, "feature", "ic_mean", F.when(c("n") < 3, 0.0).otherwise(c("ic_mean") / error).alias("t_nw"), "n")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(), df.to_numpy()))


def with_p_values(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p_value", F.when(c("n") > 2, t_p_value(c("t_nw"), (c("n") - 1).cast("double"))).otherwise(1.0))


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", alpha: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """Add p_adjusted and fdr_reject over all rows of a ``by``: one row a hypothesis, so they are few."""
    of = Window.partitionBy(*by)
    up = of.orderBy(p, "feature")
    down = of.orderBy(F.desc(p), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
    tests = tests.withColumns({"_rank": F.row_number().over(up), "_total": F.count("*").over(of)})
    tests = tests.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(c(p) * c("_total") / c("_rank")).over(down)))
    return tests.withColumn("fdr_reject", c("p_adjusted") <= alpha).drop("_rank", "_total")


def block_statistics(ic: DataFrame, size: int = 252, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., feature, block, mean, t, n) over contiguous blocks of about ``size`` dates, two at least."""
    of = Window.partitionBy(*by)
    dates = ic.select(*by, "dt").distinct().withColumns({"_i": F.row_number().over(of.orderBy("dt")) - 1, "_n": F.count("*").over(of)})
    blocks = F.greatest(F.lit(2), F.floor(c("_n") / size))
    # whole-number edges of equal parts: the block of position i is the last whose floor(b * n / blocks) is not beyond i
    dates = dates.select(*by, "dt", blocks.alias("blocks"), (F.ceil((c("_i") + 1) * blocks / c("_n")) - 1).cast("int").alias("block"))
    out = ic.join(F.broadcast(dates), [*by, "dt"]).groupBy(*by, "feature", "block", "blocks").agg(F.round(F.avg("ic"), 12).alias("mean"), F.stddev("ic").alias("_s"), F.count("*").alias("n"))  # what is only rounding has no sign
    return out.withColumn("t", F.when(c("n") > 2, c("mean") / F.greatest(c("_s") / F.sqrt("n"), F.lit(1e-10)))).drop("_s")


def formation(ic: DataFrame, alpha: float = 0.1, floor: float = 0.02, consistency: float = 0.6, block: int = 252, passes: int = 2, block_ic: float = 0.01, block_t: float = 1.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Test every feature (of each ``by``): mean IC, t, p, direction consistency, block persistence, false-discovery control; approved."""
    keys = [*by, "feature"]
    tested = with_p_values(newey_west(ic, by=by))
    parts = block_statistics(ic, block, by).join(tested.select(*keys, F.round("ic_mean", 12).alias("ic_mean")), keys)
    same = (F.signum("mean") == F.signum("ic_mean")) | (c("ic_mean") == 0)
    strong = (F.abs("mean") >= block_ic) | (F.abs(F.coalesce("t", F.lit(0.0))) >= block_t)
    parts = parts.groupBy(*keys).agg(
        (F.count(F.when(same, 1)) / F.max("blocks")).alias("consistency"), F.count(F.when(same & strong, 1)).alias("block_passes"), F.max("blocks").alias("blocks")
    )
    out = benjamini_hochberg(tested.join(parts, keys), alpha=alpha, by=by)
    good = c("fdr_reject") & (F.abs("ic_mean") >= floor) & (c("consistency") >= consistency) & (c("block_passes") >= F.least(F.lit(passes), c("blocks")))
    return out.withColumn("approved", good)


def summary(ic: DataFrame) -> DataFrame:
    """(feature, ic_mean, ic_std, ir, hit_rate, abs_mean, n)."""
    return ic.where("ic is not null").groupBy("feature").agg(
        F.avg("ic").alias("ic_mean"), F.stddev("ic").alias("ic_std"), F.try_divide(F.avg("ic"), F.stddev("ic")).alias("ir"),
        F.avg((c("ic") > 1e-12).cast("double")).alias("hit_rate"), F.avg(F.abs("ic")).alias("abs_mean"), F.count("*").alias("n"),
    )


def pooled_ic(df: DataFrame, features: list[str], target: str, least: int = 3) -> DataFrame:
    """(feature, ic, n): rank correlation over all rows together."""
    pairs = long(df.withColumn("_y", c(target)), features, ("dt", "ticker", "_y")).where("value is not null and _y is not null")
    pairs = pairs.withColumns({"rx": w.percent_rank(c("value"), keys=("feature",)), "ry": w.percent_rank(c("_y"), keys=("feature",))})
    return pairs.groupBy("feature").agg(F.coalesce(F.when(F.count("*") >= least, safe_corr(c("rx"), c("ry"))), F.lit(0.0)).alias("ic"), F.count("*").alias("n"))


def pair_correlations(df: DataFrame, features: list[str], ranked: bool = False) -> DataFrame:
    """(feature_a, feature_b, corr, n) for a < b over complete pairs, in one pass over the wide panel."""
    names = sorted(features)
    if ranked:
        df = df.withColumns({n: w.percent_rank(c(n), keys=()) for n in names})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = []
    for a, b in pairs:
        both = c(a).isNotNull() & c(b).isNotNull()
        sums += [safe_corr(c(a), c(b)).alias(f"{a}|{b}"), F.count(F.when(both, 1)).alias(f"{a}#{b}")]
    one = df.agg(*sums)
    rows = F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), c(f"`{a}|{b}`").alias("corr"), c(f"`{a}#{b}`").alias("n")) for a, b in pairs))
    return one.select(F.inline(rows))
