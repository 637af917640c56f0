"""Feature lab: gates and metrics of stand-alone selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import ic as ics

c = F.col


def quality(df: DataFrame, features: list[str], coverage: float = 0.85, outliers: float = 0.01, tiny: float = 1e-8) -> DataFrame:
    """(feature, coverage, outliers, sd, quality): the first data-quality check that each feature fails, or null."""
    values = ics.long(df, features)
    values = values.withColumns({"_m": F.avg("value").over(Window.partitionBy("feature")), "_s": F.stddev("value").over(Window.partitionBy("feature"))})
    far = F.abs(c("value") - c("_m")) > 10 * c("_s")
    out = values.groupBy("feature").agg(F.avg(c("value").isNotNull().cast("int")).alias("coverage"), F.avg(F.when(c("value").isNotNull(), F.coalesce(far, F.lit(False)).cast("int"))).alias("outliers"), F.max("_s").alias("sd"))
    reason = F.when(c("coverage") < coverage, "coverage").when(c("outliers") > outliers, "outliers").when(F.coalesce(c("sd") < tiny, F.lit(True)), "constant")
    return out.withColumn("quality", reason)


def residual_ic(df: DataFrame, x: str, benchmark: str, y: str) -> DataFrame:
    """(dt, ic, n): rank correlation of y with what is left of x after a regression on the benchmark, date by date."""
    rows = df.select("dt", "ticker", c(x).alias("_x"), c(benchmark).alias("_b"), c(y).alias("_y")).dropna()
    over = w.section()
    slope = F.try_divide(F.covar_samp("_b", "_x").over(over), F.var_samp("_b").over(over))
    rows = rows.withColumn("_slope", slope).withColumn("_e", c("_x") - c("_slope") * c("_b") - (F.avg("_x").over(over) - c("_slope") * F.avg("_b").over(over)))
    rows = rows.where("_e is not null").withColumns({"rx": w.percent_rank(c("_e")), "ry": w.percent_rank(c("_y"))})
    return rows.groupBy("dt").agg(ics.safe_corr(c("rx"), c("ry")).alias("ic"), F.count("*").alias("n")).where("n >= 3")


def daily_auc(df: DataFrame, x: str, hit: str) -> DataFrame:
    """(dt, auc): area under the curve of x for the event, from ranks, folded at a half."""
    rows = df.where(c(x).isNotNull() & c(hit).isNotNull())
    rank = F.rank().over(w.section().orderBy(x)) + (F.count("*").over(Window.partitionBy("dt", x)) - 1) / F.lit(2.0)
    n1, n = F.sum(hit), F.count("*")
    area = F.try_divide(F.sum(F.when(c(hit) == 1, c("_r"))) - n1 * (n1 + 1) / F.lit(2.0), n1 * (n - n1))
    out = rows.withColumn("_r", rank).groupBy("dt").agg(area.alias("auc")).where("auc is not null")
    return out.withColumn("auc", F.greatest("auc", 1 - c("auc")))


def alpha_gates(df: DataFrame, features: list[str], target: str, floor: float = 0.02, t: float = 2.5, segments: int = 4, share: float = 0.75) -> DataFrame:
    """(feature, coverage, ic_mean, t_nw, sign_share, gate): gate is the first that fails, or passed."""
    from tidepanel.operators.selection import _positions

    ic = ics.daily_ic(df, features, target, least=20)
    tested = ics.newey_west(ic)
    parts = ic.join(F.broadcast(_positions(ic, segments, "segment")), "dt").groupBy("feature", "segment").agg(F.avg("ic").alias("m"))
    signs = parts.join(tested.select("feature", "ic_mean"), "feature").groupBy("feature").agg(F.avg((F.signum("m") == F.signum("ic_mean")).cast("int")).alias("sign_share"))
    out = quality(df, features).join(tested, "feature", "left").join(signs, "feature", "left")
    gate = (
        F.when(c("quality").isNotNull(), c("quality"))
        .when(F.coalesce(c("n"), F.lit(0)) < 100, "dates")
        .when(F.abs("ic_mean") < floor, "ic")
        .when(F.abs("t_nw") < t, "t")
        .when(c("sign_share") < share, "sign")
        .otherwise("passed")
    )
    return out.select("feature", "coverage", "outliers", "sd", "ic_mean", "t_nw", "sign_share", gate.alias("gate"))


def alpha_metrics(df: DataFrame, features: list[str], target: str, market: DataFrame, least: int = 20, share: float = 0.2, horizon: int = 21, days: int = 20) -> DataFrame:
    """(feature, ic_abs, long_tail, spread_sharpe, turnover, stress_ic), all features in one pass over long rows.

    The top and bottom ``share`` of a date's ranking are cut by position, ties by ticker, on dates of ``least`` values. long_tail: mean of the top over
    all; spread_sharpe: yearly ratio of top less bottom; turnover: mean share of the top that was not on top at the feature's
    date before; stress_ic: mean coefficient on dates on which ``market`` (dt, mkt) fell, null with fewer than ``days`` of them.
    """
    rows = ics.long(df.withColumn("_y", c(target)), features, ("dt", "ticker", "_y")).where("value is not null and _y is not null")
    ic = ics.section_ic(rows).join(F.broadcast(market.select("dt", "mkt")), "dt", "left")  # a row a date
    fell = (c("mkt") < 0) & c("ic").isNotNull()
    ic = ic.groupBy("feature").agg(F.abs(F.avg("ic")).alias("ic_abs"), F.when(F.count(F.when(fell, 1)) >= days, F.avg(F.when(fell, c("ic")))).alias("stress_ic"))
    of = Window.partitionBy("dt", "feature")
    rows = rows.withColumns({"_n": F.count("*").over(of), "_up": F.row_number().over(of.orderBy(F.desc("value"), "ticker")), "_down": F.row_number().over(of.orderBy("value", "ticker"))})
    rows = rows.where(c("_n") >= least).withColumn("_k", F.greatest(F.lit(1), F.floor(c("_n") * share)))
    daily = rows.groupBy("feature", "dt").agg(F.avg(F.when(c("_up") <= c("_k"), c("_y"))).alias("top"), F.avg(F.when(c("_down") <= c("_k"), c("_y"))).alias("low"), F.avg("_y").alias("mid"))
    gap = c("top") - c("low")
    out = daily.groupBy("feature").agg(F.avg(c("top") - c("mid")).alias("long_tail"), F.try_divide(F.avg(gap), F.stddev(gap)).alias("_s"))
    out = out.select("feature", "long_tail", (c("_s") * (252.0 / horizon) ** 0.5).alias("spread_sharpe"))
    place = rows.withColumn("_d", F.dense_rank().over(Window.partitionBy("feature").orderBy("dt"))).where(c("_up") <= c("_k"))
    before = F.lag("_d").over(Window.partitionBy("feature", "ticker").orderBy("dt"))
    new = place.withColumn("_new", F.when(before == c("_d") - 1, 0).otherwise(1)).where(c("_d") > 1).groupBy("feature", "dt").agg(F.avg("_new").alias("t"))
    return ic.join(out, "feature", "left").join(new.groupBy("feature").agg(F.avg("t").alias("turnover")), "feature", "left").select("feature", "ic_abs", "long_tail", "spread_sharpe", "turnover", "stress_ic")


def composite(metrics: DataFrame, weights: dict[str, float], lower_better: tuple[str, ...] = ()) -> DataFrame:
    """Add composite: weighted sum of percentiles 0 to 100 of each metric, 50 where it is missing."""
    made = {}
    for m in weights:
        order = F.asc(m) if m in lower_better else F.desc(m)
        over = Window.partitionBy(c(m).isNotNull())
        place = F.row_number().over(over.orderBy(order, "feature")) - 1
        made[f"_p_{m}"] = F.when(c(m).isNull(), 50.0).otherwise(F.coalesce(100.0 * (1 - F.try_divide(place, F.count(m).over(over) - 1)), F.lit(100.0)))
    total = F.lit(0.0)
    for m, k in weights.items():
        total = total + c(f"_p_{m}") * k
    return metrics.withColumns(made).withColumn("composite", total).drop(*made)
