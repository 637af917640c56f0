"""Statistics of period returns, comparison with a benchmark, attribution, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def statistics(periods: DataFrame, ret: str = "net_ret", horizon: int = 21, free: float = 0.0, order: str = "window_id") -> DataFrame:
    """One row: totals, yearly figures, ratios, tails, drawdown and win statistics."""
    per_year = 252.0 / horizon
    r = c(ret)
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = periods.select(order, r.alias("r")).withColumn("growth", F.product(1 + c("r")).over(upto))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("growth").over(upto))).withColumn("dd", c("growth") / c("peak") - 1)
    limit = df.agg(F.percentile("r", F.lit(0.05)).alias("var_05"))
    df = df.crossJoin(F.broadcast(limit))
    excess = c("r") - free / per_year
    n = F.count("r")
    out = df.agg(
        n.alias("n"),
        (F.product(1 + c("r")) - 1).alias("total"),
        (F.avg("r") * per_year).alias("annual"),
        (F.stddev("r") * math.sqrt(per_year)).alias("vol"),
        F.try_divide(F.avg(excess) * math.sqrt(per_year), F.stddev("r")).alias("sharpe"),
        F.try_divide(F.avg(excess) * math.sqrt(per_year), F.sqrt(F.avg(F.pow(F.least(excess, F.lit(0.0)), 2)))).alias("sortino"),
        F.min("dd").alias("max_dd"),
        F.try_divide(F.sum(F.greatest(c("r"), F.lit(0.0))), -F.sum(F.least(c("r"), F.lit(0.0)))).alias("omega"),
        F.max("var_05").alias("var_05"),
        F.avg(F.when(c("r") <= c("var_05"), c("r"))).alias("cvar_05"),
        F.avg((c("r") > 0).cast("double")).alias("win_rate"),
        F.avg(F.when(c("r") > 0, c("r"))).alias("mean_win"),
        F.avg(F.when(c("r") < 0, c("r"))).alias("mean_loss"),
        F.max("r").alias("best"),
        F.min("r").alias("worst"),
        (F.skewness("r") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))).alias("skew"),
        (((n + 1) * F.kurtosis("r") + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))).alias("kurt"),
    )
    return out.withColumn("calmar", F.try_divide(c("annual"), -c("max_dd")))


def against(periods: DataFrame, ret: str, bench: str, horizon: int = 21) -> DataFrame:
    """One row: excess, tracking error, information ratio, beta, alpha, correlation, captures of both totals."""
    per_year = 252.0 / horizon
    df = periods.select(c(ret).alias("r"), c(bench).alias("b")).where("r is not null and b is not null").withColumn("d", c("r") - c("b"))
    beta = F.try_divide(F.covar_samp("r", "b"), F.var_samp("b"))
    return df.agg(
        F.count("*").alias("n"),
        (F.avg("d") * per_year).alias("excess"),
        (F.stddev("d") * math.sqrt(per_year)).alias("tracking"),
        F.try_divide(F.avg("d") * math.sqrt(per_year), F.stddev("d")).alias("info_ratio"),
        beta.alias("beta"),
        ((F.avg("r") - beta * F.avg("b")) * per_year).alias("alpha"),
        F.try_divide(F.covar_samp("r", "b"), F.stddev("r") * F.stddev("b")).alias("corr"),
        F.try_divide(F.avg(F.when(c("b") > 0, c("r"))), F.avg(F.when(c("b") > 0, c("b")))).alias("up_capture"),
        F.try_divide(F.avg(F.when(c("b") < 0, c("r"))), F.avg(F.when(c("b") < 0, c("b")))).alias("down_capture"),
        (F.product(1 + c("b")) - 1).alias("bench_total"),
    )


def by_group(periods: DataFrame, key: str, ret: str = "net_ret") -> DataFrame:
    return periods.groupBy(key).agg(F.count("*").alias("n"), F.avg(ret).alias("mean"), F.stddev(ret).alias("sd"), (F.product(1 + c(ret)) - 1).alias("total"), F.avg((c(ret) > 0).cast("double")).alias("win_rate"))


def trend(periods: DataFrame, y: str, order: str = "window_id") -> DataFrame:
    """One row: slope, level and fit of a metric over the windows in order, and its t statistic."""
    df = periods.where(c(y).isNotNull()).withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    slope = F.regr_slope(c(y), c("_i"))
    out = df.agg(F.count("*").alias("n"), slope.alias("slope"), F.regr_intercept(c(y), c("_i")).alias("level"), F.when(F.var_pop(y) > 0, F.regr_r2(c(y), c("_i"))).alias("r2"))
    return out.withColumn("t", F.when((c("n") > 2) & (c("r2") < 1), F.signum("slope") * F.sqrt(c("r2") * (c("n") - 2) / (1 - c("r2")))))


def feature_attribution(models: DataFrame, periods: DataFrame, windows: int) -> DataFrame:
    """(feature, frequency, ic_mean, ic_std, presence_corr, score) from models (window_id, features, train_ic)."""
    used = models.select("window_id", "train_ic", F.explode("features").alias("feature"))
    stats = used.groupBy("feature").agg((F.countDistinct("window_id") / F.lit(float(windows))).alias("frequency"), F.avg("train_ic").alias("ic_mean"), F.stddev("train_ic").alias("ic_std"))
    names = used.select("feature").distinct()
    grid = names.crossJoin(F.broadcast(periods.select("window_id", "net_ret")))  # features x windows of one study
    marked = grid.join(used.select("window_id", "feature", F.lit(1.0).alias("here")), ["window_id", "feature"], "left").withColumn("here", F.coalesce("here", F.lit(0.0)))
    presence = marked.groupBy("feature").agg(F.try_divide(F.covar_samp("here", "net_ret"), F.stddev("here") * F.stddev("net_ret")).alias("presence_corr"))
    steady = 1 - F.least(F.coalesce(c("ic_std"), F.lit(0.0)) / 0.5, F.lit(1.0))
    return stats.join(presence, "feature", "left").withColumn("score", c("frequency") * F.abs("ic_mean") * steady)


def drawn(*names, seed: int) -> Column:
    """A number below 2 ** 60 that the named columns decide: the same on every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.col(n).cast("string") if isinstance(n, str) else n.cast("string") for n in names), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def block_bootstrap(periods: DataFrame, ret: str = "net_ret", trials: int = 1000, block: int = 6, seed: int = 42, horizon: int = 21) -> DataFrame:
    """(trial, total, sharpe) of resampled histories, made of blocks of consecutive periods.

    Block starts are hashes of trial and place, so that a run repeats exactly. The history, a row a
    period, is sent to all tasks; trials are spread over them.
    """
    spark = periods.sparkSession
    rows = [float(r[0]) for r in periods.orderBy("window_id").select(ret).collect()]  # a row a period
    n = len(rows)
    parts = -(-n // block)
    history = F.array(*(F.lit(v) for v in rows))
    df = spark.range(trials).withColumnRenamed("id", "trial").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    start = F.pmod(drawn("trial", "part", seed=seed), F.lit(max(1, n - block + 1)))
    df = df.withColumn("r", F.explode(F.slice(history, start.cast("int") + 1, F.least(F.lit(block), F.lit(n) - c("part") * block))))
    return df.groupBy("trial").agg((F.product(1 + c("r")) - 1).alias("total"), F.try_divide(F.avg("r") * math.sqrt(252.0 / horizon), F.stddev("r")).alias("sharpe"))


def random_books(returns: DataFrame, trials: int = 1000, size: int = 10, seed: int = 7, horizon: int = 21) -> DataFrame:
    """(trial, total, sharpe): mean return of ``size`` random entities at each date, compounded and by its deviation; (dt, ticker, ret) in.

    A date's returns are one list; each trial orders it by hashes and takes the first ones, without an exchange of
    entities times trials.
    """
    lists = returns.where("ret is not null").groupBy("dt").agg(F.collect_list(F.struct("ticker", "ret")).alias("all"))
    rows = lists.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    order = F.sort_array(F.transform("all", lambda x: F.struct(F.md5(F.concat_ws(":", F.col("trial").cast("string"), F.col("dt").cast("string"), x["ticker"], F.lit(str(seed)))).alias("h"), x["ret"].alias("ret"))))
    picked = F.transform(F.slice(order, 1, size), lambda x: x["ret"])
    daily = rows.select("trial", (F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / F.size(picked)).alias("r"))
    return daily.groupBy("trial").agg((F.product(1 + c("r")) - 1).alias("total"), F.try_divide(F.avg("r") * math.sqrt(252.0 / horizon), F.stddev("r")).alias("sharpe"))


def shuffled(periods: DataFrame, ret: str = "net_ret", trials: int = 1000, seed: int = 11, horizon: int = 21) -> DataFrame:
    """(trial, sharpe, max_dd) of the periods in random orders: the order changes neither mean nor deviation, only the way there."""
    lists = periods.agg(F.collect_list(F.struct("window_id", F.col(ret).alias("r"))).alias("all"))  # a row a period
    rows = lists.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn(
        "order", F.sort_array(F.transform("all", lambda x: F.struct(F.md5(F.concat_ws(":", F.col("trial").cast("string"), x["window_id"].cast("string"), F.lit(str(seed)))).alias("h"), x["r"].alias("r"))))
    )
    step = lambda a, x: F.struct(
        (a["g"] * (1 + x["r"])).alias("g"), F.greatest(a["top"], a["g"] * (1 + x["r"])).alias("top"), F.least(a["dd"], a["g"] * (1 + x["r"]) / F.greatest(a["top"], a["g"] * (1 + x["r"])) - 1).alias("dd")
    )
    start = F.struct(F.lit(1.0).alias("g"), F.lit(1.0).alias("top"), F.lit(0.0).alias("dd"))
    rows = rows.withColumn("max_dd", F.aggregate("order", start, step)["dd"])
    return rows.select("trial", "max_dd", F.explode("order").alias("x")).groupBy("trial").agg(F.try_divide(F.avg("x.r") * math.sqrt(252.0 / horizon), F.stddev("x.r")).alias("sharpe"), F.max("max_dd").alias("max_dd"))


def against_random(books: DataFrame, periods: DataFrame, ret: str = "net_ret", horizon: int = 21) -> DataFrame:
    """``books`` with what ``periods`` reached, the shares of books that reach as much (p_value_*), and the percentile by Sharpe; a Sharpe without deviation counts as 0."""
    year = math.sqrt(252.0 / horizon)
    actual = periods.agg((F.product(1 + c(ret)) - 1).alias("actual_total"), F.coalesce(F.try_divide(F.avg(ret) * year, F.stddev(ret)), F.lit(0.0)).alias("actual_sharpe"))
    both = books.crossJoin(F.broadcast(actual))  # one row
    share = lambda hit: F.avg(hit.cast("int"))
    p = both.agg(share(c("total") >= c("actual_total")).alias("p_value_return"), share(F.coalesce("sharpe", F.lit(0.0)) >= c("actual_sharpe")).alias("p_value_sharpe"))
    return both.crossJoin(F.broadcast(p)).withColumn("percentile", (1 - c("p_value_sharpe")) * 100)


def power(periods: DataFrame, ret: str = "net_ret", horizon: int = 21) -> DataFrame:
    """One row: yearly Sharpe, its standard error and the least effect that the sample could show."""
    out = periods.agg(F.count(ret).alias("n"), F.try_divide(F.avg(ret), F.stddev(ret)).alias("_s"))
    year = math.sqrt(252.0 / horizon)
    return out.select("n", (c("_s") * year).alias("sharpe"), (F.sqrt((1 + c("_s") * c("_s") / 2) / c("n")) * year).alias("se"), (2.8 * F.sqrt((1 + c("_s") * c("_s") / 2) / c("n")) * year).alias("mde"))


def by_family(book: DataFrame, periods: DataFrame) -> DataFrame:
    """(family, n_long, n_short, mean_long, mean_short, contribution): positions, mean sizes, and period returns times weights."""
    held = book.join(F.broadcast(periods.select("window_id", "net_ret")), "window_id")
    of = lambda s, call, v: F.coalesce(call(F.when(F.col("side") == s, v)), F.lit(0.0))
    return held.groupBy("family").agg(
        F.count(F.when(F.col("side") == "long", 1)).alias("n_long"),
        F.count(F.when(F.col("side") == "short", 1)).alias("n_short"),
        of("long", F.avg, F.col("w")).alias("mean_long"),
        of("short", F.avg, -F.col("w")).alias("mean_short"),
        F.sum(F.col("net_ret") * F.col("w")).alias("contribution"),
    )
