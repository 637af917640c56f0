"""The walk-forward study: what each rebalance date may know, from daily information coefficients to capital."""

from __future__ import annotations

import tempfile
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w
from tidepanel.operators import ic as ics
from tidepanel.operators import portfolio as pf

c = F.col


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back: windows and features are then filters on the scan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once under spark.checkpoint.dir, and without its history, which long chains would plan again at every use.

    Where that is not set, a session of one machine uses a temporary folder; a cluster raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="tidepanel-"))
    return df.checkpoint()


def learned_weights(ic: DataFrame, grid: DataFrame, days: int = 364, embargo: int = 21, floor: float = 0.02, t: float = 1.96, sign: float = 0.55, least: int = 12) -> DataFrame:
    """(window_id, feature, weight): mean information coefficients over the window's past, of features that pass all gates.

    The past is the ``days`` before the window's date without its last ``embargo`` rows of the calendar, whose labels reach
    beyond it. Gates: size, t-value, share of dates of the mean's sign, number of dates. ``ic``: dt, feature, ic, on
    all dates of the calendar; ``grid``: window_id, at, at_row.
    """
    calendar = ic.select("dt").distinct() if "_row" not in ic.columns else None
    rows = ic.join(F.broadcast(calendar.withColumn("_row", F.row_number().over(Window.orderBy("dt")))), "dt") if calendar is not None else ic
    past = rows.join(F.broadcast(grid), (c("_row") <= c("at_row") - embargo) & (c("dt") >= F.date_sub("at", days)))
    out = past.where("ic is not null").groupBy("window_id", "feature").agg(
        F.count("ic").alias("n"), F.avg("ic").alias("weight"), F.stddev("ic").alias("s"), F.avg((c("ic") > 0).cast("int")).alias("up"), F.avg((c("ic") < 0).cast("int")).alias("down")
    )
    same = F.when(c("weight") > 0, c("up")).otherwise(c("down"))
    fine = (c("n") >= least) & (F.abs("weight") >= floor) & (F.abs(F.try_divide(c("weight"), c("s")) * F.sqrt("n")) >= t) & (same >= sign)
    return out.where(fine).select("window_id", "feature", "weight")


def eligible(df: DataFrame, adv_rank: float = 0.2, history: int = 252) -> DataFrame:
    """Rows of entities that are traded enough on the date and were listed ``history`` days before. ``df``: close and volume."""
    df = df.withColumns({"_adv": F.avg(c("close") * c("volume")).over(w.last(63)), "_first": F.min("dt").over(w.whole())})
    return df.withColumn("_rank", w.percent_rank(c("_adv"))).where((c("_rank") >= adv_rank) & (F.datediff("dt", "_first") >= history)).drop("_adv", "_first", "_rank")


def weighted_scores(df: DataFrame, weights: DataFrame, grid: DataFrame, features: list[str], fallback: str, least: int = 10) -> DataFrame:
    """(window_id, dt, ticker, score): percent ranks about their middle times the window's weights; of windows without any, the ``fallback``'s rank.

    A missing value counts as the middle. Windows of fewer than ``least`` scores have none.
    """
    rows = ics.long(df.join(F.broadcast(grid.select("window_id", "at")), c("dt") == c("at")), features, ("window_id", "dt", "ticker"))
    rows = rows.withColumn("r", w.percent_rank(c("value"), keys=("window_id", "feature")) - 0.5)
    found = rows.join(F.broadcast(weights), ["window_id", "feature"], "left").groupBy("window_id", "dt", "ticker").agg(
        F.sum(c("weight") * F.coalesce("r", F.lit(0.0))).alias("learned"), F.max(F.when(c("feature") == fallback, c("r"))).alias("plain")
    )
    found = found.withColumn("score", F.round(F.coalesce("learned", "plain"), 10)).where("score is not null")
    return found.withColumn("_n", F.count("*").over(Window.partitionBy("window_id"))).where(c("_n") >= least).select("window_id", "dt", "ticker", "score")


def book_by_mode(scores: DataFrame, modes: DataFrame, rules: pf.Rules) -> DataFrame:
    """A quantile book whose sides follow each window's mode (window_id, mode)."""
    both = scores.join(F.broadcast(modes), "window_id")
    books = [pf.quantile_book(both.where(c("mode") == m), replace(rules, mode=m)) for m in ("ls", "long_only", "short_only")]
    return books[0].unionByName(books[1]).unionByName(books[2])


def walk_forward(df: DataFrame, ic: DataFrame, grid: DataFrame, modes: DataFrame, features: list[str], target: str, fallback: str, rules: pf.Rules, bars: DataFrame | None = None, **gates) -> DataFrame:
    """One row a window of ``grid``: weights learned from the past, scores of the eligible, book by mode, returns, costs and capital.

    ``df``: dt, ticker, features and target, and, unless ``bars`` has them, close and volume. Windows without a book hold cash.
    """
    weights = learned_weights(ic, grid, **gates).persist()  # rows by window: weights, scores and book are read more than once
    at = F.broadcast(grid.select(c("at").alias("dt")))
    able = eligible(bars if bars is not None else df).select("dt", "ticker").join(at, "dt")
    scored = weighted_scores(df.join(able, ["dt", "ticker"]), weights, grid, features, fallback)
    return settled(df, scored, weights, grid, modes, target, rules)


def settled(df: DataFrame, scored: DataFrame, weights: DataFrame, grid: DataFrame, modes: DataFrame, target: str, rules: pf.Rules) -> DataFrame:
    """One row a window of ``grid``: from scores to books by mode, returns, costs and capital; n_features counts rows of ``weights``."""
    at = F.broadcast(grid.select(c("at").alias("dt")))
    book = book_by_mode(scored.persist(), modes, rules).persist()
    used = weights.groupBy("window_id").agg(F.count("*").alias("n_features"))
    out = pf.period_returns(book, df.select("dt", "ticker", c(target).alias("ret")).join(at, "dt"), rules, windows=grid.select("window_id", c("at").alias("dt"))).persist()
    return pf.compounded(out.join(used, "window_id", "left").withColumn("n_features", F.coalesce("n_features", F.lit(0)))).join(modes, "window_id", "left")


def mode_of(regime: Column, ranging: str = "ls") -> Column:
    """Sides by the regime known before the date; ``ranging`` where there is no direction."""
    return F.when(regime == "bull", "long_only").when(regime == "bear", "short_only").otherwise(ranging)
