"""Portfolios by window: exposure, books, period results, ledgers, walk-forward."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Rules:
    """Settings of a book and its costs. Rates are yearly, costs in basis points of turnover."""

    long_quantile: float = 0.67
    short_quantile: float = 0.33
    cap: float = 0.10
    horizon: int = 21
    margin_long: float = 1.0
    margin_short: float = 1.0
    utilisation: float = 1.0
    neutral: bool = True
    ratio: float = 1.0
    mode: str = "ls"
    cash_rate: float = 0.034
    cost_bps: float = 8.0
    borrow_rate: float = 0.01
    margin_rate: float = 0.05

    def exposure(self) -> tuple[float, float]:
        """(long, short) as multiples of equity that the margins allow."""
        if self.mode == "long_only":
            return self.utilisation / self.margin_long, 0.0
        if self.mode == "short_only":
            return 0.0, self.utilisation / self.margin_short
        if self.mode == "cash":
            return 0.0, 0.0
        if self.neutral:
            both = self.utilisation / (self.margin_long + self.margin_short)
            return both, both
        long = self.ratio / (self.margin_long * self.ratio + self.margin_short)
        return long * self.utilisation, long / self.ratio * self.utilisation


def quantile_book(scores: DataFrame, rules: Rules) -> DataFrame:
    """(window_id, dt, ticker, side, w): equal weights of the best and the worst scores, capped and scaled back up."""
    long, short = rules.exposure()
    over = Window.partitionBy("window_id")
    df = scores.where("score is not null").withColumns({"_n": F.count("*").over(over), "_up": F.row_number().over(over.orderBy(F.desc("score"), "ticker")), "_down": F.row_number().over(over.orderBy("score", "ticker"))})
    n_long, n_short = F.greatest(F.lit(1), F.floor(c("_n") * (1 - rules.long_quantile))), F.greatest(F.lit(1), F.floor(c("_n") * rules.short_quantile))
    side = F.when((c("_up") <= n_long) & F.lit(long > 0), "long").when((c("_down") <= n_short) & F.lit(short > 0), "short")
    df = df.withColumns({"side": side, "_long": n_long, "_short": n_short}).where("side is not null")
    gross, count = F.when(c("side") == "long", long).otherwise(short), F.when(c("side") == "long", c("_long")).otherwise(c("_short"))
    df = df.withColumn("_w", F.least(gross / count, F.lit(rules.cap)))
    total = F.sum("_w").over(Window.partitionBy("window_id", "side"))
    return df.withColumn("w", F.try_divide(c("_w") * gross, total) * F.when(c("side") == "long", 1.0).otherwise(-1.0)).select("window_id", "dt", "ticker", "side", "score", "w")


def capped_book(scores: DataFrame, rules: Rules, cluster: str = "cluster", cluster_cap: float = 0.25) -> DataFrame:
    """(window_id, dt, ticker, side, w): all of a side's exposure on its highest scores, within caps of entity and cluster.

    Candidates are the best and the worst quantile of the scores. The caps are nested, so filling by score is optimal for the linear objective: running sums, first within
    clusters and then over them. Caps too tight for the exposure are widened alike.
    """
    long, short = rules.exposure()
    n = F.count("*").over(Window.partitionBy("window_id"))
    place = F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc("score"), "ticker"))
    df = scores.where("score is not null").withColumns({"_n": n, "_place": place})
    n_long, n_short = F.greatest(F.lit(1), F.floor(c("_n") * (1 - rules.long_quantile))), F.greatest(F.lit(1), F.floor(c("_n") * rules.short_quantile))
    df = df.withColumn("side", F.when(c("_place") <= n_long, "long").when(c("_place") > c("_n") - n_short, "short")).where("side is not null")
    df = df.withColumn("_gross", F.when(c("side") == "long", long).otherwise(short)).where("_gross > 0")
    over = Window.partitionBy("window_id", "side")
    inside = Window.partitionBy("window_id", "side", cluster)
    df = df.withColumn("_cap", F.lit(rules.cap))
    room = F.least(F.sum("_cap").over(inside), F.lit(cluster_cap))
    df = df.withColumn("_first", F.row_number().over(inside.orderBy(F.desc("score"), "ticker")))
    df = df.withColumn("_room", F.sum(F.when(c("_first") == 1, room)).over(over))
    widen = F.when(c("_room") < 0.99 * c("_gross"), 1.1 * c("_gross") / c("_room")).otherwise(1.0)
    df = df.withColumns({"_cap": c("_cap") * widen, "_ccap": F.lit(cluster_cap) * widen})
    best = F.desc("score"), F.asc("ticker")
    before = F.coalesce(F.sum("_cap").over(inside.orderBy(*best).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_take", F.greatest(F.lit(0.0), F.least(c("_cap"), c("_ccap") - before)))
    spent = F.coalesce(F.sum("_take").over(over.orderBy(*best).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = F.greatest(F.lit(0.0), F.least(c("_take"), c("_gross") - spent))
    return df.withColumn("w", w * F.when(c("side") == "long", 1.0).otherwise(-1.0)).where("w != 0").select("window_id", "dt", "ticker", "side", cluster, "score", "w")


def period_returns(book: DataFrame, returns: DataFrame, rules: Rules, windows: DataFrame | None = None) -> DataFrame:
    """One row a window: returns of both sides, cash, turnover, costs, and the ledger.

    ``returns`` has dt, ticker and ret over the holding period. Turnover of the first window is all of
    it, later half the sum of absolute changes; an entity that is in one of two windows counts as 0 in the other.
    ``windows`` (window_id, dt) adds rows for those without a book, which hold cash; without it there are only the book's.
    """
    held = book.join(returns.select("dt", "ticker", c("ret").alias("_ret")), ["dt", "ticker"], "left").withColumn("_ret", F.coalesce("_ret", F.lit(0.0)))
    of = lambda s, v: F.coalesce(F.sum(F.when(c("side") == s, v)), F.lit(0.0))
    sums = held.groupBy("window_id", "dt").agg(
        of("long", c("w") * c("_ret")).alias("long_ret"), of("short", c("w") * c("_ret")).alias("short_ret"), of("long", c("w")).alias("gross_long"), of("short", -c("w")).alias("gross_short"),
        F.count(F.when(c("side") == "long", 1)).alias("n_long"), F.count(F.when(c("side") == "short", 1)).alias("n_short"),
    )
    if windows is not None:
        none = {"long_ret": 0.0, "short_ret": 0.0, "gross_long": 0.0, "gross_short": 0.0, "n_long": 0, "n_short": 0}
        sums = windows.join(sums.drop("dt"), "window_id", "left").fillna(none)
    # each weight meets the previous window's, and each that lapses meets 0
    grid = (book if windows is None else windows).select("window_id").distinct().withColumn("before", F.lag("window_id").over(Window.orderBy("window_id")))
    now = book.select("window_id", "ticker", "w").join(grid, "window_id")
    prior = book.select(c("window_id").alias("before"), "ticker", c("w").alias("w0")).join(grid, "before")
    change = now.join(prior.select("window_id", "ticker", "w0"), ["window_id", "ticker"], "full_outer")
    change = change.groupBy("window_id").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("_change"))
    turnover = grid.join(change, "window_id", "left").select("window_id", (F.coalesce("_change", F.lit(0.0)) * F.when(c("before").isNull(), 1.0).otherwise(0.5)).alias("turnover"))
    df = sums.join(turnover, "window_id")
    margin = c("gross_long") * rules.margin_long + c("gross_short") * rules.margin_short
    share = rules.horizon / 365.0
    df = df.withColumn("cash", F.greatest(F.lit(0.0), 1 - margin))
    df = df.withColumns(
        {
            "cash_ret": c("cash") * rules.cash_rate * share,
            "cost": c("turnover") * rules.cost_bps / 1e4,
            "interest": c("gross_long") * (1 - rules.margin_long) * rules.margin_rate * share,
            "borrow": c("gross_short") * rules.borrow_rate * share,
        }
    )
    df = df.withColumn("net_ret", c("long_ret") + c("short_ret") + c("cash_ret") - c("cost") - c("interest") - c("borrow"))
    ledger = F.struct(margin.alias("margin"), c("cash").alias("cash"), c("cash_ret").alias("cash_ret"), c("cost").alias("cost"), c("interest").alias("interest"), c("borrow").alias("borrow"))
    return df.withColumn("cash_ledger", ledger)


def compounded(periods: DataFrame, start: float = 1.0) -> DataFrame:
    """Add capital at the end of each window: one row a window, in order."""
    order = Window.orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("capital", F.lit(start) * F.product(1 + c("net_ret")).over(order))


def ledger_rows(book: DataFrame, capital: DataFrame) -> DataFrame:
    """(window_id, dt, ticker, action, w, amount): a row for each position taken."""
    at = capital.withColumn("_start", F.coalesce(F.lag("capital").over(Window.orderBy("window_id")), F.lit(1.0))).select("window_id", "_start")
    return book.join(F.broadcast(at), "window_id").select("window_id", "dt", "ticker", F.when(c("side") == "long", "buy").otherwise("sell").alias("action"), "w", (F.abs("w") * c("_start")).alias("amount"))


def cap_violations(book: DataFrame, cluster: str, cap: float) -> DataFrame:
    """(window_id, side, cluster, w) of clusters over their cap by more than a hundredth of it."""
    return book.groupBy("window_id", "side", cluster).agg(F.sum(F.abs("w")).alias("w")).where(c("w") > cap * 1.01)


def momentum_scores(df: DataFrame, grid: DataFrame, feature: str, rank: Column) -> DataFrame:
    """(window_id, dt, ticker, score): percent rank of a feature at each date of the grid."""
    return df.join(F.broadcast(grid), c("dt") == c("at")).withColumn("score", rank).select("window_id", "dt", "ticker", "score")
