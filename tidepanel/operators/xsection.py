"""Cross-sections: what is computed among the entities of one date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import windows as w

c = F.col


def relative_returns(df: DataFrame, benchmark: str, spans=(5, 21, 63)) -> DataFrame:
    """Returns over each span, less the basket's mean and less the benchmark entity's (0 if it is absent)."""
    df = df.withColumns({f"_r{n}": (w.ratio(c("close"), w.lag("close", n)) - 1) * 100.0 for n in spans})
    made = {}
    for n in spans:
        own = c(f"_r{n}")
        of = F.max(F.when(c(w.ENTITY) == benchmark, own)).over(w.section())
        made[f"rel_{n}_basket"] = own - F.avg(own).over(w.section())
        made[f"rel_{n}_bench"] = F.when(of.isNull(), 0.0).otherwise(own - of)
    return df.withColumns(made)


def winsorised(name: str, k: float = 2.5) -> Column:
    """``name`` within k deviations of its date's mean."""
    m, s = F.avg(name).over(w.section()), F.stddev(name).over(w.section())
    return F.when(c(name).isNotNull(), F.when(s.isNull(), c(name)).otherwise(F.least(F.greatest(c(name), m - k * s), m + k * s)))


def imputed(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing values become their date's median, then the entity's last value; never a later one."""
    df = df.withColumns({n: F.coalesce(c(n), F.median(n).over(w.section())) for n in names})
    return df.withColumns({n: F.last(n, True).over(w.upto()) for n in names})


def demeaned(name: str, by: tuple[str, ...] = ()) -> Column:
    return c(name) - F.avg(name).over(Window.partitionBy(w.TIME, *by))


def residual(df: DataFrame, y: str, controls: tuple[str, ...], least: int = 20, ridge: float = 1e-6, name: str = "y_resid") -> DataFrame:
    """``y`` less its ridge regression on any number of controls and a constant, date by date.

    Dates with fewer complete rows than ``least``, or than there are coefficients, keep y; elsewhere an incomplete row gets null.
    The normal equations are sums over the date, made before the shuffle; only these, a row a date, are solved outside
    the JVM, and the coefficients come back by date.
    """
    k = len(controls) + 1
    whole = c(y).isNotNull()
    for x in controls:
        whole = whole & c(x).isNotNull()
    terms = [F.lit(1.0), *(c(x).cast("double") for x in controls)]
    sums = [F.sum(terms[i] * terms[j]) for i in range(k) for j in range(i, k)] + [F.sum(t * c(y)) for t in terms]
    normal = df.where(whole).groupBy(w.TIME).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))

    def solve(parts):
        for part in parts:
            rows = np.array(part["sums"].tolist(), float).reshape(len(part), -1)
            upper = np.triu_indices(k)
            beta = []
            for row in rows:
                m = np.zeros((k, k))
                m[upper] = row[: len(upper[0])]
                m = np.triu(m) + np.triu(m, 1).T + ridge * np.eye(k)
                beta.append(np.linalg.lstsq(m, row[len(upper[0]) :], rcond=None)[0] if np.linalg.matrix_rank(m) < k else np.linalg.solve(m, row[len(upper[0]) :]))
            yield pd.DataFrame({w.TIME: part[w.TIME], "_n": part["n"], "_beta": [b.tolist() for b in beta]})

    solved = normal.where(c("n") >= max(least, k)).mapInPandas(solve, f"{w.TIME} {df.schema[w.TIME].dataType.simpleString()}, _n long, _beta array<double>")
    df = df.join(solved, w.TIME, "left")
    fit = sum((c("_beta")[i] * terms[i] for i in range(1, k)), c("_beta")[0])
    return df.withColumn(name, F.when(c("_n").isNull(), c(y)).when(whole, c(y) - fit)).drop("_n", "_beta")


def standardised(df: DataFrame, name: str, out: str, least: int = 20, tiny: float = 1e-6, limits: tuple[float, float] | None = None) -> DataFrame:
    """z-scores by date, optionally clipped at quantiles first; null on dates too small or too even."""
    over = w.section()
    value = c(name)
    if limits:
        df = df.withColumns({"_lo": F.percentile(name, F.lit(limits[0])).over(over), "_hi": F.percentile(name, F.lit(limits[1])).over(over)})
        df = df.withColumn("_v", F.when(value.isNotNull(), F.least(F.greatest(value, c("_lo")), c("_hi"))))
    else:
        df = df.withColumn("_v", value)
    s = F.stddev("_v").over(over)
    fine = (F.count("_v").over(over) >= least) & (s >= tiny)
    return df.withColumn(out, F.when(fine, (c("_v") - F.avg("_v").over(over)) / s))


def labels(df: DataFrame, raw: str = "fwd_21", by: tuple[str, ...] = (), controls: tuple[str, ...] | None = ("beta_mkt_63", "idio_vol_63"), limits=None) -> DataFrame:
    """Raw forward return, demeaned, residual to risk, z-score: y_raw, y_cs, y_resid, y_resid_z."""
    df = df.withColumn("y_raw", c(raw)).withColumn("y_cs", demeaned(raw, by))
    df = residual(df, "y_cs", controls) if controls else df.withColumn("y_resid", c("y_cs"))
    return standardised(df, "y_resid", "y_resid_z", limits=limits)


def quintile_spread(df: DataFrame, x: str, y: str, least: int = 20) -> DataFrame:
    """(dt, spread, top_excess): mean y of the top fifth less the bottom fifth, or less all, cut by position."""
    df = df.where(c(x).isNotNull() & c(y).isNotNull()).withColumns({"_r": F.row_number().over(w.section().orderBy(x, w.ENTITY)), "_n": F.count("*").over(w.section())})
    low, high = c("_r") <= F.floor(c("_n") * 0.2), c("_r") > F.floor(c("_n") * 0.8)
    out = df.groupBy(w.TIME).agg(F.max("_n").alias("n"), F.avg(F.when(high, c(y))).alias("top"), F.avg(F.when(low, c(y))).alias("bottom"), F.avg(y).alias("all"))
    return out.where(c("n") >= least).select(w.TIME, (c("top") - c("bottom")).alias("spread"), (c("top") - c("all")).alias("top_excess"))


def threshold_spread(df: DataFrame, x: str, y: str, least: int = 20) -> DataFrame:
    """As quintile_spread, cut at the interpolated 20th and 80th percentiles, both included."""
    df = df.where(c(x).isNotNull() & c(y).isNotNull())
    over = w.section()
    df = df.withColumns({"_lo": F.percentile(x, F.lit(0.2)).over(over), "_hi": F.percentile(x, F.lit(0.8)).over(over)})
    out = df.groupBy(w.TIME).agg(F.count("*").alias("n"), F.avg(F.when(c(x) >= c("_hi"), c(y))).alias("top"), F.avg(F.when(c(x) <= c("_lo"), c(y))).alias("bottom"), F.avg(y).alias("all"))
    return out.where(c("n") >= least).select(w.TIME, (c("top") - c("bottom")).alias("spread"), (c("top") - c("all")).alias("top_excess"))


def top_turnover(df: DataFrame, x: str, share: float = 0.1) -> DataFrame:
    """(dt, turnover): share of the top entities that were not on top at the previous date."""
    df = df.where(c(x).isNotNull()).withColumns({"_r": F.row_number().over(w.section().orderBy(F.desc(x), w.ENTITY)), "_n": F.count("*").over(w.section())})
    top = df.where(c("_r") <= F.greatest(F.lit(1), F.floor(c("_n") * share))).select(w.TIME, w.ENTITY)
    dates = top.select(w.TIME).distinct().withColumn("before", F.lag(w.TIME).over(Window.orderBy(w.TIME)))  # one row a date
    now = top.join(dates, w.TIME)
    prior = top.select(c(w.TIME).alias("before"), c(w.ENTITY).alias("held")).withColumn("stayed", F.lit(1))
    both = now.join(prior, (now["before"] == prior["before"]) & (now[w.ENTITY] == prior["held"]), "left").drop(prior["before"])
    return both.where(c("before").isNotNull()).groupBy(w.TIME).agg((1 - F.sum(F.coalesce("stayed", F.lit(0))) / F.count("*")).alias("turnover"))


def coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """(dt, n, share of values present, entities by band of presence)."""
    share = sum((c(n).isNotNull().cast("int") for n in names), F.lit(0)) / F.lit(float(len(names)))
    return df.withColumn("_s", share).groupBy(w.TIME).agg(
        F.count("*").alias("n"),
        F.avg("_s").alias("share"),
        F.count(F.when(c("_s") >= 0.9, 1)).alias("n_good"),
        F.count(F.when((c("_s") >= 0.5) & (c("_s") < 0.9), 1)).alias("n_fair"),
        F.count(F.when(c("_s") < 0.5, 1)).alias("n_poor"),
    )


def asof(left: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """The last value of each series at or before each row's date, however old.

    The dates of the panel, one row each, are merged with the series and carried forward; the result, as
    small as the calendar, is joined back by date. The panel itself is not shuffled by this but for that join.
    """
    dates = left.select(w.TIME).distinct().withColumn("_panel", F.lit(True))
    wide = series.groupBy(w.TIME).agg(*(F.max(F.when(c("name") == n, c("value"))).alias(n) for n in names))
    merged = dates.join(wide, w.TIME, "full_outer")
    order = Window.orderBy(w.TIME).rowsBetween(Window.unboundedPreceding, 0)  # a calendar: some thousands of rows
    filled = merged.select(w.TIME, "_panel", *(F.last(n, True).over(order).alias(n) for n in names)).where("_panel").drop("_panel")
    return left.join(filled, w.TIME, "left")
