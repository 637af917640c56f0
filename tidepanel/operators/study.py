"""Whole chains: the feature panel from bars, formation and sparse models window by window, the alpha selector, the audit."""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import kernels
from tidepanel.functions import windows as w
from tidepanel.operators import backtest as bt
from tidepanel.operators import checks as ck
from tidepanel.operators import ic as ics
from tidepanel.operators import lab
from tidepanel.operators import pipelines as pl
from tidepanel.operators import selection as sel
from tidepanel.operators import timeseries as ts
from tidepanel.operators import xsection as xs

c = F.col
BAR = ("dt", "ticker", "open", "high", "low", "close", "volume")


def feature_panel(
    bars: DataFrame,
    series: DataFrame,
    names: list[str],
    start: datetime.date,
    groups: tuple[Callable[[DataFrame], DataFrame], ...],
    benchmark: str,
    warmup: int = 336,
    horizon: int = 21,
    fill: int = 5,
    sparse: float = 0.10,
    nulls: float = 0.10,
    controls: tuple[str, ...] | None = None,
    required: tuple[str, ...] = ("close",),
    path: str | None = None,
) -> DataFrame:
    """One panel from bars to labels, a row for each entity and date from ``start`` on.

    In this order: entities listed in time, closes carried over at most ``fill`` rows, sparse entities out, returns and
    ``groups`` of features, forward and relative returns, the last value of the slower ``series`` named, the cut at ``start``, columns
    with a share of nulls above ``nulls`` out, the rest imputed, rank of traded value, labels. Windows see the rows
    before ``start``; labels and medians only those after. DataError if one of ``required`` has a null left.
    All time series share one exchange by entity, all cross-sections one by date; only null shares, a row, reach the driver.
    The features are computed once: they are written to ``path`` before shares are taken, or held by the executors where there is none.
    """
    df = ck.listed_in_time(bars.select(*BAR), start, warmup).withColumn("_row", F.row_number().over(w.history()))
    df = df.withColumn("close", ts.filled(df, "close", fill)).drop("_row")
    df = ts.with_returns(ck.dense_entities(df, "close", sparse))
    for group in groups:
        df = group(df)
    df = df.withColumns({f"fwd_{horizon}": w.ratio(F.lead("close", horizon).over(w.history()), c("close")) - 1, "adv_63": F.avg(c("close") * c("volume")).over(w.last(63))})
    df = xs.asof(xs.relative_returns(df, benchmark), series, names)
    df = df.drop(*(n for n in df.columns if n.startswith("_"))).where(c("dt") >= F.lit(start))
    df = bt.stored(df, path) if path else df.persist()
    features = [n for n in df.columns if n not in (*BAR, f"fwd_{horizon}", "ret", "pct", "x")]
    share = df.agg(*(F.avg(c(n).isNull().cast("double")).alias(f"s{i}") for i, n in enumerate(features))).first()
    dense = [n for i, n in enumerate(features) if (share[i] or 0.0) <= nulls]  # an empty panel keeps all
    df = xs.imputed(df.drop(*(n for n in features if n not in dense)), dense)
    if "adv_63" in dense:
        df = df.withColumn("adv_rank", w.percent_rank(c("adv_63")))
    return ck.gate(xs.labels(df, f"fwd_{horizon}", controls=controls), list(required))


# formation and models by window


def _past(rows: DataFrame, grid: DataFrame, days: int, embargo: int) -> DataFrame:
    """Rows of each window's past: ``days`` before its date, without the last ``embargo`` rows of the calendar. ``rows``: dt and _row."""
    return rows.join(F.broadcast(grid), (c("_row") <= c("at_row") - embargo) & (c("dt") >= F.date_sub("at", days)))  # a row a rebalance date


def formation(ic: DataFrame, grid: DataFrame, days: int = 1008, embargo: int = 21, **tests) -> DataFrame:
    """(window_id, feature, ic_mean, t_nw, n, p_value, p_adjusted, fdr_reject, consistency, block_passes, approved) by each window's past.

    ``ic``: dt, feature, ic and _row, the date's place in the calendar. Windows of less than three values of a feature reject it.
    """
    return ics.formation(_past(ic, grid, days, embargo).where("ic is not null").select("window_id", "dt", "feature", "ic"), by=("window_id",), **tests)


def pools(tested: DataFrame, interactions: DataFrame | None = None, parents: dict[str, tuple[str, ...]] | None = None, days: dict[str, int] | None = None, top: int = 30, parent_p: float = 0.3, parent_ic: float = 0.015, short_ic: float = 0.01, short_p: float = 0.1, short_top: int = 5) -> DataFrame:
    """(window_id, feature, score, place, short): what each window's model may choose from, the ``top`` by size and consistency.

    Approved features and approved interactions, but those of which all parents are weak in the window. ``days`` gives horizons:
    the strongest ``short_top`` of 1 to 4 and of 5 to 21 days among them are short, which a model adds after its own choice.
    """
    chosen = tested.where("approved")
    if interactions is not None:
        family = tested.sparkSession.createDataFrame([(n, p) for n, of in (parents or {}).items() for p in of], "feature string, parent string")
        live = tested.where(~((c("p_value") > parent_p) & (F.abs("ic_mean") < parent_ic))).select("window_id", c("feature").alias("parent"))
        able = live.join(F.broadcast(family), "parent").select("window_id", "feature").distinct()  # names, not rows of data
        chosen = chosen.unionByName(interactions.where("approved").join(able, ["window_id", "feature"], "left_semi"))
    chosen = chosen.withColumn("score", F.abs("ic_mean") * (0.5 + 0.5 * c("consistency")))
    place = F.row_number().over(Window.partitionBy("window_id").orderBy(F.desc("score"), "feature"))
    horizon = F.lit(None).cast("int")
    for f, d in (days or {}).items():
        horizon = F.when(c("feature") == f, d).otherwise(horizon)
    bucket = F.when((F.abs("ic_mean") >= short_ic) & (c("p_value") <= short_p), F.when(horizon.between(1, 4), 1).when(horizon.between(5, 21), 2))
    chosen = chosen.withColumn("place", place).where(c("place") <= top).withColumn("_b", bucket)
    rank = F.row_number().over(Window.partitionBy("window_id", "_b").orderBy(F.desc(F.abs("ic_mean")), "feature"))
    return chosen.select("window_id", "feature", "score", "place", F.coalesce(c("_b").isNotNull() & (rank <= short_top), F.lit(False)).alias("short"))


WEIGHTS = "window_id int, feature string, median double, mad double, coef double, intercept double, n long, features int, train_ic double"


def sparse_models(values: DataFrame, pool: DataFrame, grid: DataFrame, days: int = 364, embargo: int = 21, most: int = 12, limit: float = 0.8, least: int = 30, penalty: float = 0.01) -> DataFrame:
    """A row for each feature of each window's model (WEIGHTS): redundancy, robust scaling, lasso, short features, ridge.

    ``values``: dt, ticker, _y, feature, value and _row, long. Only the values of a window's pool in its past are shuffled to its task.
    Of two features correlated above ``limit`` the lower-scored one goes; the lasso's penalty is judged on expanding folds of
    time; ``most`` of its features, then the pool's short ones that are left, are fitted again with a ridge. Windows of fewer
    than ``least`` complete rows have no model.
    """
    rows = values.where("value is not null and _y is not null").select("dt", "ticker", "_row", "_y", "feature", "value")
    wanted = pool.join(F.broadcast(grid), "window_id")
    rows = rows.alias("v").join(F.broadcast(wanted).alias("p"), (c("v.feature") == c("p.feature")) & (c("_row") <= c("at_row") - embargo) & (c("dt") >= F.date_sub("at", days)))
    rows = rows.select("window_id", "dt", "ticker", "_y", c("v.feature").alias("feature"), "value", "score", "place", "short")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        of = part.drop_duplicates("feature").sort_values("place")
        names, short, score = list(of["feature"]), set(of.loc[of["short"], "feature"]), dict(zip(of["feature"], of["score"], strict=True))
        wide = part.pivot_table(index=["dt", "ticker", "_y"], columns="feature", values="value", aggfunc="first")[names].dropna()
        empty = pd.DataFrame(columns=[k.split(" ")[0] for k in WEIGHTS.split(", ")])
        if len(wide) < least:
            return empty
        raw, y = wide.to_numpy(float), wide.index.get_level_values("_y").to_numpy(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.nan_to_num(np.atleast_2d(np.corrcoef(raw, rowvar=False)))
        pairs = [(names[i], names[j], float(near[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
        left = sel.drop_redundant(names, score, pairs, limit)
        raw = raw[:, [names.index(f) for f in left]]
        x, mid, mad = kernels.robust_scale(raw)
        coef = kernels.lasso_cv(x, y, expanding=True)[0]
        order = [i for i in np.argsort(-np.abs(coef), kind="stable") if abs(coef[i]) > 1e-12][:most] or list(range(len(left)))
        order += [i for i, f in enumerate(left) if f in short and i not in order]
        weights, level = kernels.ridge(x[:, order], y, penalty)
        ic = kernels.spearman(x[:, order] @ weights + level, y)
        made = [(int(part["window_id"].iloc[0]), left[i], float(mid[i]), float(mad[i]), float(k), level, len(wide), len(order), ic) for i, k in zip(order, weights, strict=True)]
        return pd.DataFrame(made, columns=empty.columns)

    return rows.groupBy("window_id").applyInPandas(fit, WEIGHTS)


def model_scores(values: DataFrame, able: DataFrame, models: DataFrame, grid: DataFrame, fallback: str, least: int = 10) -> DataFrame:
    """(window_id, dt, ticker, score) of the entities of ``able`` (dt, ticker) at each window's date.

    What a model gives is null if one of its features is missing. Windows without a model rank by ``fallback``, about its middle;
    windows of fewer than ``least`` scores have none.
    """
    at = values.join(F.broadcast(grid.select("window_id", c("at").alias("dt"))), "dt").join(able, ["dt", "ticker"], "left_semi")
    term = c("coef") * (c("value") - c("median")) / c("mad")
    own = at.where("value is not null").join(F.broadcast(models), ["window_id", "feature"]).groupBy("window_id", "dt", "ticker").agg(F.sum(term).alias("s"), F.max("intercept").alias("i"), F.count("*").alias("k"), F.max("features").alias("f"))
    own = own.where("k = f").select("window_id", "dt", "ticker", F.round(c("s") + c("i"), 10).alias("score"))
    plain = at.where((c("feature") == fallback) & c("value").isNotNull()).join(F.broadcast(models.select("window_id").distinct()), "window_id", "left_anti")
    plain = plain.select("window_id", "dt", "ticker", F.round(w.percent_rank(c("value"), keys=("window_id",)) - 0.5, 10).alias("score"))
    both = own.unionByName(plain)
    return both.withColumn("_n", F.count("*").over(Window.partitionBy("window_id"))).where(c("_n") >= least).drop("_n")


# the alpha selector and the audit


#: The weights of the composite.
SCORE = {"ic_abs": 0.30, "long_tail": 0.25, "spread_sharpe": 0.20, "turnover": 0.15, "stress_ic": 0.10}


def alpha_pipeline(df: DataFrame, features: list[str], families: dict[str, str], target: str, market: DataFrame, forced: tuple[str, ...], top: int = 200, **gates) -> DataFrame:
    """(feature, gate, composite, kept, max_corr, mean_corr, condition): gates, composite score, the best ``top``, redundancy, forced features.

    Only features that pass all gates have a composite. Redundancy is judged within families and across them; ``forced`` ones stay whatever
    their gates. The last three columns are the health of the pool that is kept, the same on every row. Only what has
    a row a feature, or a pair of the best, reaches the driver.
    """
    gated = lab.alpha_gates(df, features, target, **gates).select("feature", "gate")
    metrics = lab.alpha_metrics(df, features, target, market).join(gated.where("gate = 'passed'"), "feature", "left_semi")
    scored = lab.composite(metrics, SCORE, ("turnover",)).select("feature", "composite")
    best = scored.orderBy(F.desc("composite"), "feature").limit(top).collect()  # the report's own limit
    score = {r.feature: r.composite for r in best}
    held = [f for f in features if f in score or f in forced]
    pairs = [(r.feature_a, r.feature_b, r["corr"]) for r in ics.pair_correlations(df, held).collect()] if len(held) > 1 else []
    kept = pl.hierarchical([f for f in features if f in score], families, score, pairs, protected=tuple(f for f in forced if f in score))
    kept += [f for f in forced if f in features and f not in kept]
    health = pl.pool_health(pairs, kept) if kept else {"max_corr": 0.0, "mean_corr": 0.0, "condition": 1.0}
    return gated.join(scored, "feature", "left").select("feature", "gate", "composite", c("feature").isin(kept).alias("kept"), *(F.lit(v).alias(k) for k, v in health.items()))


#: What a feature's name must not hold, and the names of targets.
AHEAD = ("_fwd", "_forward", "_future", "_next", "t+")
TARGETS = ("FwdRet", "y_raw", "y_cs", "y_resid", "ret_fwd")


def integrity(df: DataFrame, features: list[str], target: str, horizon: int, grid: DataFrame, settings: int, alpha: float = 0.05, trials: int = 10, tolerance: float = 0.001, gaps: tuple[int, int] = (15, 30)) -> DataFrame:
    """(name, value, fine): names that tell of the future, targets off their own recomputation in all rows, the rebalance gap, the level of tests.

    The mean gap between dates of ``grid`` (at) must lie within ``gaps`` days; fewer than two dates are fine. The level is ``alpha`` over
    ``trials`` for each of ``settings``; it is stated, never failed. Empty panels have no mismatch.
    """
    told = [f for f in features if not any(t in f for t in TARGETS) and any(a in f.lower() for a in AHEAD)]
    again = w.ratio(F.lead("close", horizon).over(w.history()), c("close")) - 1
    off = df.withColumn("_again", again).agg(F.count(F.when(F.abs(c("_again") - c(target)) > tolerance, 1)).alias("off"), F.count(F.when(c("_again").isNull() != c(target).isNull(), 1)).alias("holes"))
    gap = grid.agg(F.try_divide(F.datediff(F.max("at"), F.min("at")), F.count("*") - 1).alias("gap"))
    one = off.crossJoin(gap)  # a row each
    rows = [
        ("names_ahead", F.lit(float(len(told))), F.lit(not told)),
        ("targets_off", c("off").cast("double"), c("off") == 0),
        ("targets_missing", c("holes").cast("double"), c("holes") == 0),
        ("mean_gap_days", c("gap"), F.coalesce(c("gap").between(*gaps), F.lit(True))),
        ("level", F.lit(alpha / max(1, settings * trials)), F.lit(True)),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), f.alias("fine")) for n, v, f in rows))))
