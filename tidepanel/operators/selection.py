"""Feature selection: ranking, redundancy, scaling, sparse models by window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import kernels

c = F.col


def _positions(ic: DataFrame, parts: int, name: str) -> DataFrame:
    """Contiguous parts of the calendar: (dt, name)."""
    dates = ic.select("dt").distinct()
    at = F.row_number().over(Window.orderBy("dt")) - 1
    return dates.select("dt", F.floor(at * float(parts) / F.count("*").over(Window.partitionBy())).alias(name))


def fold_agreement(ic: DataFrame, folds: int = 5) -> DataFrame:
    """(feature, cv_ic, agreement, folds): mean of fold means, and share of folds with the sign of their median."""
    means = ic.join(F.broadcast(_positions(ic, folds, "fold")), "dt").groupBy("feature", "fold").agg(F.avg("ic").alias("m"))
    means = means.withColumn("mid", F.median("m").over(Window.partitionBy("feature")))
    return means.groupBy("feature").agg(F.avg("m").alias("cv_ic"), F.avg((F.signum("m") == F.signum("mid")).cast("int")).alias("agreement"), F.count("*").alias("folds"))


def soft_rank(ic: DataFrame, blocks: int = 3, top: int = 100, floor: float | None = None, least: int = 50) -> DataFrame:
    """(feature, ic_mean, score, place): |mean| x (0.5 + 0.5 x share of blocks with its sign), best ``top``.

    The floor on |mean| applies only if ``least`` features pass it.
    """
    of = ic.join(F.broadcast(_positions(ic, blocks, "block")), "dt").groupBy("feature", "block").agg(F.avg("ic").alias("m"))
    means = ic.groupBy("feature").agg(F.avg("ic").alias("ic_mean"))
    scored = of.join(means, "feature").groupBy("feature", "ic_mean").agg((F.count(F.when(F.signum("m") == F.signum("ic_mean"), 1)) / F.count("*")).alias("share"))
    scored = scored.withColumn("score", F.abs("ic_mean") * (0.5 + 0.5 * c("share")))
    if floor is not None:
        passing = F.count(F.when(F.abs("ic_mean") >= floor, 1)).over(Window.partitionBy())
        scored = scored.withColumn("_n", passing).where((F.abs("ic_mean") >= floor) | (c("_n") < least))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "feature"))
    return scored.withColumn("place", place).where(c("place") <= top).select("feature", "ic_mean", "score", "place")


def drop_redundant(features: list[str], score: dict[str, float], pairs: list[tuple[str, str, float | None]], most: float = 0.8, keep_stronger: bool = True) -> list[str]:
    """Greedy over pairs in order: of two correlated above ``most`` the weaker goes (or the stronger, by flag)."""
    out: set[str] = set()
    place = {f: i for i, f in enumerate(features)}
    for a, b, r in sorted(pairs, key=lambda p: tuple(sorted((place[p[0]], place[p[1]])))):
        if r is None or abs(r) <= most or a in out or b in out:
            continue
        weaker, stronger = sorted((a, b), key=lambda f: (abs(score.get(f, 0.0)), -place[f]))
        out.add(weaker if keep_stronger else stronger)
    return [f for f in features if f not in out]


def drop_redundant_by_bucket(features: list[str], bucket: dict[str, str], score: dict[str, float], pairs: list[tuple[str, str, float | None]], inside: float = 0.8, across: float = 0.9, least: int = 5) -> list[str]:
    """Best first; a feature goes if too close to one kept in its bucket or in another, but ``least`` stay in each bucket."""
    near: dict[str, dict[str, float]] = {f: {} for f in features}
    for a, b, r in pairs:
        near[a][b] = near[b][a] = abs(r or 0.0)
    order, kept, left = sorted(features, key=lambda f: (-abs(score.get(f, 0.0)), f)), [], {}
    for f in order:
        limit = lambda g, f=f: inside if bucket[f] == bucket[g] else across
        (kept if all(near[f].get(g, 0.0) <= limit(g) for g in kept) else left.setdefault(bucket[f], [])).append(f)
    for b, waiting in left.items():
        have = sum(bucket[f] == b for f in kept)
        kept += waiting[: max(0, least - have)]
    return [f for f in features if f in set(kept)]


def robust_standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """(x - median) / median absolute deviation; deviations below 1e-10 count as 1. Two one-row aggregates."""
    mids = df.agg(*(F.median(f).alias(f"_m_{f}") for f in features))
    with_mids = df.crossJoin(F.broadcast(mids))
    mads = with_mids.agg(*(F.median(F.abs(c(f) - c(f"_m_{f}"))).alias(f"_s_{f}") for f in features))
    both = with_mids.crossJoin(F.broadcast(mads))
    return both.withColumns({f: (c(f) - c(f"_m_{f}")) / F.when(c(f"_s_{f}") < 1e-10, 1.0).otherwise(c(f"_s_{f}")) for f in features}).select(*df.columns)


def lasso_stability(df: DataFrame, features: list[str], target: str, folds: int = 5, share: float = 0.6, leave_one_out: bool = True) -> DataFrame:
    """(feature, pi, kept): share of contiguous time folds in which the lasso gives the feature a weight.

    Each fold is fitted in a task of its own, on all blocks but one, or on its block only.
    """
    rows = df.select("dt", *features, c(target).alias("_y")).dropna()
    rows = rows.join(F.broadcast(_positions(rows, folds, "block")), "dt")
    fold = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    rows = rows.withColumn("fold", fold)
    rows = rows.where((c("fold") != c("block")) if leave_one_out else (c("fold") == c("block")))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < 30:
            return pd.DataFrame({"feature": [], "used": [], "fold": []})
        part = part.sort_values(["dt", *features])
        x, y = kernels.robust_scale(part[features].to_numpy(float))[0], part["_y"].to_numpy(float)
        coef = kernels.lasso_cv(x, y)[0]
        return pd.DataFrame({"feature": features, "used": (np.abs(coef) > 1e-12).astype(int), "fold": int(part["fold"].iloc[0])})

    used = rows.groupBy("fold").applyInPandas(fit, "feature string, used int, fold int")
    return used.groupBy("feature").agg(F.avg("used").alias("pi"), F.count("*").alias("folds")).withColumn("kept", c("pi") >= share)


MODEL = "window_id int, dt date, n long, intercept double, features array<string>, median map<string,double>, mad map<string,double>, coef map<string,double>, train_ic double"


def window_models(df: DataFrame, grid: DataFrame, features: list[str], target: str, days: int = 364, embargo: int = 21, most: int = 12, unit: str = "rows") -> DataFrame:
    """A sparse linear model for each row (window_id, at) of ``grid``: robust scaling, lasso to choose, ridge to refit.

    Training rows end ``embargo`` rows of the calendar (or days) before ``at``, so that no label reaches beyond it.
    """
    dates = df.select("dt").distinct().withColumn("_row", F.row_number().over(Window.orderBy("dt")))
    rows = df.select("dt", *features, c(target).alias("_y")).dropna().join(F.broadcast(dates), "dt")
    late = (c("_row") <= c("at_row") - embargo) if unit == "rows" else (c("dt") <= F.date_sub("at", embargo))
    joined = F.broadcast(grid).join(rows, (c("dt") >= F.date_sub("at", days)) & late)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["dt", *features])
        raw, y = part[features].to_numpy(float), part["_y"].to_numpy(float)
        x, mid, mad = kernels.robust_scale(raw)
        coef = kernels.lasso_cv(x, y)[0] if len(part) >= 30 else np.zeros(len(features))
        order = [i for i in np.argsort(-np.abs(coef), kind="stable") if abs(coef[i]) > 1e-12][:most] or list(range(len(features)))
        weights, level = kernels.ridge(x[:, order], y, 0.01)
        names = [features[i] for i in order]
        guess = x[:, order] @ weights + level
        ic = kernels.spearman(guess, y)
        row = (int(part["window_id"].iloc[0]), part["at"].iloc[0], len(part), level, names, *(dict(zip(names, map(float, v), strict=True)) for v in (mid[order], mad[order], weights)), ic)
        return pd.DataFrame([row], columns=[k.split(" ")[0] for k in MODEL.split(", ")])

    return joined.groupBy("window_id").applyInPandas(fit, MODEL)


def score(df: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """(window_id, dt, ticker, score) of the rows at each model's date; null if a feature that it uses is missing."""
    one = models.select("window_id", c("dt").alias("_at"), "intercept", "median", "mad", "coef")
    rows = df.join(F.broadcast(one), c("dt") == c("_at"))
    terms = []
    for f in features:
        used = F.try_element_at("coef", F.lit(f))
        value = used * (c(f) - F.try_element_at("median", F.lit(f))) / F.try_element_at("mad", F.lit(f))
        terms.append(F.when(used.isNull(), 0.0).otherwise(value))
    total = c("intercept")
    for t in terms:
        total = total + t
    return rows.select("window_id", "dt", "ticker", total.alias("score"))
