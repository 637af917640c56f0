"""Window pipelines and selectors composed of the other operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import kernels
from tidepanel.functions import windows as w
from tidepanel.operators import ic as ics

c = F.col


def short_lag(tested: DataFrame, days: dict[str, int], limit: int = 5, floor: float = 0.01, top: int = 3) -> DataFrame:
    """Features of short horizon (1 to below ``limit`` days) that are strong enough, the best ``top``, to be protected."""
    short = [f for f, d in days.items() if d is not None and 1 <= d < limit]
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("ic_mean")), "feature"))
    return tested.where(c("feature").isin(short) & (F.abs("ic_mean") >= floor)).withColumn("place", place).where(c("place") <= top)


def window_filter(ic: DataFrame, floor: float = 0.02, t: float = 1.96, folds: int = 4) -> DataFrame:
    """(feature, ic_mean, t_nw, same_sign, median_ic, kept): hard limits, then at least two folds of the sign and size of the median."""
    from tidepanel.operators.selection import _positions

    tested = ics.newey_west(ic)
    means = ic.join(F.broadcast(_positions(ic, folds, "fold")), "dt").groupBy("feature", "fold").agg(F.avg("ic").alias("m"))
    means = means.withColumn("mid", F.median("m").over(Window.partitionBy("feature")))
    stable = means.groupBy("feature").agg(F.count(F.when(F.signum("m") == F.signum("mid"), 1)).alias("same_sign"), F.max("mid").alias("median_ic"))
    out = tested.join(stable, "feature")
    return out.withColumn("kept", (F.abs("ic_mean") > floor) & (F.abs("t_nw") > t) & (c("same_sign") >= 2) & (F.abs("median_ic") >= floor))


def mutual_information(df: DataFrame, features: list[str], target: str, folds: int = 3) -> DataFrame:
    """(feature, fold, mi): nearest-neighbour estimate in each contiguous time fold, on all its rows."""
    from tidepanel.operators.selection import _positions

    rows = ics.long(df.withColumn("_y", c(target)), features, ("dt", "ticker", "_y")).where("value is not null and _y is not null")
    rows = rows.join(F.broadcast(_positions(rows, folds, "fold")), "dt")

    def estimate(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["dt", "ticker"])
        return pd.DataFrame({"feature": [part["feature"].iloc[0]], "fold": [int(part["fold"].iloc[0])], "mi": [kernels.knn_mutual_information(part["value"].to_numpy(float), part["_y"].to_numpy(float))]})

    return rows.select("feature", "fold", "dt", "ticker", "value", "_y").groupBy("feature", "fold").applyInPandas(estimate, "feature string, fold int, mi double")


def most_informative(features: list[str], mi: dict[str, float], pairs: list[tuple[str, str, float | None]], limit: float = 0.75) -> list[str]:
    """``features`` in order without the less informative of each pair correlated above ``limit``, the later one if equal, and without those of no information."""
    near = {frozenset((a, b)): abs(r or 0.0) for a, b, r in pairs}
    gone: set[str] = set()
    for i, a in enumerate(features):
        for b in features[i + 1 :]:
            if a in gone:
                break
            if b not in gone and near.get(frozenset((a, b)), 0.0) > limit:
                gone.add(a if mi.get(b, 0.0) > mi.get(a, 0.0) else b)
    return [f for f in features if f not in gone and mi.get(f, 0.0) > 0]


def binning(df: DataFrame, features: list[str], target: str, leaf: int = 100, depth: int = 3, bins: int = 10) -> DataFrame:
    """(feature, edges, ic_raw, ic_binned, use_bins): tree edges of each feature, and whether bins rank better than values."""
    rows = ics.long(df.withColumn("_y", c(target)), features, ("dt", "ticker", "_y")).where("value is not null and _y is not null")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["dt", "ticker"])
        x, y = part["value"].to_numpy(float), part["_y"].to_numpy(float)
        edges = kernels.tree_edges(x, y, depth, leaf, bins)
        raw, cut = kernels.spearman(x, y), kernels.spearman(np.searchsorted(edges, x, "right").astype(float), y)
        return pd.DataFrame({"feature": [part["feature"].iloc[0]], "edges": [edges.tolist()], "ic_raw": [raw], "ic_binned": [cut], "use_bins": [bool(abs(cut) > abs(raw))]})

    return rows.select("feature", "dt", "ticker", "value", "_y").groupBy("feature").applyInPandas(fit, "feature string, edges array<double>, ic_raw double, ic_binned double, use_bins boolean")


def elastic_net(df: DataFrame, features: list[str], target: str, ratio: float = 0.5) -> DataFrame:
    """(feature, coef): elastic net over all rows, penalty by expanding time folds; one task, as the Gram matrix is small."""
    rows = df.select("dt", "ticker", *features, c(target).alias("_y")).dropna()

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["dt", "ticker"])
        x = kernels.robust_scale(part[features].to_numpy(float))[0]
        coef, _, _ = kernels.lasso_cv(x, part["_y"].to_numpy(float), ratio=ratio, steps=20, expanding=True)
        return pd.DataFrame({"feature": features, "coef": coef})

    return rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(fit, "feature string, coef double")


def pool_health(pairs: list[tuple[str, str, float | None]], names: list[str]) -> dict[str, float]:
    """Largest and mean absolute correlation of a pool, and the condition number of its correlation matrix."""
    at = {n: i for i, n in enumerate(names)}
    matrix = np.eye(len(names))
    for a, b, r in pairs:
        if a in at and b in at:
            matrix[at[a], at[b]] = matrix[at[b], at[a]] = r or 0.0
    values = np.linalg.eigvalsh(matrix)
    off = np.abs(matrix[np.triu_indices(len(names), 1)])
    return {"max_corr": float(off.max(initial=0)), "mean_corr": float(off.mean()) if off.size else 0.0, "condition": float(values[-1] / max(values[0], 1e-12))}


def hierarchical(features: list[str], family: dict[str, str], score: dict[str, float], pairs: list[tuple[str, str, float | None]], inside: float = 0.7, across: float = 0.75, most: int = 10, protected: tuple[str, ...] = ()) -> list[str]:
    """Clusters within families by average linkage, best of each, then greedy across families; protected ones stay."""
    near = {frozenset((a, b)): abs(r or 0.0) for a, b, r in pairs}
    chosen: list[str] = []
    for f in sorted(set(family.values())):
        own = [x for x in features if family[x] == f]
        far = np.array([[0.0 if a == b else 1 - near.get(frozenset((a, b)), 0.0) for b in own] for a in own])
        label = kernels.average_linkage(far, 1 - inside) if own else []
        best = {}
        for x, k in sorted(zip(own, label, strict=True), key=lambda p: (-abs(score.get(p[0], 0.0)), p[0])):
            best.setdefault(k, x)
        chosen += sorted(best.values(), key=lambda x: (-abs(score.get(x, 0.0)), x))[:most]
    kept: list[str] = [p for p in protected if p in features]
    for x in sorted(chosen, key=lambda x: (-abs(score.get(x, 0.0)), x)):
        if x not in kept and all(near.get(frozenset((x, k)), 0.0) <= across for k in kept):
            kept.append(x)
    return kept


def rank_combination(df: DataFrame, weights: dict[str, float]) -> Column:
    """Sum of signed weights times percent ranks; a missing value counts as the middle."""
    total = F.lit(0.0)
    for f, k in weights.items():
        total = total + F.coalesce(w.percent_rank(c(f)), F.lit(0.5)) * k
    return total


def risk_targets(df: DataFrame) -> DataFrame:
    """Add the risk selector's targets: next volatility over one and five rows, tail event, low liquidity."""
    from tidepanel.operators import timeseries as ts

    df = ts.forward_risk(df)
    return df.withColumn("liq_target", w.flag(w.percent_rank(c("volume")) < 0.2))


def sign_flips(df: DataFrame, features: list[str], target: str, segments: int = 4, band: float = 0.05, least: int = 50, dates: int = 10) -> DataFrame:
    """Features of which a segment of the calendar has a rank correlation over its rows of the other sign than all rows, beyond ``band``.

    Segments of under ``least`` rows do not count, and none do where there are fewer than ``dates`` dates a segment.
    """
    from tidepanel.operators.selection import _positions

    rows = ics.long(df.withColumn("_y", c(target)), features, ("dt", "ticker", "_y")).where("value is not null and _y is not null")
    calendar = _positions(df, segments, "segment").withColumn("_d", F.count("*").over(Window.partitionBy())).where(c("_d") >= segments * dates)
    rows = rows.join(F.broadcast(calendar), "dt")
    rows = rows.withColumns({"rx": w.percent_rank(c("value"), keys=("feature", "segment")), "ry": w.percent_rank(c("_y"), keys=("feature", "segment"))})
    parts = rows.groupBy("feature", "segment").agg(ics.safe_corr(c("rx"), c("ry")).alias("part"), F.count("*").alias("k")).where(c("k") >= least)
    whole = ics.pooled_ic(df, features, target).select("feature", "ic")
    other = F.when(c("ic") > 0, -c("part")).otherwise(c("part"))
    return parts.join(whole, "feature").where(other > band).select("feature").distinct()


def risk_scores(df: DataFrame, features: list[str], families: dict[str, str], floor: float = 0.05, segments: int = 4, per_family: int = 5, cap: int = 30, band: float = 0.05) -> DataFrame:
    """(feature, vol, tail, stab, score, place): rank correlation with volatility, area for the tail event, share of segments of one
    sign; features with a segment of the other sign beyond ``band`` are out; normalised by rank and weighted; the best of each family, then of all."""
    from tidepanel.operators import lab
    from tidepanel.operators.selection import _positions

    vol = ics.pooled_ic(df, features, "rv_5").select("feature", F.abs("ic").alias("vol"), "ic")
    tails = None
    for f in features:
        one = lab.daily_auc(df, f, "tail_event").agg(F.avg("auc").alias("tail")).withColumn("feature", F.lit(f))
        tails = one if tails is None else tails.unionByName(one)
    ic = ics.daily_ic(df, features, "rv_5")
    parts = ic.join(F.broadcast(_positions(ic, segments, "segment")), "dt").groupBy("feature", "segment").agg(F.avg("ic").alias("m"))
    stab = parts.join(vol.select("feature", "ic"), "feature").groupBy("feature").agg(F.avg((F.signum("m") == F.signum("ic")).cast("int")).alias("stab"))
    flips = sign_flips(df, features, "rv_5", segments, band)
    out = vol.join(tails, "feature").join(stab, "feature").where(c("vol") >= floor).join(flips, "feature", "left_anti")
    norm = lambda m: F.coalesce(F.percent_rank().over(Window.orderBy(m)), F.lit(0.0))
    out = out.withColumn("score", 0.4 * norm("vol") + 0.4 * norm("tail") + 0.2 * norm("stab"))
    named = F.create_map(*(v for f in features for v in (F.lit(f), F.lit(families[f]))))
    out = out.withColumn("family", named[c("feature")])
    out = out.withColumn("_r", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("score"), "feature"))).where(c("_r") <= per_family)
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "feature"))).where(c("place") <= cap).drop("_r", "ic")
