"""Interactions of features, in long form: a row for each value, however many pairs there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import ic as ics

c = F.col


def expressions(families: dict[str, str], flags: tuple[str, ...] = ()) -> dict[str, tuple[F.Column, tuple[str, ...]]]:
    """name -> (expression, parents): products across families, ratios of momentum to volatility,
    differences of neighbouring horizons, powers, and products with regime flags."""
    made: dict[str, tuple] = {}
    names = sorted(families, key=lambda f: (families[f], list(families).index(f)))
    kind = lambda k: [f for f in families if families[f] == k]
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if families[a] != families[b]:
                made[f"{a}_x_{b}"] = (c(a) * c(b), (a, b))
    for a in kind("momentum"):
        for b in kind("volatility"):
            made[f"{a}_div_{b}"] = (F.try_divide(c(a), c(b)), (a, b))
        made[f"{a}_sq"], made[f"{a}_cb"] = (c(a) * c(a), (a,)), (c(a) * c(a) * c(a), (a,))
    for a, b in zip(kind("momentum"), kind("momentum")[1:], strict=False):
        made[f"{a}_minus_{b}"] = (c(a) - c(b), (a, b))
    for a in [*kind("momentum"), *kind("volatility")]:
        made |= {f"{a}_in_{g}": (c(a) * c(g), (a, g)) for g in flags}
    return made


def interactions(df: DataFrame, families: dict[str, str], keep: tuple[str, ...] = ("dt", "ticker"), flags: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., feature, value). The values of a row are laid out by one generator: no wide frame, no self-join."""
    made = expressions(families, flags)
    rows = F.array(*(F.struct(F.lit(n).alias("feature"), e.cast("double").alias("value")) for n, (e, _) in made.items()))
    return df.select(*keep, F.inline(rows))


def screen(df: DataFrame, families: dict[str, str], target: str, alpha: float = 0.1, floor: float = 0.03, agree: float = 0.6, most_corr: float = 0.75, cap: int = 150, parent_p: float = 0.3, parent_ic: float = 0.015) -> DataFrame:
    """Stages of the screen, for every interaction: (feature, ic_mean, p_value, ..., stage).

    stage is the first that it fails: parents (both insignificant and weak), fdr, floor, folds, novelty, cap; or kept.
    """
    made = expressions(families)
    keep = ("dt", "ticker", "_y")
    df = df.withColumn("_y", c(target))
    base = ics.with_p_values(ics.newey_west(ics.daily_ic(df, list(families), target)))
    weak = {r.feature for r in base.where((c("p_value") > parent_p) & (F.abs("ic_mean") < parent_ic)).select("feature").collect()}  # a row a base feature
    live = {n for n, (_, parents) in made.items() if not all(p in weak for p in parents)}

    values = interactions(df, families, keep).where("value is not null and _y is not null")
    from tidepanel.functions import windows as w
    from tidepanel.operators.selection import fold_agreement

    ranked = values.withColumns({"rx": w.percent_rank(c("value"), keys=("dt", "feature")), "ry": w.percent_rank(c("_y"), keys=("dt", "feature"))})
    ic = ranked.groupBy("dt", "feature").agg(ics.safe_corr(c("rx"), c("ry")).alias("ic"), F.count("*").alias("n")).where("n >= 3")
    tested = ics.benjamini_hochberg(ics.with_p_values(ics.newey_west(ic.where(c("feature").isin(list(live))))), alpha=alpha)
    tested = tested.join(fold_agreement(ic, 5).select("feature", "agreement"), "feature")
    # largest correlation with a base feature, all in one pass
    own = values.join(df.select("dt", "ticker", *families), ["dt", "ticker"])
    near = own.groupBy("feature").agg(F.greatest(*(F.coalesce(F.abs(ics.safe_corr(c("value"), c(b))), F.lit(0.0)) for b in families)).alias("base_corr"))
    out = tested.join(near, "feature")
    failed = (
        F.when(~c("fdr_reject"), "fdr")
        .when(F.abs("ic_mean") < floor, "floor")
        .when(c("agreement") < agree, "folds")
        .when(c("base_corr") >= most_corr, "novelty")
    )
    from pyspark.sql import Window

    out = out.withColumn("stage", failed).withColumn("_r", F.row_number().over(Window.partitionBy(c("stage").isNull()).orderBy(F.desc(F.abs("ic_mean")), "feature")))
    out = out.withColumn("stage", F.coalesce("stage", F.when(c("_r") > cap, "cap").otherwise("kept"))).drop("_r")
    dead = df.sparkSession.createDataFrame([(n,) for n in made if n not in live], "feature string").withColumn("stage", F.lit("parents"))
    return out.unionByName(dead, allowMissingColumns=True)
