"""Universe construction: duplicates, clusters, caps, audits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import kernels
from tidepanel.operators.ic import safe_corr

c = F.col


def entity_correlations(df: DataFrame, value: str = "ret") -> DataFrame:
    """(a, b, corr) of entities a < b over the dates that both have: a self-join by date, summed by pair."""
    rows = df.select("dt", "ticker", c(value).alias("v")).where("v is not null")
    left, right = rows.select("dt", c("ticker").alias("a"), c("v").alias("x")), rows.select("dt", c("ticker").alias("b"), c("v").alias("y"))
    return left.join(right, "dt").where("a < b").groupBy("a", "b").agg(safe_corr(c("x"), c("y")).alias("corr"))


def duplicate_groups(df: DataFrame, adv: DataFrame, least: float = 0.99) -> DataFrame:
    """(ticker, dup_group, adv, canonical): components of entities correlated at ``least`` or more; the most traded stands for each.

    Labels are passed along edges until none changes; the edges are pairs of near-equal entities, few.
    """
    pairs = entity_correlations(df).where(c("corr") >= least).select("a", "b")
    edges = pairs.union(pairs.select("b", "a")).toDF("ticker", "other").cache()
    label = df.select("ticker").distinct().withColumn("g", c("ticker"))
    while True:
        near = edges.join(label.select(c("ticker").alias("other"), c("g").alias("h")), "other").groupBy("ticker").agg(F.min("h").alias("h"))
        new = label.join(near, "ticker", "left").select("ticker", c("g").alias("old"), F.least("g", "h").alias("g"))
        new = df.sparkSession.createDataFrame(new.toPandas(), "ticker string, old string, g string")  # a row an entity: cuts the lineage
        if not new.where("old != g").limit(1).count():
            break
        label = new.select("ticker", "g")
    edges.unpersist()
    best = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("adv"), "ticker")) == 1
    return new.join(adv, "ticker").select("ticker", c("g").alias("dup_group"), "adv", best.alias("canonical"))


def theme_clusters(df: DataFrame, least: float = 0.85) -> DataFrame:
    """(ticker, cluster_id) by average linkage on 1 - correlation, cut at 1 - ``least``: entities are some hundreds."""
    pairs = entity_correlations(df).toPandas()
    names = sorted(df.select("ticker").distinct().toPandas()["ticker"])
    at = {n: i for i, n in enumerate(names)}
    far = np.ones((len(names), len(names)))
    for a, b, r in pairs.itertuples(index=False):
        far[at[a], at[b]] = far[at[b], at[a]] = 1 - (0.0 if pd.isna(r) else r)
    label = kernels.average_linkage(far, 1 - least) if names else []
    return df.sparkSession.createDataFrame([(n, int(k)) for n, k in zip(names, label, strict=True)], "ticker string, cluster_id int")


def caps(df: DataFrame, risky: tuple[str, ...], cluster_cap: float, risky_cluster_cap: float, asset_cap: float, risky_asset_cap: float) -> DataFrame:
    """Add cluster_cap (lower if any member's family is risky) and asset_cap."""
    is_risky = c("family").isin(*risky)
    any_risky = F.max(is_risky.cast("int")).over(Window.partitionBy("cluster")) == 1
    return df.withColumns({"cluster_cap": F.when(any_risky, risky_cluster_cap).otherwise(cluster_cap), "asset_cap": F.when(is_risky, risky_asset_cap).otherwise(asset_cap)})


def audit(df: DataFrame) -> DataFrame:
    """(name, value): rows, repeated keys, bars out of range, longest gap between dates, missing closes."""
    one = df.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.countDistinct("dt", "ticker")).alias("repeated_keys"),
        F.count(F.when((c("high") < c("low")) | (c("close") > c("high") + 1e-9) | (c("close") < c("low") - 1e-9), 1)).alias("high_below_low"),
        F.count(F.when(c("close").isNull(), 1)).alias("null_closes"),
    )
    days = df.select("dt").distinct().withColumn("b", F.lag("dt").over(Window.orderBy("dt")))
    both = one.crossJoin(days.agg(F.max(F.datediff("dt", "b")).alias("longest_gap")))
    names = ["rows", "repeated_keys", "high_below_low", "longest_gap", "null_closes"]
    return both.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), c(n).cast("double").alias("value")) for n in names))))
