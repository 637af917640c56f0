"""What must hold of configurations, panels and targets: filters that drop, and gates that raise."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


class DataError(ValueError):
    """Data or a configuration that must not be worked on."""


@dataclass(frozen=True)
class Requirements:
    """Dates that bars must reach back and on to."""

    earliest: datetime.date
    latest: datetime.date
    lookback: int


def requirements(start: datetime.date, end: datetime.date, formation_years: float, training_years: float, max_lag: int, holding: int, today: datetime.date | None = None) -> Requirements:
    """Formation, training and lag in trading days of 252 a year, times 1.5 for the calendar; holding after the end, not beyond today."""
    lookback = int(formation_years * 252) + int(training_years * 252) + max_lag
    latest = end + datetime.timedelta(days=int(holding * 1.5))
    return Requirements(start - datetime.timedelta(days=int(lookback * 1.5)), min(latest, today) if today else latest, lookback)


def against_requirements(df: DataFrame, need: Requirements, tolerance: int = 5) -> DataFrame:
    """(ticker, first, last, late_days, short_days, fine): how each entity's dates meet ``need``, some days tolerated."""
    spans = df.groupBy("ticker").agg(F.min("dt").alias("first"), F.max("dt").alias("last"))
    spans = spans.withColumns({"late_days": F.greatest(F.lit(0), F.datediff("first", F.lit(need.earliest))), "short_days": F.greatest(F.lit(0), F.datediff(F.lit(need.latest), "last"))})
    return spans.withColumn("fine", (c("late_days") <= tolerance) & (c("short_days") <= tolerance))


def listed_in_time(df: DataFrame, start: datetime.date, warmup: int, tolerance: int = 5) -> DataFrame:
    """Rows of entities whose first date leaves ``warmup`` trading days (times 1.5) before ``start``."""
    by = start - datetime.timedelta(days=int(warmup * 1.5)) + datetime.timedelta(days=tolerance)
    return df.join(df.groupBy("ticker").agg(F.min("dt").alias("_first")).where(c("_first") <= F.lit(by)).select("ticker"), "ticker", "left_semi")


def dense_entities(df: DataFrame, name: str = "close", most: float = 0.10) -> DataFrame:
    """Rows of entities of whose values at most a share of ``most`` is missing."""
    return df.join(df.groupBy("ticker").agg(F.avg(c(name).isNull().cast("double")).alias("_s")).where(c("_s") <= most).select("ticker"), "ticker", "left_semi")


def column_health(df: DataFrame, names: list[str]) -> DataFrame:
    """(feature, n, null_share, mad): two passes over all rows, one row a column."""
    mids = df.agg(*(F.median(n).alias(f"m{i}") for i, n in enumerate(names))).first()
    mad = [F.median(F.abs(c(n) - F.lit(mids[i]).cast("double"))).alias(f"d{i}") for i, n in enumerate(names)]
    one = df.agg(*(F.count(n).alias(f"n{i}") for i, n in enumerate(names)), *(F.avg(c(n).isNull().cast("double")).alias(f"s{i}") for i, n in enumerate(names)), *mad)
    rows = (F.struct(F.lit(n).alias("feature"), c(f"n{i}").alias("n"), c(f"s{i}").alias("null_share"), c(f"d{i}").alias("mad")) for i, n in enumerate(names))
    return one.select(F.inline(F.array(*rows)))


def kept_columns(health: DataFrame, most: float = 0.10, least: int = 0, tiny: float | None = None) -> DataFrame:
    """``health`` with kept: nulls at most a share of ``most``, ``least`` values, and, with ``tiny``, a median deviation of that."""
    fine = (c("null_share") <= most) & (c("n") >= least)
    return health.withColumn("kept", F.coalesce(fine & (c("mad") >= tiny) if tiny is not None else fine, F.lit(False)))


def drop_columns(df: DataFrame, names: list[str], most: float = 0.10, least: int = 0, tiny: float | None = None) -> DataFrame:
    """``df`` without those of ``names`` that kept_columns rejects; ``most`` 0 drops every column with a null."""
    bad = [r.feature for r in kept_columns(column_health(df, names), most, least, tiny).where("not kept").collect()]  # a row a column
    return df.drop(*bad)


def gate(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if none of ``names`` has a null, NaN or infinite value in any row; else DataError, which says how many."""
    bad = lambda n: c(n).isNull() | F.isnan(c(n).cast("double")) | (F.abs(c(n).cast("double")) == float("inf"))
    found = df.agg(*(F.count(F.when(bad(n), 1)).alias(f"c{i}") for i, n in enumerate(names))).first()
    wrong = {n: found[i] for i, n in enumerate(names) if found[i]}
    if wrong:
        raise DataError("missing values: " + ", ".join(f"{n} {k}" for n, k in sorted(wrong.items())))
    return df


def available(df: DataFrame, start: datetime.date, warmup: int, fatal: bool) -> DataFrame:
    """(name, first, late): whether each series starts early enough; a late one raises where ``fatal``."""
    by = start - datetime.timedelta(days=int(warmup * 1.5))
    out = df.where(c("value").isNotNull()).groupBy("name").agg(F.min("dt").alias("first")).withColumn("late", c("first") > F.lit(by))
    if fatal and (late := [r.name for r in out.where("late").orderBy("name").collect()]):  # a row a series
        raise DataError("series start too late: " + ", ".join(late))
    return out


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Metadata with every column of ``defaults``, and its default where there is no value."""
    return df.withColumns({n: F.coalesce(c(n), F.lit(v)) if n in df.columns else F.lit(v) for n, v in defaults.items()})


def require_target(df: DataFrame, target: str) -> str:
    """``target``, if the panel has it as numbers and not only nulls: another column never takes its place."""
    if target not in df.columns:
        raise DataError(f"no column {target}")
    if df.schema[target].dataType.simpleString() not in ("double", "float", "int", "bigint"):
        raise DataError(f"{target} holds no numbers")
    if not df.where(c(target).isNotNull()).limit(1).count():
        raise DataError(f"{target} has no value")
    return target


def validate(config: dict) -> dict:
    """``config``, if its dates and settings can be worked with. Keys that it lacks are not judged."""
    wrong = []
    start, end = config.get("start"), config.get("end")
    if start and end and start >= end:
        wrong.append("start is not before end")
    needed = int((config.get("formation_years", 0) + config.get("training_years", 0)) * 365)
    if start and end and (end - start).days < needed:
        wrong.append(f"the dates hold under {needed} days")
    for name in ("long_quantile", "short_quantile", "utilisation", "cap"):
        if name in config and not 0 < config[name] <= 1:
            wrong.append(f"{name} is not between 0 and 1")
    for name in ("horizon", "step"):
        if name in config and config[name] < 1:
            wrong.append(f"{name} is below 1")
    if config.get("long_only") and config.get("short_only"):
        wrong.append("long_only and short_only exclude each other")
    if "mode" in config and config["mode"] not in ("ls", "long_only", "short_only", "cash"):
        wrong.append(f"no mode {config['mode']}")
    if wrong:
        raise DataError("; ".join(wrong))
    return config


def label_diagnostics(df: DataFrame, names: list[str]) -> DataFrame:
    """(label, n, n_valid, mean, std, least, most, q01, q99, max_abs_daily_mean, mean_daily_std), a row a label."""
    rows = df.select("dt", F.inline(F.array(*(F.struct(F.lit(n).alias("label"), c(n).cast("double").alias("value")) for n in names))))
    daily = rows.groupBy("label", "dt").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).groupBy("label").agg(F.max(F.abs("m")).alias("max_abs_daily_mean"), F.avg("s").alias("mean_daily_std"))
    whole = rows.groupBy("label").agg(
        F.count("*").alias("n"), F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.percentile("value", F.lit(0.01)).alias("q01"), F.percentile("value", F.lit(0.99)).alias("q99"),
    )
    return whole.join(daily, "label")
