"""Sources and sinks: typed scans, incremental tables, sidecars and their registry."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = "dt date, ticker string, open double, high double, low double, close double, volume double"


def number(column: Column | str) -> Column:
    """Text with thousands separators as a number, or null."""
    return F.regexp_replace(F.trim(column), ",", "").try_cast("double")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header and a stated schema: nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Bars from a table partitioned by ticker; dates and tickers are pushed to the scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col("dt") >= F.lit(start).cast("date"))
    if end:
        df = df.where(F.col("dt") <= F.lit(end).cast("date"))
    return df.where(F.col("ticker").isin(tickers)) if tickers else df


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows of both by key, the one of highest ``order`` kept."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def write_panel(df: DataFrame, path: str, rows: int = 5_000_000, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet in files of bounded size, optionally partitioned; dynamic overwrite replaces touched partitions only."""
    writer = df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", rows)
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A small result as CSV or JSON: one file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)


def write_results(df: DataFrame, path: str, name: str, stamp: str, kind: str = "csv") -> list[str]:
    """A small result twice: under its time stamp, which stays, and as the latest, which is replaced. Returns both paths."""
    paths = [f"{path}/{name}_{stamp}", f"{path}/{name}_latest"]
    for to in paths:
        write_report(df, to, kind)
    return paths


def write_bundle(frames: dict[str, DataFrame], figures: dict[str, dict[str, float]], path: str, stamp: str, prefix: str = "attribution") -> list[str]:
    """Every frame that has rows as a file of its own, and all named figures as one summary (category, metric, value). Returns the paths."""
    paths = []
    for name, df in frames.items():
        if not df.isEmpty():
            paths.append(f"{path}/{prefix}_{name}_{stamp}")
            write_report(df, paths[-1])
    rows = [(k, m, None if v is None else float(v)) for k, of in figures.items() for m, v in of.items()]
    if rows:
        spark = SparkSession.active()
        paths.append(f"{path}/{prefix}_summary_{stamp}")
        write_report(spark.createDataFrame(rows, "category string, metric string, value double"), paths[-1])
    return paths


def config_hash(config: dict) -> str:
    """Twelve characters that name a configuration, whatever the order of its keys."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


SIDECAR = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "type", "config_hash", "config", "built_at", "path")] + [T.StructField("rows", T.LongType())])


def write_sidecar(spark: SparkSession, registry: str, name: str, kind: str, config: dict, built_at: str, path: str, rows: int) -> None:
    row = (name, kind, config_hash(config), json.dumps(config, sort_keys=True, default=str), built_at, path, rows)
    spark.createDataFrame([row], SIDECAR).coalesce(1).write.mode("append").json(registry)


def registered(spark: SparkSession, registry: str, name: str | None = None, kind: str | None = None, latest: bool = False) -> DataFrame:
    """Entries of a registry by name and type; with ``latest`` the newest of each name."""
    df = spark.read.schema(SIDECAR).json(registry)
    if name:
        df = df.where(F.col("name") == name)
    if kind:
        df = df.where(F.col("type") == kind)
    if latest:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("built_at")))).where("_r = 1").drop("_r")
    return df
