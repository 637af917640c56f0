"""The panel that the registered queries run on, and the same relations in SQL.

The tables have no prices, so bars are made of them: a bar is a week of a brand, from the unit
prices of its line items. All of it is free of the order of rows, and sums are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.windows import rounded
from tidepanel.operators.timeseries import with_returns


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dt, ticker, open, high, low, close, volume) by week and brand.

    The dimension is joined as the optimiser finds best; items are then summed by week and brand in
    each task before they are shuffled, so that a brand with many items is no hot key.
    """
    items = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("dt"), "ticker")
        .agg(F.max(unit).alias("high"), F.min(unit).alias("low"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("n"))
        .select(
            "dt",
            "ticker",
            ((F.col("high") + F.col("low")) / 2).alias("open"),
            "high",
            "low",
            (F.col("cents").cast("double") / (F.col("n") * 100).cast("double")).alias("close"),
            F.col("n").cast("double").alias("volume"),
        )
    )


BARS = """
bars AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS dt, p_brand AS ticker,
    (max(l_extendedprice / l_quantity) + min(l_extendedprice / l_quantity)) / 2 AS open,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) * 100 AS DOUBLE) AS close,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with ret (simple return), pct (in per cent) and x (pct, clipped at five deviations)."""
    return with_returns(bars(spark, sf_dir))


T = "(PARTITION BY ticker ORDER BY dt)"

PANEL = f"""{BARS}, r0 AS (SELECT *, close / lag(close) OVER {T} - 1 AS ret, (close / lag(close) OVER {T} - 1) * 100.0 AS pct FROM bars
), panel AS (
  SELECT *, CASE WHEN pct IS NOT NULL THEN least(greatest(pct, -5.0 * stddev_samp(pct) OVER (PARTITION BY ticker)), 5.0 * stddev_samp(pct) OVER (PARTITION BY ticker)) END AS x FROM r0
)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slower series (name, dt, value): monthly averages and counts of orders."""
    orders = read(spark, sf_dir, "orders").withColumn("dt", F.date_trunc("month", "o_orderdate").cast("date"))
    monthly = orders.groupBy("dt").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))
    return monthly.select("dt", F.expr("stack(2, 'price', cents / (n * 100.0D), 'orders', cast(n as double)) as (name, value)")).select("name", "dt", "value")


SERIES = """
monthly AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS dt, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS cents, count(*) AS n FROM orders GROUP BY 1
), series AS (
  SELECT 'price' AS name, dt, cents / (n * 100.0) AS value FROM monthly UNION ALL SELECT 'orders', dt, CAST(n AS DOUBLE) FROM monthly
)"""


def shown(df: DataFrame, names: Sequence[str], digits: int = 6, keys: Sequence[str] = ("dt", "ticker")) -> DataFrame:
    return df.select(*keys, *(rounded(n, digits) for n in names))


# Rolling expressions in SQL, written apart from the operators.


def frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(call: str, x: str, n: int, least: int | None = None) -> str:
    """A rolling aggregate: ``call`` with {x}, over n rows with at least ``least`` values."""
    return f"(CASE WHEN count({x}) OVER {frame(n)} >= {n if least is None else least} THEN {call.format(x=x)} OVER {frame(n)} END)"


def avg(x: str, n: int, least: int | None = None) -> str:
    return roll("avg({x})", x, n, least)


def dev(x: str, n: int, least: int | None = None) -> str:
    return roll("stddev_samp({x})", x, n, max(2, n if least is None else least))


def co(x: str, y: str, n: int, least: int | None = None, kind: str = "corr") -> str:
    xx, yy = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    value = f"covar_samp({xx}, {yy}) OVER {frame(n)}"
    if kind == "corr":
        value = f"{value} / nullif(stddev_samp({xx}) OVER {frame(n)} * stddev_samp({yy}) OVER {frame(n)}, 0)"
    return f"(CASE WHEN count({xx} + {yy}) OVER {frame(n)} >= {max(2, n if least is None else least)} THEN {value} END)"


def rank_pct(x: str, keys: str = "dt") -> str:
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
        f" / count({x}) OVER (PARTITION BY {keys}) END)"
    )


def select(columns: dict[str, str], digits: int = 6, source: str = "panel", keys: str = "dt, ticker", with_: str = PANEL) -> str:
    """A whole statement: the named expressions, rounded, over ``source``."""
    listed = ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())
    return f"WITH {with_} SELECT {keys}, {listed} FROM {source}"

