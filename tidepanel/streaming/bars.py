"""Streaming variants: bars from a stream of trades, and running features of bars as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, ema double, obv double, streak long, last double"
RUNNING = "ticker string, dt timestamp, close double, ema double, obv double, streak long"


def windowed_bars(trades: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(ticker, dt, high, low, close, volume) of trades (ticker, ts, price, quantity) by time window.

    close is the volume-weighted price. Trades later than ``late`` are dropped with their window's state.
    """
    windows = trades.withWatermark("ts", late).groupBy(F.window("ts", every), "ticker")
    value = F.sum(F.col("price") * F.col("quantity"))
    made = windows.agg(F.max("price").alias("high"), F.min("price").alias("low"), F.try_divide(value, F.sum("quantity")).alias("close"), F.sum("quantity").alias("volume"))
    return made.select("ticker", F.col("window.start").alias("dt"), "high", "low", "close", "volume")


def running_features(bars: DataFrame, span: int = 21) -> DataFrame:
    """Exponential average, signed volume and streak of each ticker's bars (dt timestamp), kept as state: one small
    row a ticker, whatever the length of its history. Bars of a ticker count in the order of dt within a batch."""
    alpha = 2 / (span + 1)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ema, obv, streak, last = state.get if state.exists else (0, 0.0, 0.0, 0, float("nan"))
        out = []
        for row in pd.concat(list(parts)).sort_values("dt").itertuples():
            sign = 0 if n == 0 else (row.close > last) - (row.close < last)
            ema = row.close if n == 0 else alpha * row.close + (1 - alpha) * ema
            obv += sign * row.volume
            streak = streak + sign if sign and streak * sign > 0 else sign
            n, last = n + 1, row.close
            out.append((key[0], row.dt, row.close, ema, obv, streak))
        state.update((n, float(ema), float(obv), int(streak), float(last)))
        yield pd.DataFrame(out, columns=["ticker", "dt", "close", "ema", "obv", "streak"])

    return bars.select("ticker", "dt", "close", "volume").groupBy("ticker").applyInPandasWithState(update, RUNNING, STATE, "append", GroupStateTimeout.NoTimeout)


def append_bars(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of bars to a table partitioned by ticker, with what has arrived until now, and end."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("ticker").trigger(availableNow=True).start()
