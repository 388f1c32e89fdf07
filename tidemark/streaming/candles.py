"""Candles of a stream of single prices.

The batch sources make candles with one aggregation, which works on a stream as it is: the watermark closes a bucket once
no price of it is expected any more, and a closed bar is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import TIMEFRAME_MS


def stream_candles(rows: DataFrame, symbol: Column, ts: str, order: Column, price: Column, timeframe: str, source: str, late: str = "10 minutes") -> DataFrame:
    """Closed candles of a streaming table of prices; rows later than `late` are left out."""
    rows = rows.select(symbol.alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), order.alias("o"), price.alias("p")).withWatermark("ts", late)
    at = F.struct("ts", "o")
    bars = rows.groupBy(F.window("ts", f"{TIMEFRAME_MS[timeframe]} milliseconds").alias("w"), "symbol").agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    keys = [F.lit(source).alias("source"), "symbol", F.lit(timeframe).alias("timeframe"), F.unix_millis("w.start").alias("timestamp")]
    return bars.select(*keys, "open", "high", "low", "close", "volume")
