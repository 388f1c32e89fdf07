"""Schemas of the tables that the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ("source", "symbol", "timeframe")

BAR = T.StructType([T.StructField("timestamp", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume"))])
CANDLE = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), *BAR.fields])

_INDICATOR = T.StructType([T.StructField("type", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("input", T.StringType()), T.StructField("outputKey", T.StringType())])
_BINDING = T.StructType([T.StructField("type", T.StringType()), T.StructField("source", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])
_ENTRY = T.StructType([T.StructField("direction", T.StringType()), T.StructField("trigger", T.StringType()), T.StructField("conditions", T.ArrayType(T.StringType())), T.StructField("gate", T.StringType()), T.StructField("offset", T.StringType())])
_EXIT = T.StructType([T.StructField("conditions", T.ArrayType(T.StringType())), *(T.StructField(c, T.StringType()) for c in ("stopLoss", "takeProfit", "takeProfit2", "triggerTime"))])
SPEC = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("id", "name", "source", "version", "strategyType", "timeframe", "assetClass")),
        T.StructField("indicators", T.ArrayType(_INDICATOR)),
        T.StructField("bindings", T.MapType(T.StringType(), _BINDING)),
        T.StructField("entry", _ENTRY),
        T.StructField("exit", _EXIT),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("parsedBy", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("rawHash", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("createdAt", T.LongType()),
    ]
)
STRATEGY_TYPES = ("condition", "mtf_scored", "scored", "pattern", "session")
DIRECTIONS = ("BUY", "SELL", "BOTH")
