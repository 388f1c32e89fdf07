"""Small candle tables."""

from tidemark.schemas import CANDLE


def bars(spark, closes, symbol="x", spread=0.0, volume=1.0, start=0, step=1, opens=None):
    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if isinstance(opens, list) else opens if opens is not None else c
        rows.append(("s", symbol, "1h", start + i * step, float(o), float(c + spread), float(c - spread), float(c), volume))
    return spark.createDataFrame(rows, CANDLE).repartition(2)


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "timestamp").collect()]
