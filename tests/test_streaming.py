from pyspark.sql import functions as F

from tests.compare import SMALL
from tidemark.sources.candles import event_candles
from tidemark.streaming.candles import stream_candles


def test_stream_gives_the_batch_candles(spark, tmp_path):
    path = f"{tmp_path}/events"
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    last = events.agg(F.max("ts")).first()[0]
    # a last row far ahead moves the watermark, so that every other bar closes
    ahead = events.limit(1).withColumn("ts", (F.lit(last) + F.expr("INTERVAL 2 DAYS")).cast(events.schema["ts"].dataType))
    events.unionByName(ahead).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    bars = stream_candles(stream, F.col("event_type"), "ts", F.col("event_id"), 100 + F.col("value") / 10, "1h", "events")
    query = bars.writeStream.format("memory").queryName("bars").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["symbol"], r["timestamp"]): (r["open"], r["close"], r["volume"]) for r in spark.table("bars").collect()}
    want = {(r["symbol"], r["timestamp"]): (r["open"], r["close"], r["volume"]) for r in event_candles(spark, SMALL).collect()}
    assert got == want
