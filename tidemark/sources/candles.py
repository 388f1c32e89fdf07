"""Candle tables: reading, provider responses, choosing files, coverage; and candles made from event and order rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import TIMEFRAME_MS, timeframe_ms
from tidemark.schemas import BAR, KEYS

_NAME = r"([^/_]+)_([^/_]+)_([^/_]+?)(?:_(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2}))?\.(?:json|parquet)$"


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """Candle files source_symbol_timeframe[_from_to].json (arrays of bars) or .parquet, with their keys; bars with a missing field are refused."""
    if path.rstrip("/").endswith(".parquet"):
        bars = spark.read.schema(BAR).parquet(path)
    else:
        bars = spark.read.schema(BAR).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.col("_metadata.file_name")
    keys = [F.regexp_extract(name, _NAME, i + 1).alias(k) for i, k in enumerate(KEYS)]
    whole = F.lit(True)
    for c in BAR.names:
        whole = whole & F.col(c).isNotNull()
    checked = F.when(whole, F.col("timestamp")).otherwise(F.raise_error(F.lit("a candle lacks a field")).cast("long"))
    return bars.select(*keys, checked.alias("timestamp"), *BAR.names[1:])


def write_candle_table(candles: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """Candles as a table of one file a bucket of series keys, sorted by series and time, and that table.

    Windows, groups and joins by KEYS over it need no exchange, and a filter of keys or times skips what its statistics rule out. `path` makes
    it an external table. Buckets hold for the table's life: so many that one of them fits a task.
    """
    writer = candles.repartition(buckets, *KEYS).write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS, "timestamp").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return candles.sparkSession.table(table)


_CHART = "struct<chart:struct<result:array<struct<timestamp:array<long>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>,error:struct<description:string>>>"


def parse_chart_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Bars of provider responses of parallel arrays: seconds to milliseconds, bars with a null price left out, null volume as 0.

    A response without a result raises its description.
    """
    chart = F.from_json(F.col(body), _CHART)["chart"]
    others = [c for c in df.columns if c != body]
    rows = df.select(*others, chart.alias("_chart")).withColumn("_result", F.try_element_at(F.col("_chart.result"), F.lit(1)))
    text = F.coalesce(F.col("_chart.error.description"), F.lit("empty chart response"))
    quote = F.col("_result.indicators.quote")[0]
    bars = F.arrays_zip(F.col("_result.timestamp").alias("t"), *[quote[c].alias(c) for c in BAR.names[1:]])
    rows = rows.select(*others, F.inline(F.when(F.col("_result").isNull(), F.raise_error(text)).otherwise(bars)))
    present = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return rows.filter(present).select(*others, (F.col("t") * 1000).alias("timestamp"), "open", "high", "low", "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))


def pick_widest_file(files: DataFrame) -> DataFrame:
    """Of files(path) named as in `read_candles`, for each key the one whose name spans the most days; ties by name."""
    part = lambda i: F.regexp_extract("path", _NAME, i)
    rows = files.select("path", *[part(i + 1).alias(k) for i, k in enumerate(KEYS)], part(4).alias("since"), part(5).alias("until")).filter("source != ''")
    span = F.coalesce(F.datediff(F.try_to_date("until", "yyyy-MM-dd"), F.try_to_date("since", "yyyy-MM-dd")), F.lit(0))
    rows = rows.withColumn("days", span)
    best = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("days"), "path"))
    return rows.withColumn("_n", best).filter("_n = 1").drop("_n", "since", "until")


def file_symbol(symbol: Column) -> Column:
    """A symbol as file names have it."""
    return F.regexp_replace(symbol, "[/:]", "")


def date_range(candles: DataFrame, since: int | None = None, until: int | None = None) -> DataFrame:
    """since <= timestamp < until."""
    if since is not None:
        candles = candles.filter(F.col("timestamp") >= since)
    return candles if until is None else candles.filter(F.col("timestamp") < until)


def candle_coverage(candles: DataFrame, since: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """First and last bar, bars and years of each series, and whether it starts later than asked by more than one step."""
    out = candles.groupBy(*keys).agg(F.min("timestamp").alias("first_bar"), F.max("timestamp").alias("last_bar"), F.count(F.lit(1)).alias("bars"))
    years = (F.col("last_bar") - F.col("first_bar")) / (365.25 * 86_400_000)
    return out.withColumn("years", years).withColumn("late_start", F.col("first_bar") > since + timeframe_ms(F.col("timeframe")))


def bucket_candles(rows: DataFrame, symbol: Column, time_ms: Column, order: Column, price: Column, timeframe: str, source: str) -> DataFrame:
    """Candles of a table of single prices: one pass of partial aggregation, one shuffle of a row per bucket and task."""
    step = TIMEFRAME_MS[timeframe]
    rows = rows.select(symbol.alias("symbol"), time_ms.alias("t"), order.alias("o"), price.alias("p"))
    at = F.struct("t", "o")
    bucket = (F.col("t") - F.pmod("t", F.lit(step))).alias("timestamp")
    out = rows.groupBy("symbol", bucket).agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return out.select(F.lit(source).alias("source"), "symbol", F.lit(timeframe).alias("timeframe"), *BAR.names)


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp column, read as UTC whatever the session's time zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def event_candles(spark: SparkSession, sf_dir: str, timeframe: str = "1h", symbol: str = "event_type") -> DataFrame:
    """Candles of `events`: a symbol for each event type or user, price 100 + value / 10."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return bucket_candles(events, F.col(symbol).cast("string"), epoch_ms("ts"), F.col("event_id"), 100 + F.col("value") / 10, timeframe, "events")


def order_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of `orders` over several years, a symbol for each priority."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return bucket_candles(orders, F.col("o_orderpriority"), epoch_ms("o_orderdate"), F.col("o_orderkey"), 100 + F.col("o_totalprice") / 10_000, "1d", "orders")
