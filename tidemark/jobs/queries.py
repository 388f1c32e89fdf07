"""The registered queries of the trading and corpus jobs, and their SQL.

Candles come from `events` (hourly, a symbol for each event type) and `orders` (daily over several years, a symbol for
each priority). Scripts come from `part`: a script for each part, whose title, periods and rules follow from its columns.
Doubles are rounded to six decimals, as sums differ in their order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.rules import rule_filter, window
from tidemark.jobs.rank_files import rank_files
from tidemark.operators import blocks, corpus, indicators, positions, recursive, series, strategies, sweep
from tidemark.operators.strategies import Binding, Strategy
from tidemark.schemas import KEYS
from tidemark.sources import candles as source
from tidemark.sources import specs as spec_source
from tidemark.sources import stores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _r(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


#: Added before rounding where exact halves occur, on both sides.
_NUDGE = 0.000000037


# Candles in SQL.
_EVENT_BARS = """ev AS (SELECT event_type AS symbol, (epoch_us(ts) // 1000) AS t, event_id AS o, 100 + value / 10 AS p FROM events),
bars AS (SELECT 'events' AS source, symbol, '1h' AS timeframe, t - t % 3600000 AS timestamp, first(p ORDER BY t, o) AS open, max(p) AS high, min(p) AS low,
 last(p ORDER BY t, o) AS close, count(*)::DOUBLE AS volume FROM ev GROUP BY symbol, t - t % 3600000)"""
_ORDER_BARS = """ord AS (SELECT o_orderpriority AS symbol, (epoch_us(o_orderdate) // 1000) AS t, o_orderkey AS o, 100 + o_totalprice / 10000 AS p FROM orders),
days AS (SELECT 'orders' AS source, symbol, '1d' AS timeframe, t - t % 86400000 AS timestamp, first(p ORDER BY t, o) AS open, max(p) AS high, min(p) AS low,
 last(p ORDER BY t, o) AS close, count(*)::DOUBLE AS volume FROM ord GROUP BY symbol, t - t % 86400000)"""
_W = "(PARTITION BY source, symbol, timeframe ORDER BY timestamp)"


def _roll(n: int) -> str:
    return f"(PARTITION BY source, symbol, timeframe ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(x: str, value: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_roll(n)} = {n} THEN {value} END"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.event_candles(spark, sf_dir, "1h")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.order_candles(spark, sf_dir)


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{blocks.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


_BAR_COLUMNS = "source, symbol, timeframe, timestamp, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume"


@query(f"WITH {_EVENT_BARS} SELECT {_BAR_COLUMNS} FROM bars")
def candles_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir).select(*KEYS, "timestamp", *[_r(c) for c in ("open", "high", "low", "close")], "volume")


@query(f"WITH {_ORDER_BARS} SELECT {_BAR_COLUMNS} FROM days")
def candles_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).select(*KEYS, "timestamp", *[_r(c) for c in ("open", "high", "low", "close")], "volume")


@query(
    """WITH b AS (SELECT user_id, (epoch_us(date_trunc('day', ts)) // 1000) AS d, (epoch_us(ts) // 1000) AS t, event_id, value FROM events)
SELECT user_id, (t // 1000) * 1000 AS timestamp, round(value, 6) AS open, round(value, 6) AS high, round(value, 6) AS low, round(value, 6) AS close,
 (CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 1.0 END)::DOUBLE AS volume FROM b WHERE event_id % 7 <> 0"""
)
def chart_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's form of each user's events, made from the table and parsed back; every seventh bar lacks its open, every fifth its volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", source.epoch_ms("ts").alias("t"), "value")
    parts = e.groupBy("user_id", F.floor(F.col("t") / scalars.DAY_MS).alias("d")).agg(F.sort_array(F.collect_list(F.struct("event_id", "t", "value"))).alias("x"))
    price = lambda gap: F.transform("x", lambda r: F.when(r["event_id"] % 7 != 0, r["value"]) if gap else r["value"])
    volume = F.transform("x", lambda r: F.when(r["event_id"] % 5 != 0, F.lit(1.0)))
    quote = F.struct(price(True).alias("open"), price(False).alias("high"), price(False).alias("low"), price(False).alias("close"), volume.alias("volume"))
    one = F.struct(F.transform("x", lambda r: F.floor(r["t"] / 1000)).alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    body = F.to_json(F.struct(F.struct(F.array(one).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return source.parse_chart_json(parts.select("user_id", body.alias("body"))).select("user_id", "timestamp", *[_r(c) for c in ("open", "high", "low", "close")], "volume")


@query(
    """WITH f AS (SELECT 'binance' AS source, o_orderpriority AS symbol, '1d' AS timeframe, o_orderstatus AS st, min(o_orderdate)::DATE AS since, max(o_orderdate)::DATE AS until FROM orders GROUP BY ALL),
n AS (SELECT *, 'binance_' || regexp_replace(symbol, '[^A-Za-z0-9]', '', 'g') || '_1d_' || since || '_' || until || '.json' AS path, regexp_replace(symbol, '[^A-Za-z0-9]', '', 'g') AS s FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY until - since DESC, path) AS n FROM n)
SELECT DISTINCT path, source, s AS symbol, timeframe, (until - since)::BIGINT AS days FROM r WHERE n = 1"""
)
def widest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: file names made of the date spans of each order status, the widest of each symbol."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority", "o_orderstatus").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    path = F.concat(F.lit("binance_"), F.regexp_replace("o_orderpriority", "[^A-Za-z0-9]", ""), F.lit("_1d_"), F.col("a").cast("string"), F.lit("_"), F.col("b").cast("string"), F.lit(".json"))
    return source.pick_widest_file(o.select(path.alias("path"))).select("path", *KEYS, F.col("days").cast("long").alias("days"))


@query(f"""WITH {_EVENT_BARS} SELECT source, symbol, timeframe, timestamp, round((high + low) / 2, 6) AS hl2, round((high + low + close) / 3, 6) AS hlc3, round((open + high + low + close) / 4, 6) AS ohlc4,
 row_number() OVER {_W} - 1 AS bar_index FROM bars""")
def typical_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P2."""
    rows = series.bar_index(series.with_typical_prices(_hourly(spark, sf_dir)))
    return rows.select(*KEYS, "timestamp", _r("hl2"), _r("hlc3"), _r("ohlc4"), F.col("bar_index").cast("long").alias("bar_index"))


@query(f"WITH {_ORDER_BARS}, l AS (SELECT *, max(timestamp) OVER (PARTITION BY source, symbol, timeframe) AS m FROM days) SELECT source, symbol, timeframe, timestamp, round(close, 6) AS close FROM l WHERE timestamp >= m - 3 * 31557600000.0")
def window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5."""
    return series.window_slice(_daily(spark, sf_dir), 3).select(*KEYS, "timestamp", _r("close"))


@query(f"""WITH {_EVENT_BARS}, n AS (SELECT *, row_number() OVER {_W} AS i, count(*) OVER (PARTITION BY source, symbol, timeframe) AS n FROM bars)
SELECT source, symbol, timeframe, timestamp, CASE WHEN i <= n * 2 // 3 THEN 'train' ELSE 'test' END AS slice FROM n WHERE n * 2 // 3 > 0 AND n * 2 // 3 < n""")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6."""
    return series.train_test_split(_hourly(spark, sf_dir)).select(*KEYS, "timestamp", "slice")


@query(f"WITH {_EVENT_BARS} SELECT source, symbol, timeframe, timestamp, round(close, 6) AS close FROM bars WHERE timestamp >= 1704672000000 AND timestamp < 1705276800000")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One week."""
    return source.date_range(_hourly(spark, sf_dir), 1_704_672_000_000, 1_705_276_800_000).select(*KEYS, "timestamp", _r("close"))


@query(f"""WITH {_EVENT_BARS} SELECT source, symbol, timeframe, min(timestamp) AS first_bar, max(timestamp) AS last_bar, count(*) AS bars, round((max(timestamp) - min(timestamp)) / 31557600000.0, 6) AS years,
 min(timestamp) > 1704067200000 + 3600000 AS late_start FROM bars GROUP BY ALL""")
def candle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return source.candle_coverage(_hourly(spark, sf_dir), 1_704_067_200_000).select(*KEYS, "first_bar", "last_bar", "bars", _r("years"), "late_start")


@query(f"WITH {_ORDER_BARS} SELECT source, symbol, timeframe, round((last(close ORDER BY timestamp) / first(close ORDER BY timestamp) - 1) * 100, 6) AS buy_hold FROM days GROUP BY ALL")
def buy_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2."""
    return series.buy_hold(_daily(spark, sf_dir)).select(*KEYS, _r("buy_hold"))


_PER_YEAR = """gaps AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap, row_number() OVER w AS i FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY timestamp)),
med AS (SELECT {k}, count(*) AS n, list_sort(list(gap) FILTER (i <= 200 AND gap IS NOT NULL)) AS g FROM gaps GROUP BY ALL),
per_year AS (SELECT {k}, CASE WHEN n < 3 THEN 252.0 ELSE 31557600000.0 / (CASE WHEN g[len(g) // 2 + 1] = 0 THEN 3600000 ELSE g[len(g) // 2 + 1] END) END AS bars_per_year FROM med)"""
_K = "source, symbol, timeframe"


@query(f"WITH {_EVENT_BARS}, {_PER_YEAR.format(t='bars', k=_K)} SELECT source, symbol, timeframe, round(bars_per_year, 6) AS bars_per_year FROM per_year")
def bars_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return series.bars_per_year(_hourly(spark, sf_dir)).select(*KEYS, _r("bars_per_year"))


@query(f"""WITH {_ORDER_BARS}, s AS (SELECT source, symbol, timeframe, (max(timestamp) - min(timestamp)) / 31557600000.0 AS f FROM days GROUP BY ALL),
y AS (SELECT DISTINCT source, symbol, timeframe, f, unnest([3, 5, floor(f + 0.5)::INT]) AS years FROM s) SELECT source, symbol, timeframe, years FROM y WHERE years > 0 AND years <= f + 0.1""")
def window_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4."""
    return series.window_list(_daily(spark, sf_dir))


# Bounded indicators: Spark column(s) and SQL of each.
_TP = "(high + low + close) / 3"
_WMA = "list_sum(list_transform(list({x}) OVER " + "{roll}" + ", lambda v, i: v * i)) / {d}"


def _wma(x: str, n: int) -> str:
    return _full(x, _WMA.format(x=x, roll=_roll(n), d=f"{n * (n + 1) / 2}"), n)


_SIMPLE: dict[str, tuple[Callable[[DataFrame], DataFrame], dict[str, str]]] = {
    "i01_sma": (lambda d: indicators.sma(d), {"sma": _full("close", f"avg(close) OVER {_roll(20)}", 20)}),
    "i02_wma": (lambda d: indicators.wma(d), {"wma": _wma("close", 20)}),
    "i04_stddev": (lambda d: indicators.stddev(d), {"stddev": _full("close", f"stddev_pop(close) OVER {_roll(20)}", 20)}),
    "i05_highest_lowest": (lambda d: indicators.lowest(indicators.highest(d)), {"highest": _full("close", f"max(close) OVER {_roll(14)}", 14), "lowest": _full("close", f"min(close) OVER {_roll(14)}", 14)}),
    "i06_bollinger": (
        lambda d: indicators.bollinger(d),
        {"bb__middle": _full("close", f"avg(close) OVER {_roll(20)}", 20)} | {f"bb__{n}": _full("close", f"avg(close) OVER {_roll(20)} {s} 2 * stddev_pop(close) OVER {_roll(20)}", 20) for n, s in (("upper", "+"), ("lower", "-"))},
    ),
    "i07_roc": (lambda d: indicators.roc(d), {"roc": f"(close - lag(close, 12) OVER {_W}) / lag(close, 12) OVER {_W}"}),
    "i08_mom": (lambda d: indicators.mom(d), {"mom": f"close - lag(close, 10) OVER {_W}"}),
    "i09_true_range": (lambda d: indicators.true_range(d), {"tr": f"greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W}))"}),
    "i10_vwap": (lambda d: indicators.vwap(d).withColumn("vwap", F.col("vwap") + _NUDGE), {"vwap": f"sum({_TP} * volume) OVER {_W} / sum(volume) OVER {_W} + {_NUDGE}"}),
    "i11_vwma": (lambda d: indicators.vwma(d).withColumn("vwma", F.col("vwma") + _NUDGE), {"vwma": _full("close", f"sum(close * volume) OVER {_roll(20)} / sum(volume) OVER {_roll(20)} + {_NUDGE}", 20)}),
}


def _indicator_query(build: Callable[[DataFrame], DataFrame], names: list[str]) -> Query:
    return lambda spark, sf_dir: build(_hourly(spark, sf_dir)).select(*KEYS, "timestamp", *[_r(n) for n in names])


for _name, (_build, _columns) in _SIMPLE.items():
    _sql = ", ".join(f"round({x}, 6) AS {n}" for n, x in _columns.items())
    query(f"WITH {_EVENT_BARS} SELECT source, symbol, timeframe, timestamp, {_sql} FROM bars", _name)(_indicator_query(_build, list(_columns)))

query(
    f"WITH {_EVENT_BARS}, r AS (SELECT *, 2 * {_wma('close', 10)} - {_wma('close', 20)} AS x FROM bars) SELECT source, symbol, timeframe, timestamp, round({_wma('x', 4)}, 6) AS hma FROM r",
    "i03_hma",
)(_indicator_query(lambda d: indicators.hma(d), ["hma"]))
@query(f"WITH {_EVENT_BARS} SELECT source, symbol, timeframe, timestamp, round({_full('close', f'avg(close) OVER {_roll(20)}', 20)}, 6) AS sma FROM bars WHERE timestamp >= 0")
def bucketed_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles written as a bucketed table, and a mean over it, without an exchange of its own."""
    table = source.write_candle_table(_hourly(spark, sf_dir), f"candles_{uuid.uuid4().hex}", 8, _new_folder(spark, "candles"))
    return indicators.sma(source.date_range(table, 0)).select(*KEYS, "timestamp", _r("sma"))


# Periods too long for sliding frames: the same values from blocks.
_LONG: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "sma": (lambda d: indicators.sma(d, 100), _full("close", f"avg(close) OVER {_roll(100)}", 100)),
    "wma": (lambda d: indicators.wma(d, 100), _wma("close", 100)),
    "stddev": (lambda d: indicators.stddev(d, 100), _full("close", f"stddev_pop(close) OVER {_roll(100)}", 100)),
    "highest": (lambda d: indicators.highest(d, 100), _full("close", f"max(close) OVER {_roll(100)}", 100)),
    "lowest": (lambda d: indicators.lowest(d, 90), _full("close", f"min(close) OVER {_roll(90)}", 90)),
    "bb__upper": (lambda d: indicators.bollinger(d, 100), _full("close", f"avg(close) OVER {_roll(100)} + 2 * stddev_pop(close) OVER {_roll(100)}", 100)),
    "vwma": (lambda d: indicators.vwma(d, 90).withColumn("vwma", F.col("vwma") + _NUDGE), _full("close", f"sum(close * volume) OVER {_roll(90)} / sum(volume) OVER {_roll(90)} + {_NUDGE}", 90)),
}
query(
    f"WITH {_EVENT_BARS} SELECT source, symbol, timeframe, timestamp, {', '.join(f'round({sql}, 6) AS {n}' for n, (_, sql) in _LONG.items())} FROM bars",
    "long_windows",
)(_indicator_query(lambda d: reduce(lambda df, build: build[0](df), _LONG.values(), d), list(_LONG)))
query(
    f"""WITH {_EVENT_BARS}, x AS (SELECT *, {_TP} AS tp FROM bars), l AS (SELECT *, list(tp) OVER {_roll(20)} AS a, avg(tp) OVER {_roll(20)} AS m FROM x),
d AS (SELECT *, list_avg(list_transform(a, lambda v: abs(v - m))) AS mad FROM l)
SELECT source, symbol, timeframe, timestamp, CASE WHEN len(a) = 20 AND mad <> 0 THEN round((tp - m) / (0.015 * mad), 6) END AS cci FROM d""",
    "i12_cci",
)(_indicator_query(lambda d: indicators.cci(d), ["cci"]))
query(
    f"""WITH {_EVENT_BARS}, x AS (SELECT *, {_full("low", f"min(low) OVER {_roll(14)}", 14)} AS ll, {_full("high", f"max(high) OVER {_roll(14)}", 14)} AS hh FROM bars),
r AS (SELECT *, CASE WHEN hh <> ll THEN 100 * (close - ll) / (hh - ll) END AS raw FROM x), k AS (SELECT *, {_full("raw", f"avg(raw) OVER {_roll(3)}", 3)} AS k FROM r),
d AS (SELECT *, {_full("k", f"avg(k) OVER {_roll(3)}", 3)} AS d FROM k) SELECT source, symbol, timeframe, timestamp, round(k, 6) AS "stoch__stochK", round(d, 6) AS "stoch__stochD", round(3 * k - 2 * d, 6) AS "stoch__stochJ" FROM d""",
    "i13_stoch",
)(_indicator_query(lambda d: indicators.stoch(d), ["stoch__stochK", "stoch__stochD", "stoch__stochJ"]))

#: Length of a block, where a query runs over blocks of its series: so that also a month of hours has several.
WEEK_MS = 7 * scalars.DAY_MS

# Recursive indicators in SQL: folds over each series' list of values.
_LISTS = "s AS (SELECT source, symbol, timeframe, list(timestamp ORDER BY timestamp) AS ts, list(close ORDER BY timestamp) AS c, list(high ORDER BY timestamp) AS h, list(low ORDER BY timestamp) AS l FROM bars GROUP BY ALL)"


def _fold(x: str, alpha: str, n: int, wilder: bool) -> str:
    """SQL of a list: the running mean of list x at each place, NULL before it is warm."""
    grow = f"list_reduce({{seed}}, lambda a, v: list_append(a, {alpha} * v + (1 - {alpha}) * a[-1]), {{start}})"
    if wilder:
        start = f"[list_avg({x}[1:{n}])]"
        run = grow.format(seed=f"{x}[{n + 1}:]", start=start)
        return f"CASE WHEN len({x}) > {n} THEN list_concat(list_transform(range({n - 1}), lambda q: NULL::DOUBLE), {run}) WHEN len({x}) = {n} THEN list_concat(list_transform(range({n - 1}), lambda q: NULL::DOUBLE), {start}) ELSE list_transform({x}, lambda q: NULL::DOUBLE) END"
    run = grow.format(seed=f"{x}[2:]", start=f"[{x}[1]]")
    return f"CASE WHEN len({x}) > 1 THEN list_transform({run}, lambda v, i: CASE WHEN i >= {n} THEN v END) ELSE list_transform({x}, lambda v, i: CASE WHEN i >= {n} THEN v END) END"


_DIFF = "list_transform(c[2:], lambda v, i: v - c[i])"
_TR_LIST = "list_transform(c, lambda v, i: CASE WHEN i = 1 THEN h[i] - l[i] ELSE greatest(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1])) END)"
_OUT = "SELECT source, symbol, timeframe, unnest(ts) AS timestamp, {cols} FROM {t}"


def _recursive(kind: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = recursive.recursive_indicators(_hourly(spark, sf_dir), [(kind, {}, "close", name)], block_ms=WEEK_MS)
        return out.select(*KEYS, "timestamp", *[_r(n) for n in recursive.output_names(kind, name)])

    return run


_FOLDS = {
    "i14_ema": ("EMA", "ema", f"{_LISTS}, e AS (SELECT *, {_fold('c', '(2.0 / 21)', 20, False)} AS x FROM s) SELECT source, symbol, timeframe, unnest(ts) AS timestamp, round(unnest(x), 6) AS ema FROM e"),
    "i15_rma": ("RMA", "rma", f"{_LISTS}, e AS (SELECT *, {_fold('c', '(1.0 / 14)', 14, True)} AS x FROM s) SELECT source, symbol, timeframe, unnest(ts) AS timestamp, round(unnest(x), 6) AS rma FROM e"),
    "i16_rsi": (
        "RSI",
        "rsi",
        f"""{_LISTS}, g AS (SELECT *, list_transform({_DIFF}, lambda v: greatest(v, 0)) AS up, list_transform({_DIFF}, lambda v: greatest(-v, 0)) AS dn FROM s),
e AS (SELECT *, {_fold('up', '(1.0 / 14)', 14, True)} AS u, {_fold('dn', '(1.0 / 14)', 14, True)} AS d FROM g),
r AS (SELECT *, list_concat([NULL::DOUBLE], list_transform(u, lambda v, i: CASE WHEN v IS NULL THEN NULL WHEN d[i] = 0 THEN 100 ELSE 100 - 100 / (1 + v / d[i]) END)) AS x FROM e)
SELECT source, symbol, timeframe, unnest(ts) AS timestamp, round(unnest(x), 6) AS rsi FROM r""",
    ),
    "i17_atr": ("ATR", "atr", f"{_LISTS}, t AS (SELECT *, {_TR_LIST} AS tr FROM s), e AS (SELECT *, {_fold('tr', '(1.0 / 14)', 14, True)} AS x FROM t) SELECT source, symbol, timeframe, unnest(ts) AS timestamp, round(unnest(x), 6) AS atr FROM e"),
    "i18_adx": (
        "ADX",
        "adx",
        f"""{_LISTS}, t AS (SELECT *, ({_TR_LIST})[2:] AS tr, list_transform(h[2:], lambda v, i: v - h[i]) AS du, list_transform(l[2:], lambda v, i: l[i] - v) AS dd FROM s),
m AS (SELECT *, list_transform(du, lambda v, i: CASE WHEN v > dd[i] AND v > 0 THEN v ELSE 0.0 END) AS p, list_transform(dd, lambda v, i: CASE WHEN v > du[i] AND v > 0 THEN v ELSE 0.0 END) AS n FROM t),
e AS (SELECT *, {_fold('tr', '(1.0 / 14)', 14, True)} AS st, {_fold('p', '(1.0 / 14)', 14, True)} AS sp, {_fold('n', '(1.0 / 14)', 14, True)} AS sn FROM m),
x AS (SELECT *, list_transform(st[14:], lambda v, i: CASE WHEN v = 0 OR sp[i + 13] + sn[i + 13] = 0 THEN 0.0 ELSE 100 * abs(sp[i + 13] - sn[i + 13]) / (sp[i + 13] + sn[i + 13]) END) AS dx FROM e),
y AS (SELECT *, {_fold('dx', '(1.0 / 14)', 14, True)} AS z FROM x), o AS (SELECT *, list_concat(list_transform(range(14), lambda q: NULL::DOUBLE), z) AS x2 FROM y)
SELECT source, symbol, timeframe, unnest(ts) AS timestamp, round(unnest(x2), 6) AS adx FROM o""",
    ),
    "i19_macd": (
        "MACD",
        "macd",
        f"""{_LISTS}, e AS (SELECT *, {_fold('c', '(2.0 / 13)', 12, False)} AS f, {_fold('c', '(2.0 / 27)', 26, False)} AS w FROM s),
m AS (SELECT *, list_transform(f, lambda v, i: v - w[i]) AS line, list_transform(f[26:], lambda v, i: v - w[i + 25]) AS warm FROM e),
g AS (SELECT *, list_concat(list_transform(range(25), lambda q: NULL::DOUBLE), {_fold('warm', '(2.0 / 10)', 9, False)}) AS sig FROM m)
SELECT source, symbol, timeframe, unnest(ts) AS timestamp, round(unnest(line), 6) AS macd__macd, round(unnest(sig[1:len(line)]), 6) AS macd__signal,
 round(unnest(list_transform(line, lambda v, i: v - sig[i])), 6) AS macd__histogram FROM g""",
    ),
}
for _name, (_kind, _out, _sql) in _FOLDS.items():
    query(f"WITH {_EVENT_BARS}, {_sql}", _name)(_recursive(_kind, _out))

query(
    f"""WITH RECURSIVE {_EVENT_BARS}, {_LISTS}, t AS (SELECT *, {_TR_LIST} AS tr FROM s), e AS (SELECT *, {_fold('tr', '(1.0 / 10)', 10, True)} AS atr FROM t),
st(source, symbol, timeframe, i, up, lo, d) AS (
 SELECT source, symbol, timeframe, 10, (h[10] + l[10]) / 2 + 3 * atr[10], (h[10] + l[10]) / 2 - 3 * atr[10], 1 FROM e WHERE len(c) >= 10
 UNION ALL
 SELECT source, symbol, timeframe, i, nu, nl, CASE WHEN d < 0 THEN CASE WHEN x > nu THEN 1 ELSE -1 END ELSE CASE WHEN x < nl THEN -1 ELSE 1 END END FROM (
  SELECT st.source, st.symbol, st.timeframe, st.i + 1 AS i, st.d, e.c[st.i + 1] AS x,
   CASE WHEN (h[st.i + 1] + l[st.i + 1]) / 2 + 3 * atr[st.i + 1] < up OR c[st.i] > up THEN (h[st.i + 1] + l[st.i + 1]) / 2 + 3 * atr[st.i + 1] ELSE up END AS nu,
   CASE WHEN (h[st.i + 1] + l[st.i + 1]) / 2 - 3 * atr[st.i + 1] > lo OR c[st.i] < lo THEN (h[st.i + 1] + l[st.i + 1]) / 2 - 3 * atr[st.i + 1] ELSE lo END AS nl
  FROM st JOIN e ON st.source = e.source AND st.symbol = e.symbol AND st.timeframe = e.timeframe WHERE st.i < len(e.c)))
SELECT b.source, b.symbol, b.timeframe, b.timestamp, round(CASE WHEN d > 0 THEN lo WHEN d < 0 THEN up END, 6) AS st__value, d::DOUBLE AS st__dir
FROM (SELECT *, row_number() OVER {_W} AS i FROM bars) b LEFT JOIN st ON b.source = st.source AND b.symbol = st.symbol AND b.timeframe = st.timeframe AND b.i = st.i""",
    "i20_supertrend",
)(_recursive("SUPERTREND", "st"))


# Rules and positions. The SQL of positions is a recursive walk bar by bar, which shares nothing with the windows.
_SMA_BARS = f"{_EVENT_BARS}, ind AS (SELECT *, {_full('close', f'avg(close) OVER {_roll(5)}', 5)} AS fast, {_full('close', f'avg(close) OVER {_roll(20)}', 20)} AS slow FROM bars)"
CROSS = Strategy("sma-cross", "BOTH", ("ta.crossover(fast, slow)", "ta.crossunder(fast, slow)"), bindings={"fast": Binding("SMA", {"period": "fastLength"}), "slow": Binding("SMA", {"period": 20})}, parameters={"fastLength": 5})
BAND = Strategy("band-reversal", "BUY", ("close < bb.lower",), ("close > bb.middle",), {"bb": Binding("BB", {"period": 20, "stdDev": 2})})
SWING = Strategy("rsi-swing", "BOTH", ("rsi < 45", "rsi > 55"), ("ta.cross(close, base)",), {"rsi": Binding("RSI", {"period": 14}), "base": Binding("EMA", {"period": 20})})
TREND = Strategy("macd-trend", "BOTH", ("m.histogram > 0", "m.histogram < 0"), bindings={"m": Binding("MACD")})
BROKEN = Strategy("broken", "BUY", ("foo > 1 and math.floor(close) > 2",), bindings={"x": Binding("TSI"), "y": Binding("SMA", source="zz")})
QUOTED = Strategy("quoted", "BUY", ("state == \"long\"",))
STRATEGIES = (CROSS, BAND, SWING, TREND)

_CROSS_FLAGS = f"""{_SMA_BARS}, cr AS (SELECT *, row_number() OVER {_W} AS i, coalesce(fast > slow AND lag(fast) OVER {_W} <= lag(slow) OVER {_W}, false) AS l,
 coalesce(fast < slow AND lag(fast) OVER {_W} >= lag(slow) OVER {_W}, false) AS s, false AS x FROM ind)"""
_BAND_FLAGS = f"""{_EVENT_BARS}, ind AS (SELECT *, {_full('close', f'avg(close) OVER {_roll(20)}', 20)} AS mid, {_full('close', f'stddev_pop(close) OVER {_roll(20)}', 20)} AS dev FROM bars),
cr AS (SELECT *, row_number() OVER {_W} AS i, coalesce(close < mid - 2 * dev, false) AS l, false AS s, coalesce(close > mid, false) AS x FROM ind)"""


def _walk(flags: str, name: str = "") -> str:
    """CTEs pos{name}: the state machine bar by bar over cr."""
    step = """CASE WHEN w.p = 0 THEN CASE WHEN c.l THEN 1 WHEN c.s THEN -1 ELSE 0 END WHEN c.x THEN 0 WHEN w.p = 1 AND c.s THEN -1 WHEN w.p = -1 AND c.l THEN 1 ELSE w.p END"""
    return f"""{flags}, walk AS (SELECT source, symbol, timeframe, i, CASE WHEN l THEN 1 WHEN s THEN -1 ELSE 0 END AS p FROM cr WHERE i = 1
 UNION ALL SELECT c.source, c.symbol, c.timeframe, c.i, {step} FROM walk w JOIN cr c ON c.source = w.source AND c.symbol = w.symbol AND c.timeframe = w.timeframe AND c.i = w.i + 1),
pos AS (SELECT c.*, w.p AS position FROM cr c JOIN walk w USING (source, symbol, timeframe, i))"""


@query(f"""WITH {_SMA_BARS}, q AS (SELECT *, lag(close) OVER {_W} AS c1, lag(close, 2) OVER {_W} AS c2, lag(fast) OVER {_W} AS f1, lag(slow) OVER {_W} AS s1,
 lag(CASE WHEN close > 110 THEN 1 ELSE 0 END) OVER {_W} AS b1 FROM ind)
SELECT source, symbol, timeframe, timestamp, coalesce(close > c1, false) AS history, coalesce(b1 = 0, false) AS not_before,
 coalesce(fast > slow AND f1 <= s1, false) AS crossover, coalesce(coalesce(fast > slow, false) <> coalesce(f1 > s1, false), false) AND c1 IS NOT NULL AS "cross",
 coalesce(coalesce(c2, -1) > 0, false) AS nz, coalesce((high + low) / 2 > (open + close) / 2 AND NOT (close < 105), false) OR coalesce(close * 2 - 100 >= 130, false) AS mixed FROM q""")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule strings as columns."""
    df = indicators.sma(indicators.sma(_hourly(spark, sf_dir), 5, name="fast"), 20, name="slow")
    texts = {
        "history": "close > close[1]",
        "not_before": "not (close > 110)[1]",
        "crossover": "ta.crossover(fast, slow)",
        "cross": "ta.cross(fast, slow)",
        "nz": "nz(close[2], -1) > 0",
        "mixed": "hl2 > (open + close) / 2 and not (close < 105) or close * 2 - 100 >= 130",
    }
    for name, text in texts.items():
        df = rule_filter(df, text, name=name)
    return df.select(*KEYS, "timestamp", *texts)


@query(f"WITH RECURSIVE {_walk(_CROSS_FLAGS)} SELECT source, symbol, timeframe, timestamp, l AS long, s AS short, x AS exit, position FROM pos")
def position_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop and reverse."""
    return _hourly(spark, sf_dir).transform(strategies.evaluate_strategy(CROSS)).select(*KEYS, "timestamp", "long", "short", "exit", "position")


@query(f"WITH RECURSIVE {_walk(_BAND_FLAGS)} SELECT source, symbol, timeframe, timestamp, l AS long, s AS short, x AS exit, position FROM pos")
def position_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 with exits on one side."""
    return _hourly(spark, sf_dir).transform(strategies.evaluate_strategy(BAND)).select(*KEYS, "timestamp", "long", "short", "exit", "position")


_THREE_FLAGS = f"""{_SMA_BARS}, cr AS (SELECT *, row_number() OVER {_W} AS i, coalesce(fast > slow, false) AS l, coalesce(close < slow - 1, false) AS s, coalesce(close > fast + 3, false) OR coalesce(close < fast - 3, false) AS x FROM ind)"""


@query(f"WITH RECURSIVE {_walk(_THREE_FLAGS)} SELECT source, symbol, timeframe, timestamp, position FROM pos")
def position_with_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 with two sides and exits, over blocks of the series."""
    df = indicators.sma(indicators.sma(_hourly(spark, sf_dir), 5, name="fast"), 20, name="slow")
    return positions.evaluate(df, "BOTH", ["fast > slow", "close < slow - 1"], ["close > fast + 3", "close < fast - 3"], block_ms=WEEK_MS).select(*KEYS, "timestamp", "position")


_SIGNALS = f"""sig AS (SELECT *, coalesce(lag(position) OVER {_W}, 0) AS before FROM pos),
signals AS (SELECT source, symbol, timeframe, timestamp, CASE WHEN position > 0 THEN 'BUY' WHEN position < 0 THEN 'SELL' ELSE 'CLOSE' END AS type, close AS price,
 CASE WHEN position = 0 THEN 'exit' WHEN before = 0 THEN 'entry' ELSE 'reversal' END AS reason FROM sig WHERE position <> before)"""


@query(f"WITH RECURSIVE {_walk(_CROSS_FLAGS)}, {_SIGNALS} SELECT source, symbol, timeframe, timestamp, type, round(price, 6) AS price, reason FROM signals")
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return positions.signals(_hourly(spark, sf_dir).transform(strategies.evaluate_strategy(CROSS))).withColumn("price", F.round("price", 6))


@query(f"WITH RECURSIVE {_walk(_CROSS_FLAGS)}, {_SIGNALS} SELECT 'sma-cross' AS spec_id, type, count(*) AS n FROM signals GROUP BY ALL")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    rows = positions.signals(_hourly(spark, sf_dir).transform(strategies.evaluate_strategy(CROSS))).withColumn("spec_id", F.lit(CROSS.id))
    return positions.signal_counts(rows, ["spec_id"])


@query(f"""WITH {_EVENT_BARS}, sg AS (SELECT symbol, t - t % 3600000 AS timestamp, last(CASE WHEN o % 11 = 0 THEN 1 WHEN o % 13 = 0 THEN -1 ELSE 0 END ORDER BY o) AS want FROM ev WHERE o % 11 = 0 OR o % 13 = 0 OR o % 17 = 0 GROUP BY ALL)
SELECT b.source, b.symbol, b.timeframe, b.timestamp, coalesce(last_value(sg.want IGNORE NULLS) OVER (PARTITION BY b.source, b.symbol, b.timeframe ORDER BY b.timestamp), 0) AS position
FROM bars b LEFT JOIN sg ON sg.symbol = b.symbol AND sg.timestamp = b.timestamp""")
def signals_to_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals made of some events, the last of a bar counting."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 11 == 0, "BUY").when(F.col("event_id") % 13 == 0, "SELL").when(F.col("event_id") % 17 == 0, "CLOSE")
    ms = source.epoch_ms("ts")
    table = e.select(F.lit("events").alias("source"), F.col("event_type").alias("symbol"), F.lit("1h").alias("timeframe"), (ms - ms % 3_600_000).alias("timestamp"), kind.alias("type"), F.col("event_id").alias("seq"))
    return positions.signals_to_bars(_hourly(spark, sf_dir), table.filter("type IS NOT NULL")).select(*KEYS, "timestamp", "position")


_TRADES = f"""chg AS (SELECT *, coalesce(lag(position) OVER {_W}, 0) AS before, last_value(timestamp) OVER (PARTITION BY {_K} ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lt,
 last_value(close) OVER (PARTITION BY {_K} ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM pos),
ev2 AS (SELECT *, coalesce(lead(timestamp) OVER {_W}, lt) AS xt, coalesce(lead(close) OVER {_W}, lc) AS xc FROM chg WHERE position <> before),
trades AS (SELECT {_K}, timestamp AS entry_timestamp, close AS entry_price, xt AS exit_timestamp, xc AS exit_price, CASE WHEN position > 0 THEN 'LONG' ELSE 'SHORT' END AS type,
 (position * (xc / close - 1) - 0.001) * 100 AS pnl_percent, position * (xc - close) AS pnl FROM ev2 WHERE position <> 0)"""
_CURVE = f"""ret AS (SELECT *, lag(position) OVER {_W} * (close / lag(close) OVER {_W} - 1) - abs(lag(position) OVER {_W} - coalesce(lag(position, 2) OVER {_W}, 0)) * 0.0005 AS ret FROM pos),
eq AS (SELECT *, product(1 + coalesce(ret, 0)) OVER {_W} AS equity FROM ret),
dd AS (SELECT *, (greatest(1, max(equity) OVER {_W}) - equity) / greatest(1, max(equity) OVER {_W}) AS drawdown FROM eq)"""


@query(f"""WITH RECURSIVE {_walk(_CROSS_FLAGS)}, {_TRADES} SELECT source, symbol, timeframe, entry_timestamp, exit_timestamp, type, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price,
 round(pnl_percent, 6) AS pnl_percent, round(pnl, 6) AS pnl FROM trades""")
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    rows = positions.trades(_hourly(spark, sf_dir).transform(strategies.evaluate_strategy(CROSS)))
    return rows.select(*KEYS, "entry_timestamp", "exit_timestamp", "type", *[_r(c) for c in ("entry_price", "exit_price", "pnl_percent", "pnl")])


@query(f"WITH RECURSIVE {_walk(_CROSS_FLAGS)}, {_CURVE} SELECT source, symbol, timeframe, timestamp, round(ret, 6) AS ret, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM dd")
def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, W8, W9, over blocks of the series."""
    curve = positions.curve(_hourly(spark, sf_dir).transform(strategies.evaluate_strategy(CROSS)), block_ms=WEEK_MS)
    return curve.select(*KEYS, "timestamp", _r("ret"), _r("equity"), _r("drawdown"))


def _metrics_sql(spec_id: str) -> str:
    return f"""SELECT m.source, m.symbol, m.timeframe, '{spec_id}' AS spec_id, coalesce(total_trades, 0) AS total_trades, round(coalesce(win_rate, 0), 6) AS win_rate, round(coalesce(avg_pnl, 0), 6) AS avg_pnl,
 round(total_return, 6) AS total_return, round(max_drawdown, 6) AS max_drawdown, round(CASE WHEN dev > 0 THEN mean / dev * sqrt(bars_per_year) ELSE 0 END, 6) AS sharpe, round(buy_hold, 6) AS buy_hold
FROM (SELECT {_K}, avg(ret) AS mean, stddev_pop(ret) AS dev, (last(equity ORDER BY timestamp) - 1) * 100 AS total_return, max(drawdown) * 100 AS max_drawdown,
 (last(close ORDER BY timestamp) / first(close ORDER BY timestamp) - 1) * 100 AS buy_hold FROM dd GROUP BY ALL) m JOIN per_year USING ({_K})
LEFT JOIN (SELECT {_K}, count(*) AS total_trades, avg(CASE WHEN pnl_percent > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl_percent) AS avg_pnl FROM trades GROUP BY ALL) t USING ({_K})"""


def _backtest_sql(flags: str, spec_id: str, table: str = "bars") -> str:
    return f"(WITH RECURSIVE {_walk(flags)}, {_TRADES}, {_CURVE}, {_PER_YEAR.format(t=table, k=_K)} {_metrics_sql(spec_id)})"


_METRICS = ("win_rate", "avg_pnl", "total_return", "max_drawdown", "sharpe", "buy_hold")


@query(_backtest_sql(_CROSS_FLAGS, "sma-cross"))
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, A3."""
    out = positions.backtest(_hourly(spark, sf_dir).transform(strategies.evaluate_strategy(CROSS))).withColumn("spec_id", F.lit(CROSS.id))
    return out.select(*KEYS, "spec_id", "total_trades", *[_r(c) for c in _METRICS])


_RANKED = f"(SELECT * FROM {_backtest_sql(_CROSS_FLAGS, 'sma-cross')} UNION ALL SELECT * FROM {_backtest_sql(_BAND_FLAGS, 'band-reversal')})"


@query(f"SELECT *, row_number() OVER (PARTITION BY source, symbol, timeframe ORDER BY total_return DESC, spec_id) AS rank, round(total_return - buy_hold, 6) AS vs_hold FROM {_RANKED}")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies over hourly candles, ranked in each series."""
    ranked = strategies.ranking(_hourly(spark, sf_dir), [CROSS, BAND])
    rounded = ranked.select(*KEYS, "spec_id", "total_trades", "rank", *[_r(c) for c in _METRICS])
    return strategies.leaderboard(rounded.withColumn("vs_hold", F.round(F.col("total_return") - F.col("buy_hold"), 6)))


_DAY_FLAGS = {
    "two-sided": "coalesce(fast > slow AND lag(fast) OVER {w} <= lag(slow) OVER {w}, false) AS l, coalesce(fast < slow AND lag(fast) OVER {w} >= lag(slow) OVER {w}, false) AS s, false AS x",
}


@query(f"""WITH {_ORDER_BARS}, sp AS (SELECT {_K}, (max(timestamp) - min(timestamp)) / 31557600000.0 AS f, max(timestamp) AS m FROM days GROUP BY ALL),
y AS (SELECT DISTINCT {_K}, f, m, unnest([3, 5, floor(f + 0.5)::INT]) AS years FROM sp)
SELECT {_K}, years, count(*) AS bars, round((last(close ORDER BY timestamp) / first(close ORDER BY timestamp) - 1) * 100, 6) AS buy_hold
FROM days JOIN y USING ({_K}) WHERE years > 0 AND years <= f + 0.1 AND timestamp >= m - years * 31557600000.0 GROUP BY ALL""")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series in each of its windows."""
    days = _daily(spark, sf_dir)
    keys = [*KEYS, "years"]
    cut = series.window_slices(days, series.window_list(days))
    return cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars")).join(series.buy_hold(cut, keys), keys).withColumn("buy_hold", F.round("buy_hold", 6))


#: Records as they are read from files: three that can run and two that cannot. The third has its indicator under `indicators`, not as a binding.
_RECORDS = [
    {"id": "sma-cross", "strategyType": "condition", "entry": {"direction": "BOTH", "conditions": list(CROSS.conditions)}, "bindings": {"fast": {"type": "SMA", "params": {"period": "fastLength"}}, "slow": {"type": "SMA", "params": {"period": "20"}}}, "parameters": {"fastLength": "5"}},
    {"id": "band-reversal", "strategyType": "condition", "entry": {"direction": "BUY", "conditions": ["close < bb.lower"]}, "exit": {"conditions": ["close > bb.middle"]}, "bindings": {"bb": {"type": "BB", "params": {"period": "20", "stdDev": "2"}}}},
    {"id": "a-strategy-with-a-long-name", "strategyType": "condition", "entry": {"direction": "SELL", "conditions": ["close < sma10"]}, "exit": {"conditions": ["close > sma10"]}, "indicators": [{"type": "SMA", "params": {"period": "10"}, "outputKey": "sma10"}]},
    {"id": "unknown-type", "strategyType": "condition", "entry": {"direction": "BUY", "conditions": ["tsi > 1"]}, "indicators": [{"type": "TSI", "outputKey": "tsi"}]},
    {"id": "quoted", "strategyType": "condition", "entry": {"direction": "BUY", "conditions": ['state == "long"']}},
]


def _records(spark: SparkSession) -> DataFrame:
    """The records read with their defaults."""
    rows = spark.createDataFrame([(json.dumps(r),) for r in _RECORDS], "text string")
    return spec_source.with_defaults(rows.select(F.inline(F.array(spec_source.parse_spec(F.col("text"))))))


_ALL_BARS = f"""{_EVENT_BARS}, {_ORDER_BARS}, span AS (SELECT {_K}, (max(timestamp) - min(timestamp)) / 31557600000.0 AS f, max(timestamp) AS m FROM days GROUP BY ALL),
yrs AS (SELECT DISTINCT {_K}, f, m, unnest([3, 5, floor(f + 0.5)::INT]) AS years FROM span),
allbars AS (SELECT source, symbol || '/0' AS symbol, timeframe, timestamp, close FROM bars UNION ALL
 SELECT source, symbol || '/' || years, timeframe, timestamp, close FROM days JOIN yrs USING ({_K}) WHERE years > 0 AND years <= f + 0.1 AND timestamp >= m - years * 31557600000.0)"""


def _rank_flags(columns: str, up: str, down: str, leave: str) -> str:
    return f"{_ALL_BARS}, ind AS (SELECT *, {columns} FROM allbars), cr AS (SELECT *, row_number() OVER {_W} AS i, coalesce({up}, false) AS l, coalesce({down}, false) AS s, coalesce({leave}, false) AS x FROM ind)"


def _mean(n: int) -> str:
    return _full("close", f"avg(close) OVER {_roll(n)}", n)


_RANK_FLAGS = {
    "sma-cross": _rank_flags(f"{_mean(5)} AS fast, {_mean(20)} AS slow", f"fast > slow AND lag(fast) OVER {_W} <= lag(slow) OVER {_W}", f"fast < slow AND lag(fast) OVER {_W} >= lag(slow) OVER {_W}", "false"),
    "band-reversal": _rank_flags(f"{_mean(20)} AS mid, {_full('close', f'stddev_pop(close) OVER {_roll(20)}', 20)} AS dev", "close < mid - 2 * dev", "false", "close > mid"),
    "a-strategy-with-a-long-name": _rank_flags(f"{_mean(10)} AS m", "false", "close < m", "close > m"),
}
_RANK_ROWS = " UNION ALL ".join(f"SELECT * FROM {_backtest_sql(flags, k, 'allbars')}" for k, flags in _RANK_FLAGS.items())
_SIGNED = "CASE WHEN {0} >= 0 THEN '+' ELSE '−' END || printf('%.0f', abs({0})) || '%'"

_CELLS = f"""CASE WHEN len(spec_id) > 26 THEN spec_id[1:25] || '…' ELSE spec_id END AS name, CASE WHEN total_trades > 0 THEN {_SIGNED.format('total_return')} ELSE '—' END AS ret,
 CASE WHEN total_trades > 0 THEN {_SIGNED.format('vs')} ELSE '—' END AS vs_hold, CASE WHEN total_trades > 0 THEN replace(printf('%.2f', sharpe), '-', '−') ELSE '—' END AS sharpe, CASE WHEN total_trades > 0 THEN floor(max_drawdown + 0.5)::BIGINT || '%' ELSE '—' END AS max_dd,
 CASE WHEN total_trades > 0 THEN floor(win_rate * 100 + 0.5)::BIGINT || '%' ELSE '—' END AS win_rate, total_trades AS trades"""


@query(f"""WITH r AS (SELECT *, split_part(symbol, '/', 2)::INT AS years, total_return - buy_hold AS vs FROM ({_RANK_ROWS})),
k AS (SELECT *, row_number() OVER (PARTITION BY source, symbol, timeframe ORDER BY total_return DESC, spec_id) AS rank FROM r WHERE NOT (spec_id = 'band-reversal' AND years = 3 AND symbol LIKE '1-%'))
SELECT source, split_part(symbol, '/', 1) AS symbol, timeframe, years, rank, {_CELLS} FROM k""")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that can run, over the hourly market and those windows of the daily one that a grid has, in one table of cells."""
    days, hours, records = _daily(spark, sf_dir), _hourly(spark, sf_dir), _records(spark)
    windows = series.window_list(days)
    grid = strategies.job_grid(records, days.select(*KEYS).distinct(), windows).filter("NOT (spec_id = 'band-reversal' AND years = 3 AND symbol LIKE '1-%')")
    whole = strategies.ranking(hours, records).withColumn("years", F.lit(0))
    cut = strategies.ranking(days, records, windows, grid=grid)
    return strategies.trade_rows(strategies.union_markets(whole, cut))


@query(f"""WITH r AS (SELECT *, total_return - buy_hold AS vs FROM ({_RANK_ROWS}) WHERE symbol LIKE '%/0'), k AS (SELECT *, row_number() OVER (PARTITION BY source, symbol, timeframe ORDER BY total_return DESC, spec_id) AS rank FROM r)
SELECT source, split_part(symbol, '/', 1) AS symbol, timeframe, rank, {_CELLS}, total_trades AS listed FROM k""")
def ranking_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking as a job: record files are read, result records and the table written, both read again."""
    folder = _new_folder(spark, "ranking")
    spark.createDataFrame([(r["id"], json.dumps(r)) for r in _RECORDS], "id string, text string").write.partitionBy("id").text(f"{folder}/specs")  # a file a record
    rank_files(spark, _hourly(spark, sf_dir), f"{folder}/specs/*", folder)
    results = spec_source.read_results(spark, f"{folder}/results").select(*KEYS, "rank", F.size("trades").cast("long").alias("listed"))
    return spark.read.parquet(f"{folder}/table").join(results.na.fill(0), [*KEYS, "rank"])


@query()
def ranking_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with recursive indicators and with both sides and exits, as a report."""
    return strategies.report_rows(strategies.ranking(_daily(spark, sf_dir), STRATEGIES, series.window_list(_daily(spark, sf_dir))))


@query(f"""WITH g AS (SELECT o_orderpriority AS symbol, p_partkey % 3 AS years FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT DISTINCT p_partkey % 3 AS p_partkey FROM part)),
m AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders) SELECT 'orders' AS source, m.symbol, '1d' AS timeframe, g.years + 1 AS years, s.spec_id FROM m JOIN g USING (symbol) CROSS JOIN (SELECT unnest(['sma-cross', 'band-reversal']) AS spec_id) s""")
def job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 on its own: two strategies, the daily markets and three windows."""
    markets = _daily(spark, sf_dir).select(*KEYS).distinct()
    years = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 3 + 1).alias("years")).distinct()
    windows = markets.join(F.broadcast(years))
    return strategies.job_grid(spark.createDataFrame([(CROSS.id,), (BAND.id,)], "id string"), markets, windows)


_RANGE = """CASE WHEN n LIKE '%len%' OR n LIKE '%period%' OR n LIKE '%lookback%' OR n LIKE '%bars' THEN {length}
 WHEN n LIKE '%level%' OR n LIKE '%thresh%' OR n LIKE '%band%' THEN {level} WHEN n LIKE '%mult%' OR n LIKE '%factor%' OR n LIKE '%ratio%' OR n LIKE '%pct%' OR n LIKE '%percent%' OR n LIKE '%dev%' THEN {mult}
 WHEN v <> 0 THEN {other} END"""
_PARAMETERS = "p AS (SELECT p_partkey AS spec_id, lower(list_element(['emaLength', 'levelHigh', 'devMult', 'speed', 'x'], (p_partkey % 5 + 1)::INT)) AS n, (CASE WHEN p_partkey % 4 = 0 THEN p_size - 10 WHEN p_partkey % 4 = 1 THEN 0 ELSE p_size + 0.5 END)::DOUBLE AS v FROM part)"


@query(f"""WITH {_PARAMETERS} SELECT spec_id, n AS name,
 round(({_RANGE.format(length="greatest(2, floor(v * 0.4 + 0.5))", level="v * 0.5", mult="greatest(0.1, v * 0.3)", other="v * 0.5")})::DOUBLE, 6) AS lo,
 round(({_RANGE.format(length="greatest(6, floor(v * 2.5 + 0.5))", level="CASE WHEN v = 0 THEN 1 ELSE v * 1.5 END", mult="CASE WHEN v = 0 THEN 3 ELSE v * 3 END", other="v * 1.5")})::DOUBLE, 6) AS hi,
 {_RANGE.format(length="true", level="false", mult="false", other="v = floor(v)")} AS whole FROM p""")
def param_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the range of a parameter for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.element_at(F.array(*[F.lit(x) for x in ("emaLength", "levelHigh", "devMult", "speed", "x")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") - 10).when(F.col("p_partkey") % 4 == 1, 0).otherwise(F.col("p_size") + 0.5).cast("double")
    rows = part.select(F.col("p_partkey").alias("spec_id"), F.lower(name).alias("name"), scalars.param_range(name, value).alias("r"))
    return rows.select("spec_id", "name", _r("r.lo", "lo"), _r("r.hi", "hi"), F.col("r.int").alias("whole"))


@query(f"""WITH {_PARAMETERS}, r AS (SELECT spec_id, n, ({_RANGE.format(length="greatest(2, floor(v * 0.4 + 0.5))", level="v * 0.5", mult="greatest(0.1, v * 0.3)", other="v * 0.5")})::DOUBLE AS lo,
 ({_RANGE.format(length="greatest(6, floor(v * 2.5 + 0.5))", level="CASE WHEN v = 0 THEN 1 ELSE v * 1.5 END", mult="CASE WHEN v = 0 THEN 3 ELSE v * 3 END", other="v * 1.5")})::DOUBLE AS hi,
 {_RANGE.format(length="true", level="false", mult="false", other="v = floor(v)")} AS whole FROM p), t AS (SELECT *, unnest([0, 1]) AS trial FROM r WHERE lo IS NOT NULL),
x AS (SELECT *, lo + (('0x' || substr(md5('3/' || spec_id || '/' || trial || '/' || n), 1, 13))::BIGINT / 4503599627370496e0) * (hi - lo) AS x FROM t)
SELECT spec_id, trial, n AS name, round(CASE WHEN whole THEN floor(x + 0.5e0) ELSE floor(x * 10000e0 + 0.5e0) / 10000e0 END, 6) AS value FROM x""")
def sampled_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two draws of each part's parameter."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.element_at(F.array(*[F.lit(x) for x in ("emaLength", "levelHigh", "devMult", "speed", "x")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") - 10).when(F.col("p_partkey") % 4 == 1, 0).otherwise(F.col("p_size") + 0.5).cast("double")
    rows = part.select(F.col("p_partkey").alias("spec_id"), F.lower(name).alias("name"), scalars.param_range(name, value).alias("r"))
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("trial"))
    return rows.filter("r.lo IS NOT NULL").select("spec_id", "trial", "name", _r(scalars.sample_param(F.col("r"), 3, F.col("spec_id"), F.col("trial"), F.col("name")), "value"))


SWEPT = (
    Strategy("sma-cross", "BOTH", CROSS.conditions, (), {"fast": Binding("SMA", {"period": "fastLength"}), "slow": Binding("SMA", {"period": "slowLength"})}, {"fastLength": 5.0, "slowLength": 20.0}),
    Strategy("band-reversal", "BUY", BAND.conditions, BAND.exits, {"bb": Binding("BB", {"period": "bandPeriod", "stdDev": "devMult"})}, {"bandPeriod": 20.0, "devMult": 2.0}),
)
TRIALS = 40


def _swept(spark: SparkSession, sf_dir: str, trials: int = TRIALS) -> DataFrame:
    """Every trial of two strategies on both slices of every hourly series.

    Closes get a term of a millionth that no mean cancels: with prices of few decimals, means of different lengths are often equal, and then the order of adding decides a crossing.
    """
    split = series.train_test_split(_hourly(spark, sf_dir).withColumn("close", F.col("close") + F.sin(F.col("timestamp") / 1e6) / 1e6))
    specs = spark.createDataFrame([(s.id, s.parameters) for s in SWEPT], "spec_id string, parameters map<string,double>")
    return sweep.train_and_test(sweep.score_trials(split, SWEPT, sweep.trial_grid(spark, specs, trials, seed=7)))


def _draw(spec_id: str, name: str, lo: float, hi: float, whole: bool, default: float) -> str:
    x = f"{lo}e0 + (('0x' || substr(md5('7/{spec_id}/' || trial || '/{name}'), 1, 13))::BIGINT / 4503599627370496e0) * ({hi}e0 - {lo}e0)"
    return f"CASE WHEN trial < 0 THEN {default}e0 ELSE " + (f"floor({x} + 0.5e0)" if whole else f"floor(({x}) * 10000e0 + 0.5e0) / 10000e0") + " END"


def _trials_sql(spec_id: str, draws: tuple[str, str], columns: str, up: str, down: str, leave: str) -> str:
    """Metrics of all trials; the symbol carries slice and trial."""
    return f"""(WITH RECURSIVE {_EVENT_BARS}, tr AS (SELECT trial, ({draws[0]}) AS a, ({draws[1]}) AS b FROM (SELECT unnest(range(-1, {TRIALS})) AS trial)),
t AS (SELECT {_K}, timestamp, close + sin(timestamp / 1e6) / 1e6 AS close, row_number() OVER {_W} AS j, count(*) OVER (PARTITION BY {_K}) AS n FROM bars),
sp AS (SELECT source, symbol || '/' || CASE WHEN j <= n * 2 // 3 THEN 'train' ELSE 'test' END || '/' || trial AS symbol, timeframe, timestamp, close, a, b FROM t CROSS JOIN tr WHERE n * 2 // 3 > 0 AND n * 2 // 3 < n),
ind AS (SELECT *, {columns} FROM sp), cr AS (SELECT *, row_number() OVER {_W} AS i, coalesce({up}, false) AS l, coalesce({down}, false) AS s, coalesce({leave}, false) AS x FROM ind),
{_walk('', '').lstrip(', ')}, {_TRADES}, {_CURVE}, {_PER_YEAR.format(t='cr', k=_K)} {_metrics_sql(spec_id)})"""


def _rolled(f: str, n: str) -> str:
    frame = f"(PARTITION BY {_K} ORDER BY timestamp ROWS BETWEEN ({n}::BIGINT - 1) PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) OVER {frame} = {n} THEN {f}(close) OVER {frame} END"


_TRIAL_ROWS = " UNION ALL ".join(
    f"SELECT * FROM {x}"
    for x in (
        _trials_sql("sma-cross", (_draw("sma-cross", "fastLength", 2, 13, True, 5), _draw("sma-cross", "slowLength", 8, 50, True, 20)), f"{_rolled('avg', 'a')} AS fast, {_rolled('avg', 'b')} AS slow",
                    f"fast > slow AND lag(fast) OVER {_W} <= lag(slow) OVER {_W}", f"fast < slow AND lag(fast) OVER {_W} >= lag(slow) OVER {_W}", "false"),
        _trials_sql("band-reversal", (_draw("band-reversal", "bandPeriod", 8, 50, True, 20), _draw("band-reversal", "devMult", 0.6, 6, False, 2)), f"{_rolled('avg', 'a')} AS mid, {_rolled('stddev_pop', 'a')} AS dev", "close < mid - b * dev", "false", "close > mid"),
    )
)
_WIDE = ", ".join(f"max({c}) FILTER (split_part(symbol, '/', 2) = '{s}') AS {s}_{n}" for s in ("train", "test") for c, n in (("total_trades", "trades"), ("total_return", "total_return"), ("max_drawdown", "max_drawdown"), ("sharpe", "sharpe")))
_TRIALS = f"tw AS (SELECT source, split_part(symbol, '/', 1) AS symbol, timeframe, spec_id, split_part(symbol, '/', 3)::INT AS trial, {_WIDE} FROM ({_TRIAL_ROWS}) GROUP BY ALL)"


@query(f"WITH {_TRIALS} SELECT * FROM tw WHERE train_trades >= 5")
def sweep_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of two strategies on both slices of every hourly series; trials with enough trades."""
    trials = strategies.valid_trials(_swept(spark, sf_dir), 5)
    return trials.select(*KEYS, "spec_id", "trial", "train_trades", "test_trades", *[_r(f"{s}_{m}") for s in ("train", "test") for m in ("total_return", "max_drawdown", "sharpe")])


@query(f"""WITH {_TRIALS}, v AS (SELECT *, trial >= 0 AND train_trades >= 5 AS valid FROM tw), o AS (SELECT *, row_number() OVER (PARTITION BY source, symbol, timeframe, spec_id, valid ORDER BY train_sharpe DESC, trial) AS k FROM v),
g AS (SELECT source, symbol, timeframe, spec_id, count(*) FILTER (trial >= 0) AS trials, count(*) FILTER (valid) AS valid_n, count(*) FILTER (valid AND train_sharpe > 1) AS train_good_n, count(*) FILTER (valid AND train_sharpe > 1 AND test_sharpe > 1) AS held_up_n,
 max(test_sharpe) FILTER (valid) AS oracle_test_sharpe, max(train_sharpe) FILTER (trial < 0) AS default_train_sharpe, max(test_sharpe) FILTER (trial < 0) AS default_test_sharpe,
 max(trial) FILTER (valid AND k = 1) AS best_trial, max(train_sharpe) FILTER (valid AND k = 1) AS best_train_sharpe, max(test_sharpe) FILTER (valid AND k = 1) AS best_test_sharpe, max(test_total_return) FILTER (valid AND k = 1) AS best_test_return,
 max(test_trades) FILTER (valid AND k = 1) AS best_test_trades FROM o GROUP BY ALL)
SELECT *, CASE WHEN best_trial IS NULL THEN 'no-signal' WHEN best_train_sharpe < 1 THEN 'weak' WHEN best_test_sharpe >= 1 AND best_test_return > 0 THEN CASE WHEN best_test_trades >= 3 THEN 'holds' ELSE 'thin' END WHEN best_test_sharpe >= 0.5 THEN 'marginal' ELSE 'overfit' END AS verdict FROM g""")
def sweep_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, F8, T2."""
    board = sweep.sweep_board(sweep.sweep_summary(_swept(spark, sf_dir)))
    return board.withColumns({c: F.round(c, 6) for c in board.columns if c.endswith(("sharpe", "return"))})


@query("""WITH t AS (SELECT l_orderkey, l_linenumber % 2 AS slice, avg(l_discount) * 40 AS sharpe, max(l_tax) * 300 AS dd, sum(l_quantity) AS trades FROM lineitem GROUP BY ALL)
SELECT l_orderkey AS spec_id FROM t WHERE sharpe > 1 AND dd < 20 AND trades >= 50 GROUP BY ALL HAVING count(*) = 2""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10, on metrics made of order lines, odd ones as the train slice and even ones as the test slice."""
    m = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("spec_id"), (F.col("l_linenumber") % 2).alias("slice"))
    # a sum of decimals doesn't depend on the order of the rows, which a sum of doubles at the threshold does; doubles that are no such decimals keep theirs
    discount, exact = F.col("l_discount"), F.col("l_discount").try_cast("decimal(25,15)")
    sharpe = F.when(F.count(exact) == F.count(discount), (F.sum(exact) * 40).cast("double") / F.nullif(F.count(discount), F.lit(0))).otherwise(F.avg(discount) * 40)
    m = m.agg(sharpe.alias("sharpe"), (F.max("l_tax") * 300).alias("max_drawdown"), F.sum("l_quantity").alias("total_trades"))
    return strategies.promotion_gate(m.filter("slice = 1"), m.filter("slice = 0"), ["spec_id"])


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size / 20.0 END AS tr, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size / 25.0 - 0.3 END AS te, p_size - 10 AS ret, p_size % 9 AS n FROM part)
SELECT p_partkey, CASE WHEN tr IS NULL THEN 'no-signal' WHEN tr < 1 THEN 'weak' WHEN te >= 1 AND ret > 0 THEN CASE WHEN n >= 3 THEN 'holds' ELSE 'thin' END WHEN te >= 0.5 THEN 'marginal' ELSE 'overfit' END AS verdict FROM m""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 on figures made of part sizes."""
    part, k, size = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey"), F.col("p_size")
    best = F.struct(F.when(k % 7 != 0, size / 20).alias("train_sharpe"), F.when(k % 5 != 0, size / 25 - 0.3).alias("test_sharpe"), (size - 10).cast("double").alias("test_return"), (size % 9).alias("test_trades"))
    return part.select("p_partkey", scalars.verdict(best).alias("verdict"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower('  ' || p_name || '--' || p_brand || '! '), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', '')[1:50] AS slug,
 sha256(p_name || p_brand)[1:16] AS hash,
 regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', '')[1:50] || '-' || sha256(p_name || p_brand)[1:6] AS id FROM part""")
def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2."""
    part, text = spark.read.parquet(f"{sf_dir}/part.parquet"), F.concat("p_name", "p_brand")
    long_name = F.concat(F.lit("  "), "p_name", F.lit("--"), "p_brand", F.lit("! "))
    return part.select("p_partkey", scalars.slugify(long_name).alias("slug"), scalars.raw_hash(text).alias("hash"), scalars.spec_id(F.col("p_name"), scalars.raw_hash(text)).alias("id"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0 THEN '+' ELSE '−' END || printf('%.1f', abs(x)) || '%' AS pct, CASE WHEN x >= 0 THEN '+' ELSE '−' END || printf('%.0f', abs(x)) || '%' AS ipct,
 strftime(l_shipdate, '%Y-%m-%d') AS day, list_element([60000, 300000, 900000, 3600000, 14400000, 86400000, NULL], (l_linenumber % 7 + 1)::INT)::BIGINT AS ms
FROM (SELECT *, l_quantity * 1.37 - 30.1103 AS x FROM lineitem)""")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4, F5, F9."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.col("l_quantity") * 1.37 - 30.1103
    tf = F.element_at(F.array(*[F.lit(t) for t in ("1m", "5m", "15m", "1h", "4h", "1d", "2w")]), (F.col("l_linenumber") % 7 + 1).cast("int"))
    return li.select("l_orderkey", "l_linenumber", scalars.pct(x).alias("pct"), scalars.ipct(x).alias("ipct"), scalars.day(source.epoch_ms("l_shipdate")).alias("day"), scalars.timeframe_ms(tf).cast("long").alias("ms"))


@query("SELECT doc_id, length(replace(replace(text || chr(13) || chr(10) || 'x' || chr(13), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS n, sha256(text)[1:16] AS raw_hash FROM documents")
def newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, F3 over whole documents."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = scalars.normalise_newlines(F.concat("text", F.lit("\r\nx\r")))
    return d.select("doc_id", F.length(text).cast("long").alias("n"), scalars.raw_hash(F.col("text")).alias("raw_hash"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://x.org/script/' || regexp_replace(href, '[^A-Za-z0-9]', '', 'g') || '/?a=1#b' WHEN page_id % 3 = 1 THEN 'https://x.org/scripts/' || regexp_replace(href, '[^A-Za-z0-9]', '', 'g') ELSE href END AS u FROM h)
SELECT DISTINCT page_id, regexp_replace(regexp_replace(u, '[?#].*$', ''), '/$', '') AS url FROM l WHERE regexp_matches(u, '/script/[A-Za-z0-9]+') AND NOT contains(u, '/scripts/')""")
def clean_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages; two thirds of the pages get script links made of their own."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = pages.select("page_id", F.explode(corpus.all_matches(F.col("html"), r'href="([^"]+)"', 1)).alias("href"))
    bare = F.regexp_replace("href", "[^A-Za-z0-9]", "")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x.org/script/"), bare, F.lit("/?a=1#b"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://x.org/scripts/"), bare)).otherwise(F.col("href"))
    made = links.groupBy("page_id").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit('<a href="'), url, F.lit('">')))).alias("html"))
    return corpus.page_links(made)


@query("""WITH d AS (SELECT doc_id, text, sha256(text)[1:16] AS raw_hash FROM documents) SELECT raw_hash, max(doc_id) AS doc_id FROM d GROUP BY raw_hash""")
def store_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each content, the last seen."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("url"), F.col("text").alias("source_text"), F.col("doc_id").alias("seq"))
    return corpus.store_raw(d).select("raw_hash", F.col("seq").alias("doc_id"))


def _cases(of: str, values: dict[int, str], other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


_NL = "chr(10)"
_TAGS = _cases("k % 6", {0: "' [4h]'", 1: "' (15m)'", 2: "' daily'"}, "''")
_ARGS = _cases("k % 6", {4: "', timeframe=\"60\"'", 5: "', timeframe=\"D\"'"}, "''")
_HEADS = f"""CASE WHEN k % 10 = 9 THEN '// no title' ELSE 'indicator("' || p_name || {_TAGS} || '"' || {_ARGS} || ')' END"""
_ODD = _cases("k % 4", {0: "'q = ta.kama(close, 10)'", 1: "'q = ta.Vidya(close)'"}, "'q = ta.change(close)'")
_ALERT = "'alertcondition({0}, \"x\")'"
#: Ways to say an entry: two sides, an entry call, a marker, an assignment over lines, nothing, more conditions than are kept (two sides, one side, entry calls), a bare name, a constant.
_ENTRIES = {
    0: f"""'alertcondition(ta.crossover(fast, slow), "Long, now", "x")' || {_NL} || 'alertcondition(ta.crossunder(fast, slow), "Short")'""",
    1: "'strategy.entry(\"L\", strategy.long, when = r > 50)'",
    2: f"""'sig = fast > slow' || {_NL} || 'plotshape(showTable and sig, "Buy", style=shape.triangleup, location=location.belowbar)'""",
    3: f"""'bullSignal = r < 30 and' || {_NL} || '  close > slow' || {_NL} || 'alertcondition(bullSignal, "up")'""",
    4: "'plot(fast)'",
    5: f" || {_NL} || ".join(_ALERT.format(x) for x in ("longA > 1", "longB > 1", "longC > 1", "shortA > 1", "shortB > 1", "shortC > 1")),
    6: f" || {_NL} || ".join(_ALERT.format(x) for x in ("buyA > 1", "buyB > 1", "buyC > 1", "buyD > 1")),
    7: f" || {_NL} || ".join(f"'strategy.entry(\"E{i}\", strategy.short, when = ta.cross(r, {i}))'" for i in range(4)),
    8: f"'goLong = buffer' || {_NL} || 'alertcondition(goLong, \"x\")'",
    9: "'alertcondition(true, \"x\")'",
}
_KINDS = {0: f"'a = request.security(x, \"D\", close)' || {_NL} || 'b = request.security(x, \"W\", close)'", 1: "'in_asia = hour > 1'", 2: "'score += 1'", 3: "'p = ta.pivothigh(high, 5)'"}
_MANY = ["ta.ema(close, 9)", "ta.wma(close, 8)", "ta.hma(close, 7)", "ta.rma(close, 6)", "ta.roc(close, 5)", "ta.mom(close, 4)", "ta.cci(close, 3)", "ta.mfi(hlc3, 12)", "ta.stdev(close, 11)", "ta.highest(high, 13)", "ta.lowest(low, 15)", "ta.pivotlow(low, 2)",
         "ta.atr(16)", "ta.adx(17)", "ta.macd(close, 1, 2, 3)", "ta.bb(close, 20, 2)", "ta.stoch(close, high, low, 14)", "ta.vwap(close)", "ta.tsi(close, 25, 13)", "ta.linreg(close, 10, 1)", "ta.dmi(18, 19)"]
#: The text of the script of each part, an expression for both Spark and SQL, so that both hash the same text.
_SCRIPT = f"""'//@version=5' || {_NL} || {_HEADS} || {_NL} || 'len = input.int(' || CAST(p_size AS STRING) || ', "Length")' || {_NL} || CASE WHEN k % 17 = 3 THEN '' ELSE 'factorMult = input.float(1.5)' || {_NL} END || 'showTable = input.bool(true)' || {_NL}
 || 'fast = ta.ema(close, len)' || {_NL} || 'slow = ta.sma(close, 50)' || {_NL} || 'r = ta.rsi(close, ' || CAST(p_size AS STRING) || ')' || {_NL} || {_ODD} || {_NL} || {_cases("k % 7", _KINDS, "''")} || {_NL}
 || CASE WHEN k % 13 = 5 THEN '{" ".join(_MANY)}' || {_NL} ELSE '' END || {_cases("k % 11", {0: f"repeat('x = 1' || {_NL}, 101)", 1: f"repeat('x = 1' || {_NL}, 201)"}, "''")} || {_cases("k % 10", _ENTRIES, "''")}"""
_TEXT = f"CASE WHEN k % 2 = 0 THEN replace({_SCRIPT}, chr(10), chr(13) || chr(10)) ELSE {_SCRIPT} END"


def _spread_part(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of `part`, dealt over tasks, for queries that make a text or a record of each row."""
    return corpus.spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(*columns), "p_partkey")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, source_text, seq: a script for each part."""
    part = _spread_part(spark, sf_dir, "p_partkey", "p_name", "p_size").withColumn("k", F.col("p_partkey"))
    # a filter on the text would else go below the dealing, with the whole expression, into the few tasks that read the file
    return corpus.once(part, source_text=F.expr(_TEXT)).select(F.concat(F.lit("part/"), F.col("k").cast("string")).alias("url"), "source_text", F.col("k").alias("seq"))


_NAME = "CASE WHEN k % 10 = 9 THEN 'Unknown Strategy' ELSE trim(p_name || CASE k % 6 WHEN 0 THEN ' [4h]' WHEN 1 THEN ' (15m)' WHEN 2 THEN ' daily' ELSE '' END) END"
_PART = "q AS (SELECT *, p_partkey AS k, 'part/' || p_partkey AS url FROM part)"
_TRADED = "k % 10 <> 4"
_TYPE = "CASE k % 7 WHEN 0 THEN 'mtf_scored' WHEN 1 THEN 'session' WHEN 2 THEN 'scored' ELSE CASE WHEN k % 7 = 3 OR k % 13 = 5 THEN 'pattern' ELSE 'condition' END END"
_GRADE = "CASE WHEN k % 7 = 0 OR k % 11 = 1 THEN 'complex' WHEN k % 13 = 5 OR k % 11 = 0 THEN 'medium' ELSE 'simple' END"
_MANY_KEYS = "adx17,atr16,bb,cci3,dmi,ema9,highest_high13,hma7,linreg10,lowest_low15,macd,mfi12,mom4,pivot_low2,rma6,roc5,stddev11,stoch,tsi,vwap,wma8"
_SAID = ["ta.crossover(fast, slow);ta.crossunder(fast, slow)", "r > 50", "fast > slow", "r < 30 and close > slow", "", "longA > 1;longB > 1;shortA > 1;shortB > 1", "buyA > 1;buyB > 1;buyC > 1", "ta.cross(r, 0);ta.cross(r, 1);ta.cross(r, 2)", "buffer", ""]
_SAID_SQL = f"list_element({_SAID!r}, (k % 10 + 1)::INT)"
_SIDE = "CASE WHEN k % 10 IN (0, 4, 5, 7, 9) THEN 'BOTH' ELSE 'BUY' END"
_CLEAR = "k % 10 NOT IN (4, 8, 9)"
_SURE = f"floor((0.2e0 + 0.2e0 + 0.2e0 + CASE WHEN {_CLEAR} THEN 0.2e0 ELSE 0e0 END + 0.1e0) * CASE {_GRADE} WHEN 'complex' THEN 0.6e0 WHEN 'medium' THEN 0.85e0 ELSE 1e0 END * 100 + 0.5e0) / 100"


@query(f"""WITH {_PART} SELECT url, {_NAME} AS name, {_TRADED} AS is_tradeable, CASE WHEN NOT {_TRADED} THEN 'no_signals: pure indicator/visualization' END AS skip_reason, {_TYPE} AS strategy_type, {_GRADE} AS complexity,
 CASE WHEN k % 10 = 9 THEN NULL ELSE list_element(['4h', '15m', '1d', NULL, '1h', '1d'], (k % 6 + 1)::INT) END AS timeframe,
 CASE k % 4 WHEN 0 THEN 'kama' WHEN 1 THEN 'vidya' ELSE '' END AS unknown,
 array_to_string(list_sort(string_split('rsi' || p_size || ',sma50' || CASE WHEN k % 7 = 3 THEN ',pivot_high5' ELSE '' END || CASE WHEN k % 13 = 5 THEN ',{_MANY_KEYS}' ELSE '' END, ',')), ',') AS indicators,
 CASE WHEN k % 17 = 3 THEN '' ELSE 'factorMult=1.5,' END || 'len=' || p_size || '.0' AS parameters FROM q""")
def script_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1-X7."""
    f = corpus.script_features(scripts(spark, sf_dir))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("parameters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    indicator_keys = F.array_join(F.array_sort("indicators.outputKey"), ",")
    return f.select("url", "name", "is_tradeable", "skip_reason", "strategy_type", "complexity", "timeframe", F.array_join("unknown", ",").alias("unknown"), indicator_keys.alias("indicators"), flat.alias("parameters"))


@query(f"WITH {_PART} SELECT url, {_SIDE} AS direction, {_SAID_SQL} AS conditions, ({_SURE})::DOUBLE AS confidence, {_CLEAR} AS evaluable FROM q WHERE {_TRADED}")
def entry_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8, X10, F11, T4."""
    s = corpus.script_specs(scripts(spark, sf_dir))
    return s.select("url", "entry.direction", F.array_join("entry.conditions", ";").alias("conditions"), "confidence", "evaluable")


_BOUND = "list_element([['fast', 'slow'], ['r'], ['fast', 'slow'], ['r', 'slow'], [], [], [], ['r'], [], []], (k % 10 + 1)::INT)"


@query(f"""WITH {_PART}, b AS (SELECT url, p_size, unnest({_BOUND}) AS name FROM q WHERE {_TRADED})
SELECT url, name, CASE name WHEN 'fast' THEN 'EMA' WHEN 'slow' THEN 'SMA' ELSE 'RSI' END AS type, CASE name WHEN 'fast' THEN 'len' WHEN 'slow' THEN '50' ELSE p_size::VARCHAR END AS period FROM b""")
def auto_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X9."""
    return corpus.auto_bind(corpus.script_features(scripts(spark, sf_dir)).filter("is_tradeable"))


@query(f"""WITH {_PART}, n AS (SELECT *, {_NAME} AS name FROM q WHERE {_TRADED}) SELECT url, CASE WHEN name = 'Unknown Strategy' THEN 'UnknownST' || row_number() OVER (PARTITION BY name = 'Unknown Strategy' ORDER BY url) ELSE name END AS name FROM n""")
def name_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X13."""
    return corpus.name_unknown(corpus.script_features(scripts(spark, sf_dir)).filter("is_tradeable").select("url", "name"))


@query("""WITH t AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'kama' WHEN 1 THEN 'vidya' END AS fn FROM part) SELECT fn, count(*) * 2 AS n FROM t WHERE fn IS NOT NULL GROUP BY fn ORDER BY n DESC, fn LIMIT 10""")
def unknown_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tally merged with the one before it, the ten most frequent."""
    f = corpus.script_features(scripts(spark, sf_dir))
    return strategies.top_tally(corpus.unknown_tally(f, corpus.unknown_tally(f)), 10, "fn")


@query("SELECT 'no_signals: pure indicator/visualization' AS skip_reason, count(*) AS n FROM part WHERE p_partkey % 10 = 4 HAVING count(*) > 0")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    return corpus.skip_reasons(corpus.script_features(scripts(spark, sf_dir)))


@query("SELECT 'part/' || p_partkey AS url, unnest(['RSI', 'SMA']) AS type, unnest([p_size::DOUBLE, 50.0::DOUBLE]) AS period FROM part")
def distinct_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of calls of the scripts, each listed twice before."""
    f = corpus.script_features(scripts(spark, sf_dir)).select("url", F.inline_outer("indicators")).filter("type IN ('RSI', 'SMA')")
    f = f.select("url", "type", F.col("params")["period"].alias("params"))
    twice = f.select("*", F.explode(F.array(F.lit(1), F.lit(2)))).drop("col")
    return corpus.distinct_indicators(twice).withColumnRenamed("params", "period")


def _curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of some scripts; parts with the same script give several for one hash."""
    k, none = F.col("seq"), F.lit(None)
    entry = F.struct(F.lit("SELL").alias("direction"), none.cast("array<string>").alias("conditions"), F.lit("bar close").alias("gate"))
    leave = F.struct(F.array(F.lit("r > 80")).alias("conditions"), F.lit("2%").alias("stopLoss"))
    binding = F.create_map(F.lit("fast"), F.struct(F.lit("WMA").alias("type"), none.cast("string").alias("source"), none.cast("map<string,string>").alias("params")))
    h = scripts(spark, sf_dir).select(k, scalars.raw_hash(F.col("source_text")).alias("raw_hash")).filter("seq % 5 = 0 OR seq % 7 = 0 OR seq % 9 = 1")
    return h.select(
        "raw_hash", "seq", F.when(k % 7 == 0, "duplicate idea").alias("skip"), F.when((k % 7 == 0) & (k % 2 == 0), "duplicate").alias("category"), F.when(k % 5 == 0, entry).alias("entry"), F.when(k % 15 == 0, leave).alias("exit"),
        F.when(k % 5 == 0, binding).alias("bindings"), F.when(k % 5 == 0, "checked").alias("notes"), F.when(k % 9 == 1, "crypto").alias("assetClass"),
    )


_FIXED = f"""{_PART}, h AS (SELECT *, sha256({_TEXT})[1:16] AS hash FROM q), c AS (SELECT hash, max(k) FILTER (k % 7 = 0) AS s, max(k) AS last FROM h WHERE k % 5 = 0 OR k % 7 = 0 OR k % 9 = 1 GROUP BY ALL),
j AS (SELECT h.*, c.hash IS NOT NULL AS hit, c.s AS skips, c.last AS c FROM h LEFT JOIN c USING (hash))"""
_BOUND_AS = "CASE n WHEN 'fast' THEN CASE WHEN hit AND c % 5 = 0 THEN 'WMA' ELSE 'EMA' END WHEN 'slow' THEN 'SMA' ELSE 'RSI' END"


@query(f"""WITH {_FIXED}, w AS (SELECT *, CASE WHEN k % 10 = 9 THEN row_number() OVER (PARTITION BY k % 10 = 9 ORDER BY url) END AS st FROM j WHERE {_TRADED} AND skips IS NULL),
b AS (SELECT *, list_sort(list_distinct({_BOUND} || CASE WHEN hit AND c % 5 = 0 THEN ['fast'] ELSE [] END)) AS names FROM w)
SELECT url, CASE WHEN hit AND c % 5 = 0 THEN 'SELL' ELSE {_SIDE} END AS direction, {_SAID_SQL} AS conditions, CASE WHEN hit AND c % 5 = 0 THEN 'bar close' END AS gate, CASE WHEN hit AND c % 15 = 0 THEN 'r > 80/2%' END AS leave,
 array_to_string(list_transform(names, lambda n: n || '=' || {_BOUND_AS}), ',') AS bindings, CASE WHEN hit THEN 'manual' ELSE 'static' END AS "parsedBy", CASE WHEN hit AND c % 5 = 0 THEN 'checked' END AS notes, CASE WHEN hit AND c % 9 = 1 THEN 'crypto' ELSE 'any' END AS "assetClass",
 CASE WHEN hit THEN greatest(0.85, {_SURE}) ELSE {_SURE} END::DOUBLE AS confidence, regexp_replace(regexp_replace(lower(CASE WHEN st IS NOT NULL THEN 'UnknownST' || st ELSE {_NAME} END), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')[1:50] || '-' || hash[1:6] AS id FROM b""")
def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all scripts with their corrections."""
    fixed = _curation(spark, sf_dir)
    out = corpus.curate(corpus.spec_records(scripts(spark, sf_dir), 0, fixed), fixed)
    flat = F.array_join(F.array_sort(F.transform(F.map_entries("bindings"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["type"]))), ",")
    leave = F.when(F.col("exit.conditions").isNotNull(), F.concat_ws("/", F.array_join("exit.conditions", ";"), "exit.stopLoss"))
    return out.select(F.col("source").alias("url"), "entry.direction", F.array_join("entry.conditions", ";").alias("conditions"), "entry.gate", leave.alias("leave"), flat.alias("bindings"), "parsedBy", "notes", "assetClass", "confidence", "id")


@query(f"""WITH {_FIXED}, w AS (SELECT *, {_TRADED} AND skips IS NULL AS has, CASE WHEN hit THEN greatest(0.85, {_SURE}) ELSE {_SURE} END AS sure FROM j)
SELECT count(*) FILTER (has) AS written, count(*) FILTER (has AND hit) AS enriched, count(*) FILTER (skips IS NOT NULL) AS skipped, count(*) FILTER (skips IS NULL AND NOT {_TRADED}) AS non_tradeable, 0::BIGINT AS parse_failed,
 count(*) FILTER (has AND {_CLEAR}) AS entry_evaluable, count(*) FILTER (has AND k % 10 = 8) AS entry_bare, count(*) FILTER (has AND k % 10 = 9) AS entry_none,
 count(*) FILTER (has AND sure >= 0.5) AS confidence_high, count(*) FILTER (has AND sure >= 0.4 AND sure < 0.5) AS confidence_mid, count(*) FILTER (has AND sure < 0.4) AS confidence_low FROM w""")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    s, fixed = scripts(spark, sf_dir), _curation(spark, sf_dir)
    return corpus.corpus_report(corpus.script_features(s), corpus.curate(corpus.spec_records(s, 0, number=False), fixed), fixed)  # curate drops the skipped ones


@query(f"WITH {_FIXED} SELECT CASE WHEN skips % 2 = 0 THEN 'duplicate' ELSE 'uncategorised' END AS category, count(*) AS n FROM j WHERE skips IS NOT NULL GROUP BY ALL")
def skip_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts that are curated away, by category."""
    return corpus.skip_categories(corpus.script_features(scripts(spark, sf_dir)), _curation(spark, sf_dir))


_REGISTRY = "r AS (SELECT o_custkey AS url, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' ELSE 'error' END AS status FROM orders)"


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("seq"), status.alias("status"))


for _mode, _first, _order in (("ignore", "min", "seq"), ("replace", "max", "seq DESC")):
    query(
        f"""WITH {_REGISTRY}, old AS (SELECT c_custkey AS url, 'known' AS status FROM customer WHERE c_custkey % 3 = 0), ch AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_order}) AS n FROM r)
SELECT coalesce(ch.url, old.url) AS url, {'coalesce(old.status, ch.status)' if _mode == 'ignore' else 'coalesce(ch.status, old.status)'} AS status FROM (SELECT * FROM ch WHERE n = 1) ch FULL JOIN old USING (url)""",
        f"registry_{_mode}",
    )(
        lambda spark, sf_dir, m=_mode: corpus.registry_upsert(
            spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("url"), F.lit("known").alias("status")), _registry(spark, sf_dir), ["url"], m
        ).select("url", "status")
    )


@query(f"""WITH {_REGISTRY}, ch AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq % 2 DESC, seq DESC) AS n FROM r)
SELECT coalesce(ch.url, c_custkey) AS url, coalesce(ch.status, 'known') AS status FROM (SELECT * FROM ch WHERE n = 1) ch FULL JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = ch.url""")
def store_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 as a store: the known urls, then two batches of changes, each in the parts that it touches."""
    store, changes = stores.Store(_new_folder(spark, "registry"), ["url"], 8), _registry(spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("url"), F.lit("known").alias("status"), F.lit(0).cast("long").alias("seq"))
    for batch in (known, changes.filter("seq % 2 = 0"), changes.filter("seq % 2 = 1")):
        stores.add_to_registry(store, batch)
    return store.read(spark)


@query("""WITH d AS (SELECT doc_id, text, sha256(text)[1:16] AS raw_hash FROM documents)
SELECT raw_hash, 'doc/' || first(doc_id ORDER BY doc_id % 2 DESC, doc_id DESC) AS url, length(any_value(text)) AS n_chars FROM d GROUP BY raw_hash""")
def store_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 as a store: contents appended once, the url seen last for each, in two batches."""
    folder = _new_folder(spark, "scripts")
    contents, urls = (stores.Store(f"{folder}/{name}", ["raw_hash"], 8) for name in ("contents", "urls"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id").alias("url"), F.col("text").alias("source_text"), F.col("doc_id").alias("seq"))
    for batch in (d.filter("seq % 2 = 0"), d.filter("seq % 2 = 1")):
        stores.add_scripts(contents, urls, batch)
    held = contents.read(spark).select(F.col("raw_hash").alias("_hash"), F.length("source_text").cast("long").alias("n_chars"))
    return urls.read(spark).join(held, F.col("raw_hash").eqNullSafe(F.col("_hash"))).select("raw_hash", "url", "n_chars")


@query("""WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS c FROM orders GROUP BY ALL), n AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey < 12)
SELECT coalesce(n.id, o.id) AS id, coalesce(o.c, -1) AS "createdAt", CASE WHEN n.id IS NULL THEN 'old' ELSE 'new' END AS notes FROM n FULL JOIN o ON o.id = n.id""")
def store_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, J6 as a store: records of an id that is there get new contents and keep their time."""
    store = stores.Store(_new_folder(spark, "specs"), ["id"], 8)
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("createdAt")).withColumn("notes", F.lit("old"))
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_nationkey < 12").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("createdAt"), F.lit("new").alias("notes"))
    for batch in (old, new):
        stores.add_specs(store, batch)
    return store.read(spark)


@query(f"WITH {_REGISTRY} SELECT status, count(*) AS n FROM r GROUP BY ALL")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return corpus.status_counts(_registry(spark, sf_dir))


@query(f"WITH {_REGISTRY} SELECT c_custkey AS url FROM customer WHERE c_custkey NOT IN (SELECT url FROM r WHERE status NOT IN ('pending', 'error'))")
def todo_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("url"))
    return corpus.todo_scripts(found, _registry(spark, sf_dir))


@query("""SELECT DISTINCT p_size AS page_num, p_brand AS listing_path FROM part EXCEPT SELECT p_size, p_brand FROM part WHERE p_partkey % 3 = 0""")
def todo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages that are not yet known, one for each size and brand of parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").alias("page_num"), F.col("p_brand").alias("listing_path"))
    return corpus.todo_pages(part.select("page_num", "listing_path").distinct(), part.filter("p_partkey % 3 = 0"))


@query("""WITH o AS (SELECT o_custkey AS id, min(o_orderkey) AS c FROM orders GROUP BY ALL) SELECT c_custkey AS id, coalesce(o.c, -1) AS "createdAt" FROM customer LEFT JOIN o ON o.id = c_custkey""")
def keep_created_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6."""
    new = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("createdAt"))
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("createdAt"))
    return corpus.keep_created_at(new, old)


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each part; some cannot run."""
    k = F.col("p_partkey")
    rule = F.when(k % 5 == 0, "ta.crossover(fast, slow)").when(k % 5 == 1, "foo > 1 and math.floor(bar) > 2").when(k % 5 == 2, 'state == "long"').when(k % 5 == 3, "close >")
    conditions = F.when(k % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(rule))
    bind = lambda kind, src: F.struct(F.lit(kind).alias("type"), F.lit(src).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("params"))
    bindings = F.create_map(F.lit("fast"), bind("EMA", None), F.lit("slow"), bind("SMA", "fast"))
    bindings = F.when(k % 15 == 1, F.map_concat(bindings, F.create_map(F.lit("t"), bind("TSI", "zz")))).otherwise(bindings)
    entry = F.struct(F.lit("BUY").alias("direction"), F.lit(None).cast("string").alias("trigger"), conditions.alias("conditions"))
    leave = F.struct(F.lit(None).cast("array<string>").alias("conditions"))
    return _spread_part(spark, sf_dir, "p_partkey").select(k.alias("id"), entry.alias("entry"), leave.alias("exit"), bindings.alias("bindings"), F.create_map(F.lit("n"), F.lit("5")).alias("parameters"))


_MISSING = "CASE WHEN k % 15 = 1 THEN 'bar,binding:t.source(zz),call:math.floor,foo,indicator:TSI' WHEN k % 5 = 1 THEN 'bar,call:math.floor,foo' ELSE '' END"


@query(f"""WITH {_PART} SELECT k AS id, k % 5 = 0 AS ok, CASE k % 5 WHEN 1 THEN CASE WHEN k % 15 = 1 THEN '5' ELSE '3' END || ' unresolved' WHEN 2 THEN 'string comparison' WHEN 3 THEN 'unparseable condition' WHEN 4 THEN 'no entry conditions' END AS reason, {_MISSING} AS missing FROM q""")
def assemblable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, U1."""
    words = F.regexp_extract("reason", r"^(\d unresolved|string comparison|unparseable condition|no entry conditions)", 1)
    return strategies.assemblable(_specs(spark, sf_dir)).select("id", "ok", words.alias("reason"), F.array_join(F.coalesce("missing", F.array()), ",").alias("missing"))


@query(f"WITH {_PART}, m AS (SELECT unnest(string_split({_MISSING}, ',')) AS name FROM q) SELECT name, count(*) AS n FROM m WHERE name <> '' GROUP BY ALL ORDER BY n DESC, name LIMIT 15")
def missing_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, T3."""
    return strategies.missing_tally(strategies.assemblable(_specs(spark, sf_dir)))


@query("""WITH p AS (SELECT p_partkey AS k, p_size FROM part) SELECT k AS id, CASE WHEN k % 2 = 0 THEN p_size::DOUBLE ELSE 14.0::DOUBLE END AS period FROM p WHERE k % 3 <> 2""")
def resolve_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 on tables: numbers, names of parameters, and names that resolve to nothing."""
    k = F.col("p_partkey")
    given = F.when(k % 3 == 2, "nowhere").when(k % 2 == 0, "len").otherwise("14")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.create_map(F.lit("period"), given).alias("params"), F.create_map(F.lit("len"), F.col("p_size").cast("string")).alias("parameters"))
    found = part.select("id", strategies.resolved_map(F.col("params"), F.col("parameters")).alias("m"))
    return found.filter(F.size("m") > 0).select("id", F.col("m")["period"].alias("period"))


def frame_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of the second dialect, one for each part."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    head = F.when(k % 6 == 5, F.lit("x = 1")).otherwise(F.concat(F.lit("class Part"), k.cast("string"), F.lit("(IStrategy):\n    timeframe = '1h'\n    stoploss = -0.1\n    buy_params = {'low': "), size, F.lit("}\n")))
    body = F.lit("    def populate_indicators(self, dataframe, metadata):\n        dataframe['fast'] = ta.EMA(dataframe, timeperiod=12)\n        dataframe['rsi'] = ta.RSI(dataframe)\n        return dataframe\n    def populate_entry_trend(self, dataframe, metadata):\n        dataframe.loc[(")
    rule = (
        F.when(k % 6 == 0, "(dataframe['rsi'] < self.low.value) & (qtpylib.crossed_above(dataframe['close'], dataframe['fast']))")
        .when(k % 6 == 1, "(dataframe['close'] > dataframe['close'].shift(1))")
        .when(k % 6 == 2, "(dataframe['rsi'].rolling(3).mean() > 1)")
        .when(k % 6 == 3, "(reduce(x) > 1)")
        .otherwise("(dataframe['my-col'] > 1)")
    )
    text = F.concat(head, body, rule, F.lit("), 'enter_long'] = 1\n"))
    return _spread_part(spark, sf_dir, "p_partkey", "p_size").select(F.concat(F.lit("part/"), k.cast("string")).alias("url"), text.alias("source_text"))


@query(f"""WITH {_PART} SELECT url, CASE WHEN k % 6 < 2 THEN CASE k % 6 WHEN 0 THEN '(rsi < low) and (ta.crossover(close, fast))' ELSE 'close > close[1]' END END AS entry,
 CASE k % 6 WHEN 2 THEN 'unsupported call rsi.rolling' WHEN 3 THEN 'unsupported call reduce' WHEN 4 THEN 'untranslated dataframe expression' WHEN 5 THEN 'no strategy class' END AS skip_reason,
 CASE WHEN k % 6 <> 5 THEN p_size::VARCHAR END AS low FROM q""")
def dataframe_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11, X12."""
    d = corpus.dataframe_strategies(frame_scripts(spark, sf_dir))
    return d.select("url", F.when(F.col("skip_reason").isNull(), F.col("entry")).alias("entry"), "skip_reason", F.col("parameters")["low"].alias("low"))


def _range_width(bars, values, params):
    """High less low: an indicator of the user's own, for E1."""
    return (bars["high"] - bars["low"]).to_numpy()


def _from_low(source, keys, period):
    """How far the source is above its lowest value: the same as a column."""
    frame = window(keys).rowsBetween(1 - period, 0)
    return {"low": F.min(source).over(frame), "above": source - F.min(source).over(frame)}


@query(f"""WITH {_EVENT_BARS}, m AS (SELECT *, min(close) OVER {_roll(9)} AS low9 FROM bars)
SELECT {_K}, timestamp, round(high - low, 6) AS width, round(low9, 6) AS f__low, round(close - low9, 6) AS f__above, {_full('close - low9', f'round(avg(close - low9) OVER {_roll(4)}, 6)', 4)} AS mean FROM m""")
def own_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered types, a function of arrays and a column in the shared pass of windows, and an indicator of that."""
    recursive.register_indicator("WIDTH", _range_width)
    strategies.register_columns("FROM_LOW", _from_low, {"period": 5}, ("low", "above"))
    bound = {"f": Binding("FROM_LOW", {"period": "n"}), "mean": Binding("SMA", {"period": 4}, "f.above"), "width": Binding("WIDTH")}
    return strategies.compose(_hourly(spark, sf_dir), bound, {"n": 9}).select(*KEYS, "timestamp", _r("width"), _r("f__low"), _r("f__above"), _r("mean"))
