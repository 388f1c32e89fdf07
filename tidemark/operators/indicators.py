"""Indicators over a bounded number of bars, as window columns.

All windows share one partitioning and order, so any number of indicators costs one shuffle and one sort. A
value is NULL until its frame is full and none of it is missing.

A sliding frame costs every bar as many steps as the period has. Beyond LONG bars the series is therefore cut into blocks of one period:
a frame is the beginning of a block and the end of the block before, both of which are running values (`_halves`), so the period doesn't
matter. That takes two more sorts inside the same shuffle. CCI and STOCH always slide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import window
from tidemark.schemas import KEYS


#: Longest period for which frames slide.
LONG = 64


def _roll(n: int, keys: Sequence[str]):
    return window(keys).rowsBetween(1 - n, 0)


def _full(x: Column, value: Column, n: int, keys: Sequence[str]) -> Column:
    return F.when(F.count(x).over(_roll(n, keys)) == n, value)


def _over(f, x: Column, n: int, keys: Sequence[str]) -> Column:
    return _full(x, f(x).over(_roll(n, keys)), n, keys)


def _halves(df: DataFrame, n: int, keys: Sequence[str], parts: dict[str, Column]) -> DataFrame:
    """df with `_j`, the bar's place in its block of n bars, and of each aggregate `_a_`, its value from the block's start to the bar, and
    `_z_`, that of the frame's bars in the block before (null where there are none)."""
    df = df.withColumn("_i", F.row_number().over(window(keys)) - 1)
    df = df.withColumns({"_b": F.floor(F.col("_i") / n), "_j": F.col("_i") % n})
    block = Window.partitionBy(*keys, "_b")
    back, ahead = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.desc("_i"), F.asc("_i")))
    df = df.withColumns({f"_z_{k}": p.over(back) for k, p in parts.items()})
    df = df.withColumns({f"_a_{k}": p.over(ahead) for k, p in parts.items()})
    series = Window.partitionBy(*keys).orderBy("_b", "_i")  # sorted so already
    return df.withColumns({f"_z_{k}": F.when(F.col("_j") < n - 1, F.lag(f"_z_{k}", n - 1).over(series)) for k in parts})


def _long(df: DataFrame, x: Column, n: int, keys: Sequence[str], parts: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """df with values made of the halves of parts, where n values of x are there."""
    parts = {"n": F.count(x), **parts}
    full = _sum("n") == n
    out = _halves(df, n, keys, parts).withColumns({k: F.when(full, v) for k, v in values.items()})
    return out.drop("_i", "_b", "_j", *[f"_{side}_{k}" for k in parts for side in "az"])


def _sum(name: str) -> Column:
    return F.col(f"_a_{name}") + F.coalesce(f"_z_{name}", F.lit(0))


def _deviation(n: int) -> Column:
    """Population standard deviation from counts n, means m and variances v of both halves."""
    spread = F.col("_a_v") * F.col("_a_n") + F.coalesce(F.col("_z_v") * F.col("_z_n"), F.lit(0.0))
    apart = F.coalesce((F.col("_a_m") - F.col("_z_m")) ** 2 * F.col("_a_n") * F.col("_z_n") / n, F.lit(0.0))
    return F.sqrt((spread + apart) / n)


def sma(df: DataFrame, period: int = 20, source: str = "close", keys: Sequence[str] = KEYS, name: str = "sma") -> DataFrame:
    x = F.col(source)
    if period > LONG:
        return _long(df, x, period, keys, {"x": F.sum(x)}, {name: _sum("x") / period})
    return df.withColumn(name, _over(F.avg, x, period, keys))


def stddev(df: DataFrame, period: int = 20, source: str = "close", keys: Sequence[str] = KEYS, name: str = "stddev") -> DataFrame:
    """Population standard deviation."""
    x = F.col(source)
    if period > LONG:
        return _long(df, x, period, keys, {"m": F.avg(x), "v": F.var_pop(x)}, {name: _deviation(period)})
    return df.withColumn(name, _over(F.stddev_pop, x, period, keys))


def highest(df: DataFrame, period: int = 14, source: str = "close", keys: Sequence[str] = KEYS, name: str = "highest") -> DataFrame:
    x = F.col(source)
    if period > LONG:
        return _long(df, x, period, keys, {"x": F.max(x)}, {name: F.greatest("_a_x", "_z_x")})
    return df.withColumn(name, _over(F.max, x, period, keys))


def lowest(df: DataFrame, period: int = 14, source: str = "close", keys: Sequence[str] = KEYS, name: str = "lowest") -> DataFrame:
    x = F.col(source)
    if period > LONG:
        return _long(df, x, period, keys, {"x": F.min(x)}, {name: F.least("_a_x", "_z_x")})
    return df.withColumn(name, _over(F.min, x, period, keys))


def _weighted(x: Column, n: int, keys: Sequence[str]) -> Column:
    """Mean with weights 1 to n, the newest heaviest."""
    values = F.collect_list(x).over(_roll(n, keys))
    total = F.aggregate(F.transform(values, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return _full(x, total / (n * (n + 1) / 2), n, keys)


def wma(df: DataFrame, period: int = 20, source: str = "close", keys: Sequence[str] = KEYS, name: str = "wma") -> DataFrame:
    x = F.col(source)
    if period > LONG:  # bar k of a block weighs n - j + k in the frame that ends at its bar j, bar k of the block before k - j
        both = _sum("kx") + (period - F.col("_j")) * F.col("_a_x") - F.col("_j") * F.coalesce("_z_x", F.lit(0.0))
        return _long(df, x, period, keys, {"x": F.sum(x), "kx": F.sum(F.col("_j") * x)}, {name: both / (period * (period + 1) / 2)})
    return df.withColumn(name, _weighted(x, period, keys))


def hma(df: DataFrame, period: int = 20, source: str = "close", keys: Sequence[str] = KEYS, name: str = "hma") -> DataFrame:
    """Weighted mean, over the rounded root of the period, of twice the half-period mean less the whole one."""
    half, root = int(period / 2 + 0.5), int(period**0.5 + 0.5)
    df = wma(wma(df, half, source, keys, "_half"), period, source, keys, "_whole")
    df = df.withColumn("_hma", 2 * F.col("_half") - F.col("_whole"))
    return wma(df, root, "_hma", keys, name).drop("_hma", "_half", "_whole")


def bollinger(df: DataFrame, period: int = 20, k: float = 2.0, source: str = "close", keys: Sequence[str] = KEYS, name: str = "bb") -> DataFrame:
    """name__middle, name__upper and name__lower."""
    x = F.col(source)
    if period > LONG:
        mid, dev = (F.col("_a_m") * F.col("_a_n") + F.coalesce(F.col("_z_m") * F.col("_z_n"), F.lit(0.0))) / period, k * _deviation(period)
        bands = {f"{name}__middle": mid, f"{name}__upper": mid + dev, f"{name}__lower": mid - dev}
        return _long(df, x, period, keys, {"m": F.avg(x), "v": F.var_pop(x)}, bands)
    mid, dev = _over(F.avg, x, period, keys), k * _over(F.stddev_pop, x, period, keys)
    return df.withColumns({f"{name}__middle": mid, f"{name}__upper": mid + dev, f"{name}__lower": mid - dev})


def roc(df: DataFrame, period: int = 12, source: str = "close", keys: Sequence[str] = KEYS, name: str = "roc") -> DataFrame:
    """Change over `period` bars as a fraction."""
    before = F.lag(source, period).over(window(keys))
    return df.withColumn(name, F.when(before != 0, (F.col(source) - before) / before))


def mom(df: DataFrame, period: int = 10, source: str = "close", keys: Sequence[str] = KEYS, name: str = "mom") -> DataFrame:
    return df.withColumn(name, F.col(source) - F.lag(source, period).over(window(keys)))


def true_range(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "tr") -> DataFrame:
    """High less low on the first bar."""
    before = F.lag("close").over(window(keys))
    return df.withColumn(name, F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def vwap(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "vwap") -> DataFrame:
    """From the first bar of the series on."""
    so_far = window(keys).rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    volume = F.sum("volume").over(so_far)
    return df.withColumn(name, F.when(volume != 0, F.sum(typical * F.col("volume")).over(so_far) / volume))


def vwma(df: DataFrame, period: int = 20, keys: Sequence[str] = KEYS, name: str = "vwma") -> DataFrame:
    if period > LONG:
        parts = {"v": F.sum("volume"), "pv": F.sum(F.col("close") * F.col("volume"))}
        return _long(df, F.col("close"), period, keys, parts, {name: _sum("pv") / F.when(_sum("v") != 0, _sum("v"))})
    volume = F.sum("volume").over(_roll(period, keys))
    mean = F.sum(F.col("close") * F.col("volume")).over(_roll(period, keys)) / F.when(volume != 0, volume)
    return df.withColumn(name, _full(F.col("close"), mean, period, keys))


def cci(df: DataFrame, period: int = 20, keys: Sequence[str] = KEYS, name: str = "cci") -> DataFrame:
    """Distance of the typical price from its mean, in units of 0.015 mean absolute deviations."""
    x = (F.col("high") + F.col("low") + F.col("close")) / 3
    mean = F.avg(x).over(_roll(period, keys))
    df = df.withColumns({"_x": x, "_mean": mean, "_all": F.collect_list(x).over(_roll(period, keys))})
    spread = F.aggregate("_all", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("_mean"))) / period
    value = F.when((F.size("_all") == period) & (spread != 0), (F.col("_x") - F.col("_mean")) / (0.015 * spread))
    return df.withColumn(name, value).drop("_x", "_mean", "_all")


def stoch(df: DataFrame, k: int = 14, slow: int = 3, d: int = 3, keys: Sequence[str] = KEYS, name: str = "stoch") -> DataFrame:
    """name__stochK, name__stochD and name__stochJ = 3K - 2D."""
    low, high = _over(F.min, F.col("low"), k, keys), _over(F.max, F.col("high"), k, keys)
    df = df.withColumn("_raw", F.when(high != low, 100 * (F.col("close") - low) / (high - low)))
    df = df.withColumn(f"{name}__stochK", _over(F.avg, F.col("_raw"), slow, keys))
    df = df.withColumn(f"{name}__stochD", _over(F.avg, F.col(f"{name}__stochK"), d, keys))
    return df.withColumn(f"{name}__stochJ", 3 * F.col(f"{name}__stochK") - 2 * F.col(f"{name}__stochD")).drop("_raw")
