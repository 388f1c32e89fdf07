"""Operators on whole series: slices, splits, positions in the series, yearly bars, buy and hold."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arrays import GAPS
from tidemark.functions.rules import window
from tidemark.functions.scalars import YEAR_MS, typical_prices
from tidemark.schemas import KEYS


def with_typical_prices(candles: DataFrame) -> DataFrame:
    return candles.withColumns(typical_prices())


def bar_index(candles: DataFrame, keys: Sequence[str] = KEYS, name: str = "bar_index") -> DataFrame:
    """0-based position in the series."""
    return candles.withColumn(name, F.row_number().over(window(keys)) - 1)


def window_slice(candles: DataFrame, years: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last `years` years of each series, counted from its last bar."""
    last = F.max("timestamp").over(Window.partitionBy(*keys))
    return candles.withColumn("_last", last).filter(F.col("timestamp") >= F.col("_last") - years * YEAR_MS).drop("_last")


def window_slices(candles: DataFrame, windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One copy of each series for each of its windows(keys, years), cut to it, with the column `years`.

    The table of windows has a few rows for each series, so the candles are shuffled once, by key.
    """
    ends = candles.groupBy(*keys).agg(F.max("timestamp").alias("_last"))
    cuts = windows.join(ends, list(keys))
    return candles.join(cuts, list(keys)).filter(F.col("timestamp") >= F.col("_last") - F.col("years") * YEAR_MS).drop("_last")


def window_list(candles: DataFrame, base: Sequence[int] = (3, 5), keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and years: of the base windows and the rounded whole span those that the series is long enough for."""
    span = candles.groupBy(*keys).agg(((F.max("timestamp") - F.min("timestamp")) / YEAR_MS).alias("full"))
    whole = F.floor(F.col("full") + 0.5).cast("int")
    years = F.array_distinct(F.array(*[F.lit(b) for b in base], whole))
    fits = F.filter(years, lambda y: (y > 0) & (y <= F.col("full") + 0.1))
    return span.select(*keys, F.explode(F.sort_array(fits)).alias("years"))


def train_test_split(candles: DataFrame, frac: Fraction = Fraction(2, 3), keys: Sequence[str] = KEYS) -> DataFrame:
    """`slice` is train for the first part of the bars of each series and test for the rest; a series with an empty part goes."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    cut = F.floor(n * frac.numerator / F.lit(frac.denominator))
    rows = candles.withColumns({"_i": F.row_number().over(window(keys)), "_cut": cut, "_n": n})
    rows = rows.filter((F.col("_cut") > 0) & (F.col("_cut") < F.col("_n")))
    return rows.withColumn("slice", F.when(F.col("_i") <= F.col("_cut"), "train").otherwise("test")).drop("_i", "_cut", "_n")


def buy_hold(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Percent gained from the first close to the last."""
    gain = (F.max_by("close", "timestamp") / F.min_by("close", "timestamp") - 1) * 100
    return candles.groupBy(*keys).agg(gain.alias("buy_hold"))


def yearly_bars(gaps: Column, n: Column) -> Column:
    """Bars in a year by the upper median of the sorted gaps between the first bars; 252 for fewer than three bars."""
    median = F.try_element_at(gaps, (F.floor(F.size(gaps) / 2) + 1).cast("int"))
    return F.when(n < 3, F.lit(252.0)).otherwise(YEAR_MS / F.when(median == 0, F.lit(3_600_000)).otherwise(median))


def bars_per_year(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """`yearly_bars` of each series."""
    w = window(keys)
    rows = candles.select(*keys, "timestamp", F.row_number().over(w).alias("_i"), F.lag("timestamp").over(w).alias("_before"))
    gaps = F.sort_array(F.collect_list(F.when(F.col("_i") <= GAPS, F.col("timestamp") - F.col("_before"))))  # 199 items at most
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), gaps.alias("_gaps"))
    return out.select(*keys, yearly_bars(F.col("_gaps"), F.col("_n")).alias("bars_per_year"))
