"""Series in blocks, which take several tasks, against whole series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.bars import bars
from tests.test_kernel import walk
from tidemark.operators import blocks, positions, recursive
from tidemark.schemas import KEYS

HOUR = 3_600_000
REQUESTS = [
    ("EMA", {"period": 9}, "close", "ema"), ("RMA", {"period": 9}, "close", "rma"), ("RSI", {"period": 5}, "high", "rsi"), ("ATR", {"period": 3}, "close", "atr"), ("ADX", {"period": 4}, "close", "adx"),
    ("MACD", {"fast": 3, "slow": 7, "signal": 4}, "close", "macd"), ("SUPERTREND", {"period": 4, "multiplier": 1}, "close", "st"), ("SUPERTREND", {"period": 2, "multiplier": 0.1}, "close", "tight"), ("EMA", {"period": 1}, "close", "one"), ("RMA", {"period": 1}, "gaps", "rma1"), ("EMA", {"period": 3}, "gaps", "late"), ("RMA", {"period": 60}, "close", "long"),
]


def series_of(spark):
    gaps = F.when((F.col("timestamp") > 40 * HOUR) & (F.col("timestamp") % (7 * HOUR) != 0), F.col("close"))
    return walk(spark, 230, 11).unionByName(walk(spark, 12, 12, "short")).unionByName(walk(spark, 1, 13, "one")).withColumn("gaps", gaps)


@pytest.mark.parametrize("length", [1, 50])
def test_recursive_indicators_in_blocks(spark, length):
    df = series_of(spark)
    out = recursive.recursive_indicators(df, REQUESTS, block_ms=length * HOUR).toPandas()
    assert len(out) == 243 and "_block" not in out.columns
    for _, rows in out.groupby("symbol"):
        rows = rows.sort_values("timestamp").reset_index(drop=True)
        for kind, params, source, name in REQUESTS:
            found = recursive.compute(kind, params, rows, source)
            for column, want in ({f"{name}__{k}": v for k, v in found.items()} if isinstance(found, dict) else {name: found}).items():
                np.testing.assert_allclose(rows[column].to_numpy(float), want, rtol=1e-9, atol=1e-9, err_msg=f"{column} {length}")


def test_a_long_series_takes_several_tasks(spark):
    df = recursive.recursive_indicators(walk(spark, 400, 14), [("EMA", {"period": 5}, "close", "e")], block_ms=50 * HOUR)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r["n"] for r in parts) == 400 and len(parts) > 3


@pytest.mark.parametrize("length", [1, 5, 64])
def test_positions_and_curves_in_blocks(spark, length):
    rnd = random.Random(length)
    rows = [("s", f"{k}", "1h", i * HOUR, rnd.random() < 0.3, rnd.random() < 0.3, rnd.random() < 0.2, rnd.uniform(90, 110)) for k in range(3) for i in range(130 if k else 1)]
    flags = spark.createDataFrame(rows, "source string, symbol string, timeframe string, timestamp long, long boolean, short boolean, exit boolean, close double").repartition(3)
    whole = positions.position(flags, True, True)
    cut = positions.position(flags, True, True, block_ms=length * HOUR)
    table = lambda df: sorted(tuple(r) for r in df.select(*KEYS, "timestamp", "position").collect())
    assert table(whole) == table(cut)
    a = positions.curve(cut).toPandas().sort_values([*KEYS, "timestamp"]).reset_index(drop=True)
    b = positions.curve(cut, block_ms=length * HOUR).toPandas().sort_values([*KEYS, "timestamp"]).reset_index(drop=True)
    for c in ("ret", "equity", "drawdown"):
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-11, atol=1e-12)


def test_bands_end_where_a_loop_says(spark):
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(1, 90)
        top = np.array([rnd.choice([rnd.uniform(5, 15), 10, 11, 10 - i / 20]) for i in range(n)])
        floor = np.array([np.nan if rnd.random() < 0.1 else rnd.uniform(0, 12) for _ in range(n)])
        exits = blocks.exits_of(top, floor)
        for u in [np.inf, *top.tolist(), *[rnd.uniform(0, 16) for _ in range(10)]]:
            want = u
            for t, f in zip(top, floor):  # noqa: B905
                want = t if want > t or want < f else want
            assert next((e["end"] for e in exits if u > e["top"] or u < e["floor"]), u) == want
    falling = np.linspace(20, 10, 500)
    assert len(blocks.exits_of(falling, np.full(500, 5.0))) == 1  # all ends agree


def test_lags_reach_over_blocks_of_one_bar(spark):
    df = blocks.with_block(bars(spark, range(1, 8)), 1)
    rows = blocks.lags(df, {"a": ("close", 1), "b": ("close", 3)}).orderBy("timestamp").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(None, None), (1, None), (2, None), (3, 1), (4, 2), (5, 3), (6, 4)]
