import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.bars import bars, column
from tidemark.operators import indicators, recursive
from tidemark.operators.strategies import Binding, compose


def naive_mean(x, n, alpha, wilder):
    """A plain loop for the running means."""
    out, at = [None] * len(x), None
    start = next((i for i, v in enumerate(x) if v is not None), len(x))
    for i in range(start, len(x)):
        if wilder:
            if i == start + n - 1:
                at = sum(x[start : i + 1]) / n
            elif i >= start + n:
                at = at + (x[i] - at) / n
            out[i] = at
        else:
            at = x[i] if i == start else alpha * x[i] + (1 - alpha) * at
            out[i] = at if i >= start + n - 1 else None
    return out


@pytest.fixture(scope="module")
def closes():
    rnd = np.random.default_rng(3)
    return (100 * np.exp(np.cumsum(rnd.normal(0, 0.02, 120)))).tolist()


def same(got, expected):
    assert [g is None for g in got] == [e is None for e in expected]
    assert [g for g in got if g is not None] == pytest.approx([e for e in expected if e is not None])


def test_running_means(spark, closes):
    df = recursive.recursive_indicators(bars(spark, closes), [("EMA", {"period": 9}, "close", "e"), ("rma", {"period": 5}, "close", "r"), ("RSI", {}, "close", "rsi")])
    same(column(df, "e"), naive_mean(closes, 9, 0.2, False))
    same(column(df, "r"), naive_mean(closes, 5, None, True))
    steps = [None, *(b - a for a, b in zip(closes, closes[1:], strict=False))]
    up = naive_mean([None if s is None else max(s, 0) for s in steps], 14, None, True)
    down = naive_mean([None if s is None else max(-s, 0) for s in steps], 14, None, True)
    same(column(df, "rsi"), [None if u is None else 100 - 100 / (1 + u / d) for u, d in zip(up, down, strict=True)])


def test_rsi_facts(spark):
    got = column(recursive.recursive_indicators(bars(spark, range(100, 130), spread=1, volume=100.0), [("RSI", {"period": 14}, "close", "r")]), "r")
    assert got[0] is None and got[13] is None and got[14] == 100 and len(got) == 30


def test_source_and_order_of_bindings(spark, closes):
    binds = {"twice": Binding("EMA", {"period": 5}, "double"), "once": Binding("EMA", {"period": 5}), "of": Binding("SMA", {"period": 3}, "once")}
    df = compose(bars(spark, closes).withColumn("double", F.col("close") * 2), binds)
    assert column(df, "twice")[4:] == pytest.approx([2 * x for x in column(df, "once")[4:]])
    assert column(df, "of")[5] is None and column(df, "of")[6] is not None
    with pytest.raises(ValueError, match="circle"):
        compose(df, {"a": Binding("SMA", {}, "b"), "b": Binding("SMA", {}, "a")})


def test_outputs(spark, closes):
    df = compose(bars(spark, closes, spread=1), {"bb": Binding("bb", {"stdDev": 2}), "m": Binding("MACD"), "s": Binding("STOCH"), "t": Binding("SUPERTREND")})
    assert {"bb__lower", "bb__middle", "bb__upper", "m__histogram", "m__macd", "m__signal", "s__stochD", "s__stochJ", "s__stochK", "t__value", "t__dir"} <= set(df.columns)
    with pytest.raises(ValueError, match="unknown"):
        recursive.compute("NOPE", {}, pd.DataFrame({"close": [1.0], "high": [1.0], "low": [1.0]}), "close")


def test_missing_values_empty_the_frame(spark):
    df = bars(spark, [1, 2, 3, 4, 5]).withColumn("close", F.when(F.col("timestamp") != 2, F.col("close")))
    assert column(indicators.sma(df, 2), "sma") == [None, 1.5, None, None, 4.5]
    assert column(indicators.stddev(df, 2), "stddev")[1] == 0.5


def test_results_do_not_depend_on_partitions(spark, closes):
    one, many = bars(spark, closes).coalesce(1), bars(spark, closes).repartition(9)
    f = lambda d: column(indicators.cci(recursive.recursive_indicators(d, [("ADX", {}, "close", "a")])), "a")
    assert f(one) == f(many)


LONG_KINDS = ["sma", "stddev", "highest", "lowest", "wma", "hma", "bollinger", "vwma"]


def test_long_periods_equal_sliding_frames(spark, closes, monkeypatch):
    missing = (17, 64, 65)
    df = bars(spark, closes).withColumns({"close": F.when(~F.col("timestamp").isin(*missing), F.col("close")), "volume": F.col("timestamp") % 7 + 1.0}).cache()
    for period in (3, 10, 54, 55, 200):
        found = []
        for longest in (0, 10**6):
            monkeypatch.setattr(indicators, "LONG", longest)
            out = df
            for kind in LONG_KINDS:
                out = getattr(indicators, kind)(out, period, name=kind)
            found.append(out.orderBy("timestamp").toPandas().drop(columns=["close"]))
        assert list(found[0].columns) == list(found[1].columns)
        for c in found[0].columns[len(df.columns) - 1 :]:
            same([None if pd.isna(v) else v for v in found[0][c]], [None if pd.isna(v) else v for v in found[1][c]])
    df.unpersist()


def test_long_periods_do_not_slide(spark, closes):
    df = bars(spark, closes)
    for kind in LONG_KINDS:
        plan = getattr(indicators, kind)(df, 4 * indicators.LONG if kind != "hma" else 10_000, name=kind)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan
        assert not re.search(r"RowFrame, -\d+, currentrow", plan)
