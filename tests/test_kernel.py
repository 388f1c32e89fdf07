"""Trials as rows: the numpy kernel against the windows of the plan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.bars import bars
from tidemark.functions import arrays
from tidemark.operators import strategies, sweep
from tidemark.operators.strategies import Binding, Strategy

RULES = (
    ("close > x", "close < x"),
    ("x > x[1] and not (close > 101)[2]", "ta.cross(close, x)"),
    ("ta.crossover(close, x) or bar_index == 7", "ta.crossunder(close, x)"),
    ("nz(x, 100) - close > 0.5 * lim", "math.abs(x - close) / (close - 100) > lim"),
    ("min(x, close) != max(x, hl2) and x * 0 == 0", "na > 1 or math.sign(close - x) < 0"),
)
KINDS = ["SMA", "WMA", "HMA", "STDDEV", "HIGHEST_HIGH", "LOWEST_LOW", "BB", "ROC", "MOM", "TR", "VWAP", "VWMA", "CCI", "STOCH", "EMA", "RMA", "RSI", "ATR", "ADX", "MACD", "SUPERTREND"]
FIELD = {"BB": "upper", "STOCH": "stochJ", "MACD": "histogram", "SUPERTREND": "value"}


def walk(spark, n, seed, symbol="x"):
    rnd, x = random.Random(seed), 100.0
    closes = [x := x * (1 + rnd.uniform(-0.03, 0.03)) for _ in range(n)]
    return bars(spark, closes, symbol, spread=0.7, step=3_600_000)


def many():
    out = []
    for k, kind in enumerate(KINDS):
        for direction, exits in (("BOTH", ()), ("BUY", ("close < 99",)), ("BOTH", ("bar_index == 40 or close > 104",)), ("SELL", ("close < 99",))):
            rules = [re.sub(r"\bx\b", f"x.{FIELD[kind]}" if kind in FIELD else "x", r) for r in RULES[(k + len(exits)) % len(RULES)]]
            out.append(Strategy(f"{kind}-{direction}-{len(exits)}", direction, tuple(rules), exits, {"x": Binding(kind, {"period": "n", "k": 5}), "y": Binding("SMA", {"period": 3}, f"x.{FIELD[kind]}" if kind in FIELD else "x")}, {"n": 6.0, "lim": 1.0}))
    return out


def test_kernel_equals_the_windows(spark):
    df = walk(spark, 120, 1).unionByName(walk(spark, 9, 2, "short")).unionByName(walk(spark, 1, 3, "one"))
    given = many()
    native = strategies.backtest_jobs(df, [strategies.Job(s, (("spec_id", s.id),)) for s in given])
    trials = spark.createDataFrame([(s.id, 0, s.parameters) for s in given], "spec_id string, trial int, params map<string,double>")
    got = {(r["symbol"], r["spec_id"]): r for r in sweep.score_trials(df.withColumn("slice", F.lit("all")), given, trials).collect()}
    want = native.collect()
    assert len(want) == len(got) == 3 * len(given) and sum(r["total_trades"] > 3 for r in want) > 20
    for r in want:
        g = got[r["symbol"], r["spec_id"]]
        assert g["trades"] == r["total_trades"], r
        for name in ("win_rate", "total_return", "max_drawdown", "sharpe"):
            assert g[name] == pytest.approx(r[name], rel=1e-9, abs=1e-9), (name, r)


def test_spec_table_and_blocks(spark, monkeypatch):
    from tidemark.jobs import queries

    monkeypatch.setattr(sweep, "TRIALS", 3)
    df = walk(spark, 200, 4).withColumn("slice", F.lit("all"))
    records = queries._records(spark)
    trials = spark.createDataFrame([(i, t, {"fastLength": float(t + 3)} if i == "sma-cross" else None) for i in ("sma-cross", "band-reversal", "quoted", "nowhere") for t in range(-1, 8)], "spec_id string, trial int, params map<string,double>")
    got = sorted(tuple(r) for r in sweep.score_trials(df, records, trials).collect())
    monkeypatch.setattr(sweep, "BROADCAST_TRIALS", 0)
    assert got == sorted(tuple(r) for r in sweep.score_trials(df, strategies.strategies_of(records), trials).collect())
    assert {r[4] for r in got} == {"sma-cross", "band-reversal"} and len(got) == 18 and len({r[6] for r in got}) > 3


def test_plan_does_not_grow_with_trials(spark, tmp_path):
    from tidemark.jobs import queries

    walk(spark, 300, 5).write.parquet(f"{tmp_path}/bars")
    df = spark.read.parquet(f"{tmp_path}/bars").withColumn("slice", F.lit("all"))
    specs = spark.createDataFrame([(s.id, s.parameters) for s in queries.SWEPT], "spec_id string, parameters map<string,double>")

    def plan(n):
        out = sweep.score_trials(df, queries.SWEPT, sweep.trial_grid(spark, specs, n, seed=7))
        text = out._jdf.queryExecution().executedPlan().toString()
        return out, text.count("Exchange hashpartitioning"), text.count("FileScan"), text.count("\n")

    few, many_ = plan(12), plan(2000)
    assert few[1:] == many_[1:] and few[2] == 1
    assert many_[0].count() == 2 * 2001


def test_own_indicator_in_a_sweep(spark):
    from tidemark.operators import recursive

    recursive.register_indicator("HALVES", lambda bars, x, p: {"up": x * p.get("f", 2), "down": x / 2}, ("up", "down"))
    s = Strategy("own", "BUY", ("close > h.down * f",), ("close < m",), {"h": Binding("HALVES", {"f": "f"}), "m": Binding("SMA", {"period": 4}, "h.down")}, {"f": 2.0})
    trials = spark.createDataFrame([("own", k, {"f": 1.9 + k / 10}) for k in range(3)], "spec_id string, trial int, params map<string,double>")
    got = sweep.score_trials(walk(spark, 60, 6).withColumn("slice", F.lit("all")), [s], trials).collect()
    assert len(got) == 3 and {r["trial"]: r["trades"] for r in got}[0] >= 1


def test_own_columns_take_one_shuffle(spark, tmp_path):
    from tidemark.functions.rules import window

    strategies.register_columns("LEAST", lambda x, keys, period: F.min(x).over(window(keys).rowsBetween(1 - period, 0)), {"period": 3})
    walk(spark, 50, 7).write.parquet(f"{tmp_path}/bars")
    df = strategies.compose(spark.read.parquet(f"{tmp_path}/bars"), {"a": Binding("LEAST", {"period": 4}), "b": Binding("SMA", {"period": 4}, "a")})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and df.filter("a <= close AND b IS NOT NULL").count() == 47
    trials = spark.createDataFrame([("s", 0, None)], "spec_id string, trial int, params map<string,double>")
    with pytest.raises(Exception, match="no type over arrays"):
        sweep.score_trials(df.withColumn("slice", F.lit("x")), [Strategy("s", "BUY", ("close > a",), (), {"a": Binding("LEAST")})], trials).collect()


def test_composed_transitions_equal_a_walk():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 65, 1000):
        up, down, leave = (rnd.random(n) < p for p in (0.3, 0.3, 0.2))
        at, want = 0, []
        for u, d, x in zip(up, down, leave):  # noqa: B905
            at = (1 if u else -1 if d else 0) if at == 0 else 0 if x else -at if (d if at > 0 else u) else at
            want.append(at)
        assert arrays.walked(up, down, leave).tolist() == want


def test_rolling_cost_does_not_depend_on_the_period():
    import numpy as np

    x = np.random.default_rng(2).random(5000) + 100
    for n in (1, 2, 20, 500, 4999, 5001):
        for f, brute in ((arrays.sma, np.mean), (arrays.stddev, np.std), (arrays.highest, np.max), (arrays.lowest, np.min), (arrays.wma, lambda w: (w * np.arange(1, len(w) + 1)).sum() / (len(w) * (len(w) + 1) / 2))):
            got = f(x, n)
            assert np.isnan(got[: n - 1]).all()
            for i in range(n - 1, 5000, 997):
                assert got[i] == pytest.approx(brute(x[i - n + 1 : i + 1]), rel=1e-11, abs=1e-11), (f, n)
