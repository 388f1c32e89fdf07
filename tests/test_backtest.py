import random

import pytest
from pyspark.sql import functions as F

from tests.bars import bars, column
from tidemark.operators import positions, series, strategies, sweep
from tidemark.operators.strategies import Binding, Strategy, check
from tidemark.schemas import KEYS


def with_signals(spark, closes, signals):
    rows = [("s", "x", "1h", t, kind, i) for i, (kind, t) in enumerate(signals)]
    table = spark.createDataFrame(rows, "source string, symbol string, timeframe string, timestamp long, type string, seq int")
    return positions.signals_to_bars(bars(spark, closes), table)


@pytest.mark.parametrize(
    ("closes", "signals", "cost", "expected", "hold"),
    [
        ([100, 110, 121], [], 0, [], 21),
        ([100, 110, 120, 130], [("BUY", 0), ("CLOSE", 2)], 0, [("LONG", 100, 120, 20)], 30),
        ([100, 110, 100, 90], [("BUY", 0), ("SELL", 1)], 0, [("LONG", 100, 110, 10), ("SHORT", 110, 90, 200 / 11)], -10),
        ([100, 110, 120], [("BUY", 0), ("BUY", 1)], 0, [("LONG", 100, 120, 20)], 20),
        ([100, 110], [("BUY", 0)], 0, [("LONG", 100, 110, 10)], 10),
        ([100, 100], [("BUY", 0), ("CLOSE", 1)], 100, [("LONG", 100, 100, -2)], 0),
        ([100, 110, 120], [("BUY", 1), ("SELL", 1), ("CLOSE", 1)], 0, [], 20),
    ],
)
def test_trades(spark, closes, signals, cost, expected, hold):
    p = with_signals(spark, closes, signals)
    got = positions.trades(p, cost).orderBy("entry_timestamp").collect()
    assert [(r["type"], r["entry_price"], r["exit_price"]) for r in got] == [x[:3] for x in expected]
    assert [r["pnl_percent"] for r in got] == pytest.approx([x[3] for x in expected])
    m = positions.backtest(p, cost).first()
    assert m["buy_hold"] == pytest.approx(hold) and m["total_trades"] == len(expected)


def test_no_trades(spark):
    m = positions.backtest(with_signals(spark, [100, 105], [])).first()
    assert (m["total_trades"], m["win_rate"], m["max_drawdown"], m["sharpe"], m["total_return"]) == (0, 0, 0, 0, 0)


def walk(flags, two_sided):
    at, out = 0, []
    for up, down, leave in flags:
        if at == 0:
            at = 1 if up else -1 if down else 0
        elif leave:
            at = 0
        elif two_sided and (down if at > 0 else up):
            at = -at
        out.append(at)
    return out


@pytest.mark.parametrize(("sides", "exits"), [("long", True), ("short", True), ("both", False), ("both", True), ("long", False)])
def test_positions_against_a_walk(spark, sides, exits):
    rnd, rows, expected = random.Random(f"{sides}{exits}"), [], []
    for k in range(40):
        length = 60 if k else 1500  # one series much longer than the others
        flags = [(sides != "short" and rnd.random() < 0.3, sides != "long" and rnd.random() < 0.3, exits and rnd.random() < 0.3) for _ in range(length)]
        rows += [("s", f"{k:03}", "1h", i, *f) for i, f in enumerate(flags)]
        expected += walk(flags, sides == "both")
    rnd.shuffle(rows)
    flags = spark.createDataFrame(rows, "source string, symbol string, timeframe string, timestamp long, long boolean, short boolean, exit boolean")
    for parts in (1, 7):
        assert column(positions.position(flags.repartition(parts), sides == "both", exits), "position") == expected


def test_strategy_signals(spark):
    run = lambda s, closes: [(r["type"], r["timestamp"]) for r in positions.signals(bars(spark, closes).transform(strategies.evaluate_strategy(s))).orderBy("timestamp").collect()]
    assert run(Strategy("a", "BUY", ("close > 100",), ("close < 100",)), [90, 101, 99, 105]) == [("BUY", 1), ("CLOSE", 2), ("BUY", 3)]
    assert run(Strategy("a", "BOTH", ("close > 100", "close < 90")), [95, 105, 80, 95]) == [("BUY", 1), ("SELL", 2)]
    assert run(Strategy("a", "BOTH", ("close > 100",)), [95, 105, 80]) == [("BUY", 1)]
    assert isinstance(run(Strategy("m", "BUY", ("macd.histogram > 0",), bindings={"macd": Binding("MACD")}), list(range(100, 140))), list)


def test_checks():
    assert check(Strategy("a", "BUY", ())) == ("no entry conditions or trigger", [])
    assert check(Strategy("a", "BUY", ("foo > 1",)))[1] == ["foo"]
    assert check(Strategy("a", "BUY", ('state == "long"',)))[0].startswith("string comparison")
    assert check(Strategy("a", "BUY", ("macd > 0",), bindings={"macd": Binding("MACD")}))[1] == ["macd"]
    assert check(Strategy("a", "BUY", ("macd.histogram > 0",), bindings={"macd": Binding("MACD")})) == (None, [])
    assert check(Strategy("a", "BUY", ("rsi.value > 0",), bindings={"rsi": Binding("RSI")}))[1] == ["rsi.value"]
    assert check(Strategy("a", "BUY", ("close > lim",), parameters={"lim": 3, "flag": True})) == (None, [])


def test_score_equals_backtest(spark):
    rnd = random.Random(2)
    closes = [100.0]
    for _ in range(300):
        closes.append(closes[-1] * (1 + rnd.uniform(-0.03, 0.03)))
    df = bars(spark, closes, step=3_600_000)
    s = Strategy("x", "BOTH", ("ta.crossover(f, g)", "ta.crossunder(f, g)"), bindings={"f": Binding("EMA", {"period": 5}), "g": Binding("EMA", {"period": 12})})
    whole = positions.backtest(df.transform(strategies.evaluate_strategy(s))).first()
    trials = spark.createDataFrame([("x", 0, {"n": 5.0, "m": 12.0}), ("x", 1, {"n": 3.0, "m": 12.0}), ("other", 0, {})], "spec_id string, trial int, params map<string,double>")
    swept = Strategy("x", s.direction, s.conditions, (), {"f": Binding("EMA", {"period": "n"}), "g": Binding("EMA", {"period": "m"})}, {"n": 9.0, "m": 9.0})
    got = {r["trial"]: r for r in sweep.score_trials(df.withColumn("slice", F.lit("all")), [swept], trials).collect()}
    assert set(got) == {0, 1} and got[0]["trades"] == whole["total_trades"]
    for name in ("win_rate", "total_return", "max_drawdown", "sharpe"):
        assert got[0][name] == pytest.approx(whole[name])


def test_backtest_in_one_pass_equals_its_parts(spark):
    rnd = random.Random(4)
    df = bars(spark, [100 + rnd.uniform(-5, 5) for _ in range(200)], step=3_600_000).withColumn("position", (F.pmod(F.xxhash64("timestamp"), F.lit(3)) - 1).cast("int"))
    once = positions.backtest(df).first()
    curve = positions.drawdown(positions.equity(positions.bar_returns(df)))
    parts = positions.backtest_metrics(curve, positions.trades(df), series.bars_per_year(df)).first()
    for name in ("total_trades", "win_rate", "avg_pnl", "total_return", "max_drawdown", "sharpe"):
        assert once[name] == pytest.approx(parts[name]), name


def test_more_strategies_need_no_more_scans_or_shuffles(spark, tmp_path):
    bars(spark, range(60)).write.parquet(f"{tmp_path}/bars")
    df = spark.read.parquet(f"{tmp_path}/bars")

    def counts(n):
        many = [Strategy(f"s{k}", "BUY", ("close > a",), ("close < b",), {"a": Binding("SMA", {"period": 3 + k % 4}), "b": Binding("BB", {"period": 5})} if k % 2 else {"a": Binding("SMA", {"period": 4}), "b": Binding("SMA", {"period": 9})}) for k in range(n)]
        many = [Strategy(s.id, s.direction, s.conditions, ("close < b.lower",) if s.bindings["b"].type == "BB" else s.exits, s.bindings) for s in many]
        ranked = strategies.ranking(df, many)
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert ranked.count() == n
        return plan.count("Exchange hashpartitioning"), plan.count("FileScan")

    assert counts(2) == counts(12) and counts(2)[1] == 1


def test_strategies_of_a_spec_table(spark):
    from tidemark.jobs import queries

    ready = strategies.strategies_of(queries._records(spark))
    assert [s.id for s in ready] == ["a-strategy-with-a-long-name", "band-reversal", "sma-cross"]
    assert ready[0].bindings == {"sma10": Binding("SMA", {"period": 10.0}, "close")}
    found = {r["id"]: (r["ok"], r["missing"]) for r in strategies.assemblable(queries._records(spark)).collect()}
    assert found["unknown-type"] == (False, ["indicator:TSI", "tsi"]) and not found["quoted"][0]
    with pytest.raises(ValueError):
        strategies.strategies_of(queries._records(spark), most=2)


def test_sweep_draws_repeat_and_stay_in_range(spark):
    specs = spark.createDataFrame([("ema-cross", {"fastLength": 12.0, "slowLength": 26.0, "x": 0.0})], "spec_id string, parameters map<string,double>")
    draws = lambda seed: {r["trial"]: r["params"] for r in sweep.trial_grid(spark, specs, 50, seed).collect()}
    a = draws(1)
    assert a == draws(1) != draws(2) and a[-1] == {"fastLength": 12.0, "slowLength": 26.0, "x": 0.0}
    assert all(5 <= p["fastLength"] <= 30 and p["fastLength"] % 1 == 0 and p["x"] == 0 for t, p in a.items() if t >= 0)


def test_split_and_windows(spark):
    assert column(series.train_test_split(bars(spark, [1, 2, 3, 4])), "slice") == ["train", "train", "test", "test"]
    assert series.train_test_split(bars(spark, [1])).count() == 0
    year = 31_557_600_000
    df = bars(spark, range(1, 8), step=year)
    assert [r["years"] for r in series.window_list(df).orderBy("years").collect()] == [3, 5, 6]
    assert series.window_slice(df, 3).count() == 4
    assert series.bars_per_year(bars(spark, [1, 2])).first()["bars_per_year"] == 252
    assert series.bars_per_year(bars(spark, [1, 2, 3], step=0)).first()["bars_per_year"] == pytest.approx(8766)


def test_one_shuffle_for_all_windows(spark):
    from tidemark.operators import indicators

    df = indicators.bollinger(indicators.sma(indicators.wma(bars(spark, range(50)))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(source") == 1, plan
    assert set(KEYS) <= set(df.columns)
