import json

import pytest
from pyspark.sql import functions as F

from tests.bars import bars
from tidemark.functions import scalars
from tidemark.operators import corpus, indicators
from tidemark.functions import script_text
from tidemark.functions.script_text import frame_strategy
from tidemark.schemas import SPEC
from tidemark.sources import candles, specs


def test_read_candles(spark, tmp_path):
    bar = {"timestamp": 1, "open": 1, "high": 2, "low": 0.5, "close": 1.5, "volume": 3}
    (tmp_path / "binance_BTCUSDT_1h_2020-01-01_2020-02-01.json").write_text(json.dumps([bar, bar | {"timestamp": 2}]))
    rows = candles.read_candles(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r["source"], r["symbol"], r["timeframe"], r["timestamp"]) for r in rows] == [("binance", "BTCUSDT", "1h", 1), ("binance", "BTCUSDT", "1h", 2)]
    (tmp_path / "x_Y_1h.json").write_text(json.dumps([{k: v for k, v in bar.items() if k != "close"}]))
    with pytest.raises(Exception, match="lacks a field"):
        candles.read_candles(spark, str(tmp_path)).collect()


def chart(times, error=None, **quote):
    result = [{"timestamp": times, "indicators": {"quote": [quote]}}] if times else None
    return json.dumps({"chart": {"result": result, "error": error}})


def test_chart_json(spark):
    body = chart([10, 20, 30], open=[1, None, 3], high=[1, 2, 3], low=[1, 2, 3], close=[1, 2, 3], volume=[5, 6, None])
    rows = candles.parse_chart_json(spark.createDataFrame([(body,)], "body string")).orderBy("timestamp").collect()
    assert [(r["timestamp"], r["volume"]) for r in rows] == [(10_000, 5.0), (30_000, 0.0)]
    for text, error in (("no such symbol", {"description": "no such symbol"}), ("empty chart response", None)):
        with pytest.raises(Exception, match=text):
            candles.parse_chart_json(spark.createDataFrame([(chart([], error),)], "body string")).collect()


def test_specs_and_results(spark, tmp_path):
    good = {"id": "a", "name": "A", "source": "u", "strategyType": "condition", "entry": {"direction": "BUY", "conditions": ["close > 1"]}, "parameters": {"n": 5, "flag": True}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    row = specs.read_specs(spark, str(tmp_path / "a.json")).first()
    assert (row["version"], row["assetClass"], row["parsedBy"], row["confidence"], row["parameters"]["flag"]) == ("1", "any", "static", 1.0, "true")
    for k, bad in enumerate(({"strategyType": "odd"}, {"entry": {}}, {"confidence": 2})):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(good | bad))
        with pytest.raises(Exception, match="bad strategy record"):
            specs.read_specs(spark, str(tmp_path / f"bad{k}.json")).collect()
    parsed = spark.createDataFrame([(json.dumps(good),)], "t string").select(specs.parse_spec(F.col("t")).alias("s")).select("s.*")
    assert parsed.schema == SPEC
    old = parsed.withColumn("createdAt", F.lit(7).cast("long"))
    specs.write_specs(parsed.withColumn("createdAt", F.lit(9).cast("long")), old, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first()["createdAt"] == 7


def test_write_results(spark, tmp_path):
    from tidemark.operators import positions

    p = bars(spark, [100, 110, 100, 120]).withColumn("position", F.lit(1))
    name = lambda d: d.withColumn("spec_id", F.lit("z"))
    specs.write_results(name(positions.backtest(p)), name(positions.trades(p)), f"{tmp_path}/r")
    row = specs.read_results(spark, f"{tmp_path}/r").first()
    assert row["market"] == "x" and row["timeframe"] == "1h" and len(row["trades"]) == 1


@pytest.mark.parametrize(("name", "slug"), [("My Strategy! v2.0", "my-strategy-v2-0"), ("  --Weird--Name--  ", "weird-name"), ("a" * 100, "a" * 50), ("!!!", "")])
def test_slug(spark, name, slug):
    assert spark.createDataFrame([(name,)], "n string").select(scalars.slugify(F.col("n"))).first()[0] == slug


def test_formats(spark):
    rows = spark.createDataFrame([(12.34, 12.6), (-4.5, -4.4), (0.0, 0.0)], "a double, b double").select(scalars.pct(F.col("a")), scalars.ipct(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("+12.3%", "+13%"), ("−4.5%", "−4%"), ("+0.0%", "+0%")]


def test_calls_are_balanced():
    found = script_text.calls('f(ta.crossover(a, b[1, 2]), "x, (y") // g(1)\nh(when = k(1), z')
    assert [(c.name, c.args) for c in found] == [("f", ("ta.crossover(a, b[1, 2])", '"x, (y"')), ("ta.crossover", ("a", "b[1, 2]")), ("k", ("1",))]
    assert script_text.calls("h(1, when = a > b)")[0].named("when") == "a > b"
    assert script_text.without_switches("showSignals and a > b  and hideX") == "a > b" and script_text.without_switches("showSignals") == "showSignals"
    assert script_text.unwrapped("((a) and (b))") == "(a) and (b)" and script_text.unwrapped(" (((x))) ") == "x" and script_text.unwrapped("") == ""


def test_entries_and_bindings():
    text = "len = input.int(3)\nm = long ? ta.ema(close, len) : 0\nn = request.security(s, 'D', ta.sma(close, 9))\ngo = alias\nalias = m > n and\n  showIt\nalertcondition(go, 'long')\nalertcondition(condition)"
    direction, conditions = script_text.entry_of(text)
    assert (direction, conditions) == ("BOTH", ["m > n", "condition"])
    assert script_text.bindings_of(text, conditions, {"len"}, {"ema": "EMA", "sma": "SMA"}) == [("m", "EMA", "len"), ("n", "SMA", "9")]
    assert script_text.entry_of("x = 1") == ("BOTH", [])


CLASS = """class Mine(IStrategy):
    timeframe = '5m'
    stoploss = -0.05
    buy_params = {'cci': -48}
    n = IntParameter(1, 50, default=7, space='buy')
    mode = CategoricalParameter([1, 2], default=2)
    def populate_indicators(self, dataframe, metadata):
        dataframe['adx'] = ta.ADX(dataframe)
        dataframe['short'] = ta.SMA(dataframe, timeperiod=3)
        bollinger = qtpylib.bollinger_bands(qtpylib.typical_price(dataframe), window=33, stds=3)
        dataframe['bb_low'] = bollinger['lower']
        return dataframe
    def populate_entry_trend(self, dataframe, metadata):
        dataframe.loc[(%s), 'enter_long'] = 1
"""


@pytest.mark.parametrize(
    ("rule", "entry", "reason"),
    [
        ("(dataframe['adx'] > 25) & (qtpylib.crossed_above(dataframe['short'], dataframe['close']))", "(adx > 25) and (ta.crossover(short, close))", None),
        ("dataframe['close'] < dataframe['bb_low']", "close < bb.lower", None),
        ("dataframe['adx'] > dataframe['adx'].shift(1)", "adx > adx[1]", None),
        ("dataframe['adx'] > self.cci.value", "adx > cci", None),
        ("dataframe['adx'] > dataframe['adx'].shift()", "adx > adx[1]", None),
        ("dataframe['adx'] > dataframe['adx'].shift(self.n.value)", None, "unsupported call adx.shift"),
        ("dataframe['a'] > 1), 'other'] = 1\n        dataframe.loc[(dataframe['a'] > 1", None, "unconditional or multi-block"),
        ("reduce(lambda x, y: x & y, c)", None, "unsupported call reduce"),
        ("np.where(adx) > 1", None, "unsupported call np.where"),
        ("dataframe['a-b'] > 1", None, "untranslated dataframe expression"),
    ],
)
def test_frame_strategy(rule, entry, reason):
    out = frame_strategy(CLASS % rule)
    assert out["skip_reason"] == reason
    if not reason:
        assert (out["entry"], out["timeframe"], out["stop_loss"], out["parameters"]) == (entry, "5m", "-0.05", {"cci": "-48", "n": "7", "mode": "2"})
        assert {b["name"]: (b["type"], b["params"]) for b in out["bindings"]} == {"adx": ("ADX", {}), "short": ("SMA", {"period": "3"}), "bb": ("BB", {"period": "33", "stdDev": "3"})}


def test_frame_strategy_skips():
    assert frame_strategy("x = 1")["skip_reason"] == "no strategy class"
    assert frame_strategy("class A(IStrategy):\n  pass")["skip_reason"] == "missing populate methods"
    assert frame_strategy("")["skip_reason"] == "no strategy class"


def test_candle_table(spark, tmp_path):
    """Windows over a bucketed table have no exchange, a range of dates reaches the scan, and the values are those of the candles."""
    rows_of = bars(spark, range(1, 60), "a").unionByName(bars(spark, range(100, 190), "b")).unionByName(bars(spark, range(5), "c"))
    table = candles.write_candle_table(rows_of, "candle_table_test", 4, f"file://{tmp_path}/table")
    try:
        plan = indicators.sma(table, 5)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert "Exchange" in indicators.sma(rows_of, 5)._jdf.queryExecution().executedPlan().toString()
        rows = lambda df: sorted(map(tuple, indicators.sma(df.select(rows_of.columns), 5).collect()))
        assert repr(rows(table)) == repr(rows(rows_of)) and table.count() == 154
        some = candles.date_range(table, 10, 20)
        assert "GreaterThanOrEqual(timestamp,10)" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 20
        assert len(list((tmp_path / "table").glob("*.parquet"))) <= 4
        candles.write_candle_table(rows_of.filter("symbol = 'c'"), "candle_table_test", 4, f"file://{tmp_path}/table")
        assert spark.table("candle_table_test").count() == 5
    finally:
        spark.sql("DROP TABLE IF EXISTS candle_table_test")
