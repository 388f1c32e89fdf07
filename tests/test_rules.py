import pytest

from tests.bars import bars, column
from tidemark.functions.rules import RuleError, rule_filter, rule_identifiers, unknown_calls


def holds(spark, rule, closes=(1, 2, 3, 4, 5), **kw):
    return [int(x) for x in column(rule_filter(bars(spark, list(closes), **kw), rule), "signal")]


@pytest.mark.parametrize(
    ("rule", "expected"),
    [
        ("close > 3", [0, 0, 0, 1, 1]),
        ("close > close[1]", [0, 1, 1, 1, 1]),
        ("close > 4 or close < 2 and not (close == 3)", [1, 0, 0, 0, 1]),
        ("nz(close[2], -1) > 0", [0, 0, 1, 1, 1]),
        ("not (close > 3)[1]", [0, 1, 1, 1, 0]),
        ("close != na", [0] * 5),
        ("not (na > 1)", [1] * 5),
        ("not na", [0] * 5),
        ("not close > 3", [0] * 5),
        ("-close < -3", [0, 0, 0, 1, 1]),
        ("min(close, na) < 9", [0] * 5),
        ("math.max(close, 3) == 3", [1, 1, 1, 0, 0]),
        ("close / 0 > 5", [1] * 5),
        ("(close - close) / 0 > 5", [0] * 5),
        ("math.sign(close - 3) + 1", [0, 0, 1, 1, 1]),
        ("(close > 2) + (close > 3) == 2", [0, 0, 0, 1, 1]),
        ("bar_index >= 3 and barstate.isconfirmed", [0, 0, 0, 1, 1]),
        ("ta.cross(close[2], 0)", [0, 0, 1, 0, 0]),
        ("abs(close - 3) <= 1", [0, 1, 1, 1, 0]),
    ],
)
def test_rule(spark, rule, expected):
    assert holds(spark, rule) == expected


def test_crosses(spark):
    assert holds(spark, "ta.crossover(close, open)", [1, 2, 5, 4, 3], opens=3) == [0, 0, 1, 0, 0]
    assert holds(spark, "ta.crossunder(close, open)", [5, 4, 1, 2, 3], opens=3) == [0, 0, 1, 0, 0]


@pytest.mark.parametrize("rule", ["close >", "(close > 1", "close $ 1", "close[x]", "min(close)", "foo > 1", "math.floor(close) > 1", "close 1"])
def test_bad_rules(spark, rule):
    with pytest.raises(RuleError):
        holds(spark, rule)


def test_names():
    assert rule_identifiers("rsi > 70 and close > sma") == ["rsi", "sma"]
    assert rule_identifiers("bb.upper > close or hl2 > na and barstate.islast") == ["bb.upper"]
    assert unknown_calls("math.floor(close) > nz(x)") == ["math.floor"]
