"""Rules, bounded indicators, positions and metrics of one series as numpy arrays, for jobs whose parameters are rows and not part of the plan.

The values are those of `rules`, `indicators` and `positions`, with NaN for missing. No cost depends on the period but that of CCI: sums and extrema are
those of blocks' beginnings and ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tidemark.functions.rules import _PRICES, CALLS, Rule
from tidemark.functions.scalars import YEAR_MS

#: Gaps of so many first bars tell the length of a bar.
GAPS = 200


@dataclass(frozen=True)
class Values:
    """Numbers (NaN is missing) or truth values of each bar."""

    array: np.ndarray
    truth: bool = False

    @property
    def number(self) -> np.ndarray:
        return self.array.astype(float) if self.truth else self.array

    @property
    def bool(self) -> np.ndarray:
        return self.array if self.truth else self.array > 0.5


def lagged(x: np.ndarray, n: int) -> np.ndarray:
    """x of n bars before."""
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]]) if n else x


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    infinite = np.where(a > 0, np.inf, np.where(a < 0, -np.inf, np.nan))
    return np.where(b == 0, infinite, a / b)


class ArrayRule(Rule):
    """A rule over n bars; `resolve` gives the numbers of a name, or None where it has none."""

    def __init__(self, text: str, resolve: Callable[[str], np.ndarray | None], n: int):
        super().__init__(text)
        self.resolve, self.n = resolve, n

    def literal(self, value: float) -> Values:
        return Values(np.full(self.n, value))

    def opposite(self, x: Values) -> Values:
        return Values(~x.array if x.truth else x.array <= 0.5, True)

    def negative(self, x: Values) -> Values:
        return Values(-x.number)

    def before(self, x: Values, n: int) -> Values:
        return Values(lagged(x.number, n))

    def name(self, word: str) -> Values:
        if word == "na":
            return self.literal(np.nan)
        if word.startswith("barstate."):
            return self.literal(1.0)
        if word == "bar_index":
            return Values(np.arange(self.n, dtype=float))
        found = self.resolve(word)
        if found is None:
            self.names.append(word)
        return self.literal(np.nan) if found is None else Values(found)

    def join(self, op: str, a: Values, b: Values) -> Values:
        if op in ("and", "or"):
            return Values(a.bool & b.bool if op == "and" else a.bool | b.bool, True)
        x, y = a.number, b.number
        tests = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal}
        if op in tests:
            return Values(tests[op](x, y), True)
        if op == "!=":
            return Values((x < y) | (x > y), True)
        return Values(_divided(x, y) if op == "/" else {"+": np.add, "-": np.subtract, "*": np.multiply}[op](x, y))

    def call(self, name: str, args: list[Values]) -> Values:
        if name not in CALLS:
            return self.literal(np.nan)
        x = [a.number for a in args]
        if name == "ta.cross":
            above = x[0] > x[1]
            return Values(np.concatenate([[False], above[1:] != above[:-1]])[: self.n], True)
        if name.startswith("ta."):
            a, b = x if name == "ta.crossover" else x[::-1]
            return Values((a > b) & (lagged(a, 1) <= lagged(b, 1)), True)
        if name == "nz":
            return Values(np.where(np.isnan(x[0]), x[1] if len(x) > 1 else 0.0, x[0]))
        if name == "barstate.isconfirmed":
            return self.literal(1.0)
        return Values({"abs": np.abs, "sign": np.sign, "min": np.minimum, "max": np.maximum}[name.removeprefix("math.")](*x))


def any_rule(rules: list[str] | tuple[str, ...], resolve: Callable[[str], np.ndarray | None], n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    with np.errstate(all="ignore"):
        for r in rules:
            out |= ArrayRule(r, resolve, n).value().bool
    return out


def resolver(bars: dict[str, np.ndarray], names: dict[str, np.ndarray | float], n: int) -> Callable[[str], np.ndarray | None]:
    """Names first, then prices and typical prices."""

    def resolve(name: str) -> np.ndarray | None:
        if name in names:
            return np.broadcast_to(np.asarray(names[name], float), (n,))
        return price(bars, name)

    return resolve


def price(bars: dict[str, np.ndarray], name: str) -> np.ndarray | None:
    if name in _PRICES:
        return bars[name]
    if name in ("hl2", "hlc3", "ohlc4"):
        own = {"hl2": ("high", "low"), "hlc3": ("high", "low", "close"), "ohlc4": ("open", "high", "low", "close")}[name]
        return sum(bars[c] for c in own) / len(own)
    return None


# Bounded indicators.


def rolling_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the last n values, or of all where there are fewer; nothing is missing. A window is the end of one block of n and the beginning of the next, whose
    running sums have few terms, so what is lost in adding doesn't grow with the series."""
    cut = np.concatenate([x.astype(np.longdouble), np.zeros(-len(x) % n, np.longdouble)]).reshape(-1, n)
    begin, end = np.cumsum(cut, 1).ravel()[: len(x)], np.cumsum(cut[:, ::-1], 1)[:, ::-1].ravel()
    start = np.arange(len(x)) - n + 1
    return begin + np.where((start > 0) & (start % n > 0), end[np.maximum(start, 0)], 0)


def _full(x: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    seen = rolling_sum(~np.isnan(x), n)
    return np.where(seen == n, value, np.nan).astype(float)


def _origin(x: np.ndarray) -> tuple[np.ndarray, float]:
    """x less its first value, missing as 0, and that value: a flat series has sums of exactly 0."""
    seen = x[~np.isnan(x)]
    at = float(seen[0]) if len(seen) else 0.0
    return np.nan_to_num(x - at), at


def sma(x: np.ndarray, n: int) -> np.ndarray:
    moved, at = _origin(x)
    return _full(x, rolling_sum(moved, n) / n + at, n)


def stddev(x: np.ndarray, n: int) -> np.ndarray:
    moved, _ = _origin(x)
    mean = rolling_sum(moved, n) / n
    spread = np.sqrt(np.maximum(rolling_sum(moved.astype(np.longdouble) ** 2, n) / n - mean**2, 0))
    return _full(x, np.where(highest(x, n) == lowest(x, n), 0, spread), n)


def wma(x: np.ndarray, n: int) -> np.ndarray:
    """Weights 1 to n: the sum of (i - start) * x is that of i * x less start times that of x."""
    moved, at = _origin(x)
    i = np.arange(len(x), dtype=np.longdouble)
    total = rolling_sum(moved * (i + 1), n) - (i + 1 - n) * rolling_sum(moved, n)
    return _full(x, total / (n * (n + 1) / 2) + at, n)


def hma(x: np.ndarray, n: int) -> np.ndarray:
    half, root = int(n / 2 + 0.5), int(n**0.5 + 0.5)
    return wma(2 * wma(x, half) - wma(x, n), root)


def highest(x: np.ndarray, n: int) -> np.ndarray:
    """Largest of the last n values: the greater of a block's beginning up to here and of the block's end before from there."""
    pad = -len(x) % n
    cut = np.concatenate([np.nan_to_num(x, nan=-np.inf), np.full(pad, -np.inf)]).reshape(-1, n)
    begin, end = np.maximum.accumulate(cut, 1).ravel(), np.maximum.accumulate(cut[:, ::-1], 1)[:, ::-1].ravel()
    out = np.full(len(x), np.nan)
    out[n - 1 :] = np.maximum(begin[n - 1 : len(x)], end[: max(0, len(x) - n + 1)])
    return _full(x, out, n)


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    return -highest(-x, n)


def true_range(bars: dict[str, np.ndarray]) -> np.ndarray:
    before = lagged(bars["close"], 1)
    return np.fmax(bars["high"] - bars["low"], np.fmax(np.abs(bars["high"] - before), np.abs(bars["low"] - before)))


def vwap(bars: dict[str, np.ndarray]) -> np.ndarray:
    volume = np.cumsum(bars["volume"])
    return np.where(volume != 0, np.cumsum(price(bars, "hlc3") * bars["volume"]) / volume, np.nan)


def vwma(bars: dict[str, np.ndarray], n: int) -> np.ndarray:
    volume = rolling_sum(bars["volume"], n)
    return _full(bars["close"], np.where(volume != 0, rolling_sum(bars["close"] * bars["volume"], n) / volume, np.nan), n)


def cci(bars: dict[str, np.ndarray], n: int) -> np.ndarray:
    x = price(bars, "hlc3")
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        frames, mean = np.lib.stride_tricks.sliding_window_view(x, n), sma(x, n)[n - 1 :]
        spread = np.concatenate([np.abs(frames[i : i + 4096] - mean[i : i + 4096, None]).mean(axis=1) for i in range(0, len(frames), 4096)])
        out[n - 1 :] = np.where(spread != 0, (x[n - 1 :] - mean) / (0.015 * spread), np.nan)
    return out


def stoch(bars: dict[str, np.ndarray], k: int, slow: int, d: int) -> dict[str, np.ndarray]:
    low, high = lowest(bars["low"], k), highest(bars["high"], k)
    fast = sma(np.where(high != low, 100 * (bars["close"] - low) / (high - low), np.nan), slow)
    mean = sma(fast, d)
    return {"stochK": fast, "stochD": mean, "stochJ": 3 * fast - 2 * mean}


#: The types of `bounded`.
BOUNDED = ("SMA", "WMA", "HMA", "STDDEV", "HIGHEST_HIGH", "LOWEST_LOW", "BB", "ROC", "MOM", "TR", "VWAP", "VWMA", "CCI", "STOCH")


def bounded(kind: str, p: dict[str, float], bars: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray | dict[str, np.ndarray]:
    """One bounded indicator by its type, its parameters complete."""
    with np.errstate(all="ignore"):
        if kind == "BB":
            mid, dev = sma(x, p["period"]), p["k"] * stddev(x, p["period"])
            return {"middle": mid, "upper": mid + dev, "lower": mid - dev}
        if kind == "STOCH":
            return stoch(bars, p["k"], p["slow"], p["d"])
        if kind in ("TR", "VWAP"):
            return {"TR": true_range, "VWAP": vwap}[kind](bars)
        if kind in ("VWMA", "CCI"):
            return {"VWMA": vwma, "CCI": cci}[kind](bars, p["period"])
        if kind == "ROC":
            before = lagged(x, p["period"])
            return np.where(before != 0, (x - before) / before, np.nan)
        if kind == "MOM":
            return x - lagged(x, p["period"])
        return {"SMA": sma, "WMA": wma, "HMA": hma, "STDDEV": stddev, "HIGHEST_HIGH": highest, "LOWEST_LOW": lowest}[kind](x, p["period"])


# Positions and metrics.


def transitions(up: np.ndarray, down: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """What each bar makes of the positions short, flat and long before it, as 0, 1 and 2: one row a bar, one column a position."""
    flat = np.where(up, 2, np.where(down, 0, 1))
    return np.stack([np.where(leave, 1, np.where(up, 2, 0)), flat, np.where(leave, 1, np.where(down, 0, 2))], axis=1).astype(np.int8)


def composed(maps: np.ndarray) -> np.ndarray:
    """For each bar what all bars up to it make of a position, by doubling."""
    out, reach = maps, 1
    while reach < len(maps):
        out = np.concatenate([out[:reach], np.take_along_axis(out[reach:], out[:-reach].astype(np.int64), axis=1)])
        reach *= 2
    return out


def walked(up: np.ndarray, down: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The position after each bar, +1, 0 or -1, from flat."""
    return composed(transitions(up, down, leave))[:, 1].astype(np.int64) - 1


def backtest(stamps: np.ndarray, close: np.ndarray, position: np.ndarray, cost_bps: float) -> dict[str, float]:
    """The metrics of `positions.backtest` for one series in order of time."""
    n, cost = len(close), cost_bps / 10_000
    before = np.concatenate([[0], position[:-1]])
    ret = position[:-1] * (close[1:] / close[:-1] - 1) - np.abs(np.diff(before)) * cost
    equity = np.cumprod(np.concatenate([[1.0], 1 + ret]))
    peak = np.maximum(1.0, np.maximum.accumulate(equity))
    turns = np.flatnonzero(position != before)
    side, entry = position[turns], close[turns]
    leave = np.append(close[turns[1:]], close[-1]) if len(turns) else close[:0]
    pnl = ((side * (leave / entry - 1) - 2 * cost) * 100)[side != 0]
    dev = float(ret.std()) if n > 1 else 0.0
    gaps = np.sort(np.diff(stamps[:GAPS]))
    per_year = 252.0 if n < 3 else YEAR_MS / (gaps[len(gaps) // 2] or 3_600_000)
    return {
        "total_trades": len(pnl), "win_rate": float((pnl > 0).mean()) if len(pnl) else 0.0, "avg_pnl": float(pnl.mean()) if len(pnl) else 0.0, "total_return": float(equity[-1] - 1) * 100,
        "max_drawdown": float(((peak - equity) / peak).max()) * 100, "sharpe": float(ret.mean() / dev * per_year**0.5) if dev > 0 else 0.0, "buy_hold": float(close[-1] / close[0] - 1) * 100,
    }
