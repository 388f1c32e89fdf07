"""Indicators in which each bar depends on the one before.

Over tables a series spreads over several tasks: means are affine maps of what was before, bands and directions maps with few cases, and blocks of the series put
these together (`blocks`). The same over one series as arrays is what a sweep's kernel runs. Missing values are passed over: the recursion starts at the first value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import blocks
from tidemark.schemas import KEYS

#: A request: (type, params, source, name).
Request = tuple[str, dict[str, float], str, str]


def _over_seen(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f of the values that aren't missing, at their places."""
    at, out = np.flatnonzero(~np.isnan(x)), np.full(len(x), np.nan)
    out[at] = f(x[at])
    return out


def _mean(n: int, wilder: bool) -> Callable[[np.ndarray], np.ndarray]:
    def run(x: np.ndarray) -> np.ndarray:
        out = np.array(blocks.Smooth("", n, wilder, "").run(x, 0, 0.0))
        out[: n - 1] = np.nan
        return out

    return run


def ema(x: np.ndarray, n: int) -> np.ndarray:
    """Starts at the first value; missing for its first n - 1 bars."""
    return _over_seen(x, _mean(n, False))


def rma(x: np.ndarray, n: int) -> np.ndarray:
    """Starts with the mean of the first n values."""
    return _over_seen(x, _mean(n, True))


def rsi(x: np.ndarray, n: int) -> np.ndarray:
    step = np.diff(x, prepend=np.nan)
    up, down = rma(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), n), rma(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.isnan(up), np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / down)))


def true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int) -> np.ndarray:
    """Smoothed directional movements over smoothed true range, from the second bar on; their contrast smoothed again."""
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(high, low, close)
    for x in (plus, minus, tr):
        x[:1] = np.nan
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = rma(plus, n) / rma(tr, n), rma(minus, n) / rma(tr, n)
        dx = 100 * np.abs(p - m) / (p + m)
    warm = ~np.isnan(rma(tr, n))
    return rma(np.where(warm, np.nan_to_num(dx), np.nan), n)


def macd(x: np.ndarray, fast: int, slow: int, signal: int) -> dict[str, np.ndarray]:
    line = ema(x, fast) - ema(x, slow)
    mean = ema(line, signal)
    return {"macd": line, "signal": mean, "histogram": line - mean}


def supertrend(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int, multiplier: float) -> dict[str, np.ndarray]:
    """The band that the close is on the right side of, ratcheted, and +1 or -1; starts up."""
    atr, mid = rma(true_range(high, low, close), n), (high + low) / 2
    value, direction = np.full(len(close), np.nan), np.full(len(close), np.nan)
    upper = lower = d = np.nan
    for i in np.flatnonzero(~np.isnan(atr)).tolist():
        top, bottom = mid[i] + multiplier * atr[i], mid[i] - multiplier * atr[i]
        if np.isnan(d):
            upper, lower, d = top, bottom, 1.0
        else:
            was_up, was_low = upper, lower
            upper = top if top < was_up or close[i - 1] > was_up else was_up
            lower = bottom if bottom > was_low or close[i - 1] < was_low else was_low
            d = (1.0 if close[i] > upper else -1.0) if d < 0 else (-1.0 if close[i] < lower else 1.0)
        value[i], direction[i] = (lower if d > 0 else upper), d
    return {"value": value, "dir": direction}


# The default parameters of each type.
DEFAULTS = {
    "EMA": {"period": 20},
    "RMA": {"period": 14},
    "RSI": {"period": 14},
    "ATR": {"period": 14},
    "ADX": {"period": 14},
    "MACD": {"fast": 12, "slow": 26, "signal": 9},
    "SUPERTREND": {"period": 10, "multiplier": 3},
}
OUTPUTS = {"MACD": ("macd", "signal", "histogram"), "SUPERTREND": ("value", "dir")}
_OWN: dict[str, tuple[Callable, tuple[str, ...]]] = {}


def register_indicator(name: str, fn: Callable[[pd.DataFrame, np.ndarray, dict], np.ndarray | dict], outputs: Sequence[str] = ()) -> None:
    """Make fn(bars, source values, params) a type of its own; with `outputs` it returns a dict of them."""
    _OWN[name.upper()] = (fn, tuple(outputs))


def output_names(kind: str, name: str) -> list[str]:
    outputs = _OWN[kind.upper()][1] if kind.upper() in _OWN else OUTPUTS.get(kind.upper(), ())
    return [f"{name}__{o}" for o in outputs] or [name]


def compute(kind: str, params: dict[str, float], bars: pd.DataFrame, source: str, own: dict | None = None) -> np.ndarray | dict[str, np.ndarray]:
    """One indicator over one series in order of time."""
    kind = kind.upper()
    x = bars[source].to_numpy(float)
    if kind in (own or _OWN):
        return (own or _OWN)[kind][0](bars, x, params)
    return of_arrays(kind, params, {c: bars[c].to_numpy(float) for c in ("high", "low", "close")}, x)


def of_arrays(kind: str, params: dict[str, float], bars: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray | dict[str, np.ndarray]:
    """The same of arrays, for the types that are built in."""
    if kind not in DEFAULTS:
        raise ValueError(f"unknown indicator type {kind}")
    p = DEFAULTS[kind] | {k: v for k, v in params.items() if v is not None}
    n = int(p.get("period", 0))
    hlc = [bars[c] for c in ("high", "low", "close")]
    one = {"EMA": ema, "RMA": rma, "RSI": rsi}
    if kind in one:
        return one[kind](x, n)
    if kind == "MACD":
        return macd(x, int(p["fast"]), int(p["slow"]), int(p["signal"]))
    return rma(true_range(*hlc), n) if kind == "ATR" else adx(*hlc, n) if kind == "ADX" else supertrend(*hlc, n, p["multiplier"])


def recursive_indicators(df: DataFrame, requests: Sequence[Request], keys: Sequence[str] = KEYS, block_ms: float | None = None) -> DataFrame:
    """df with the requested columns; types with several outputs give name__output.

    The types that are built in run over blocks of the series (`blocks`), of block_ms each. A function of the user's own sees its whole series, in one task.
    """
    given = [(kind.upper(), params, source, name) for kind, params, source, name in requests]
    if unknown := [kind for kind, *_ in given if kind not in DEFAULTS and kind not in _OWN]:
        raise ValueError(f"unknown indicator type {unknown[0]}")
    own = [r for r in given if r[0] in _OWN]
    built_in = [r for r in given if r[0] not in _OWN]
    if own:
        df = _whole_series(df, own, keys)
    if not built_in:
        return df
    columns = df.columns
    out = _in_blocks(blocks.with_block(df, block_ms), built_in, keys)
    return out.select(*columns, *[o for kind, _, _, name in built_in for o in output_names(kind, name)])


def _in_blocks(df: DataFrame, requests: Sequence[Request], keys: Sequence[str]) -> DataFrame:
    """df (with blocks) and all columns of the requests, step by step: bars before, first means, what is made of them, means of that, bands."""
    lacking: dict[str, tuple[str, int]] = {}
    for kind, _, source, _ in requests:
        for c in {"RSI": (source,), "ATR": ("close",), "SUPERTREND": ("close",), "ADX": ("high", "low", "close")}.get(kind, ()):
            lacking[f"_before_{c}"] = (c, 1)
    if lacking:
        df = blocks.lags(df, lacking, keys)
    steps: dict[str, Column] = {}
    means: list[blocks.Smooth] = []
    later: dict[str, Column] = {}
    signals: list[blocks.Smooth] = []
    final: dict[str, Column] = {}
    before = lambda c: F.col(f"_before_{c}")
    move = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before("close")), F.abs(F.col("low") - before("close")))
    for k, (kind, params, source, name) in enumerate(requests):
        p = DEFAULTS[kind] | {q: v for q, v in params.items() if v is not None}
        n, at = int(p.get("period", 0)), f"_r{k}_"
        mean = lambda step, column, n, wilder=True, at=at: means.append(blocks.Smooth(column, n, wilder, f"{at}{step}"))
        if kind in ("EMA", "RMA"):
            mean("mean", source, n, kind == "RMA")
            final[name] = F.col(f"{at}mean")
        elif kind == "RSI":
            change = F.col(source) - before(source)
            steps |= {f"{at}rise": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), f"{at}fall": F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))}
            mean("up", f"{at}rise", n)
            mean("down", f"{at}fall", n)
            up, down = F.col(f"{at}up"), F.col(f"{at}down")
            final[name] = F.when(up.isNotNull(), F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / F.when(down != 0, down))))
        elif kind == "MACD":
            mean("fast", source, int(p["fast"]), False)
            mean("slow", source, int(p["slow"]), False)
            later[f"{at}line"] = F.col(f"{at}fast") - F.col(f"{at}slow")
            signals.append(blocks.Smooth(f"{at}line", int(p["signal"]), False, f"{at}signal"))
            final |= {f"{name}__macd": F.col(f"{at}line"), f"{name}__signal": F.col(f"{at}signal"), f"{name}__histogram": F.col(f"{at}line") - F.col(f"{at}signal")}
        elif kind == "ADX":
            up, down, known = F.col("high") - before("high"), before("low") - F.col("low"), before("close").isNotNull()
            steps |= {f"{at}plus": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)), f"{at}minus": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)), f"{at}range": F.when(known, move)}
            for step in ("plus", "minus", "range"):
                mean(f"mean_{step}", f"{at}{step}", n)
            a, b, r = (F.col(f"{at}mean_{step}") for step in ("plus", "minus", "range"))
            contrast = F.when((r != 0) & (a + b != 0), 100 * F.abs(a - b) / F.when(a + b != 0, a + b)).otherwise(0.0)
            later[f"{at}contrast"] = F.when(r.isNotNull(), contrast)
            signals.append(blocks.Smooth(f"{at}contrast", n, True, f"{at}adx"))
            final[name] = F.col(f"{at}adx")
        else:
            steps[f"{at}range"] = move
            mean("atr", f"{at}range", n)
            if kind == "ATR":
                final[name] = F.col(f"{at}atr")
    df = blocks.smoothed(df.withColumns(steps) if steps else df, means, keys)
    bands = [r for r in requests if r[0] == "SUPERTREND"]
    if signals or bands:
        df = blocks.cut(df)
    if signals:
        df = blocks.smoothed(df.withColumns(later), signals, keys)
        df = blocks.cut(df) if bands else df
    for k, (kind, params, _, name) in enumerate(requests):
        if kind == "SUPERTREND":
            df, value, direction = _supertrend(df, F.col(f"_r{k}_atr"), (DEFAULTS[kind] | params)["multiplier"], f"_r{k}_", keys)
            final |= {f"{name}__value": value, f"{name}__dir": direction}
    return df.withColumns(final)


def _supertrend(df: DataFrame, atr: Column, multiplier: float, at: str, keys: Sequence[str]) -> tuple[DataFrame, Column, Column]:
    """df (with blocks, the close before and the range's mean) with two bands and the turns between them; the value and the direction. The lower band is the upper one of negated prices."""
    mid = (F.col("high") + F.col("low")) / 2
    df = df.withColumns({f"{at}top": mid + multiplier * atr, f"{at}above": F.col("_before_close"), f"{at}bottom": -(mid - multiplier * atr), f"{at}below": -F.col("_before_close")})
    df = blocks.ratchets(df, {f"{at}upper": (f"{at}top", f"{at}above"), f"{at}lower": (f"{at}bottom", f"{at}below")}, keys)
    upper, lower, first = F.col(f"{at}upper"), -F.col(f"{at}lower"), F.col(f"{at}upper_first")
    # the first bar with bands is up; from there a close above the upper band turns up, one below the lower band turns down
    flag = lambda test: F.coalesce(test, F.lit(False))
    flags = {f"{at}rises": flag(first | (F.col("close") > upper)), f"{at}falls": flag(~first & (F.col("close") < lower)), f"{at}leaves": F.lit(False)}
    df = blocks.walk(df.withColumns(flags), keys, f"{at}turn", tuple(flags))
    return df, F.when(F.col(f"{at}turn") > 0, lower).otherwise(upper), F.when(upper.isNotNull(), F.col(f"{at}turn").cast("double"))


def _whole_series(df: DataFrame, requests: Sequence[Request], keys: Sequence[str]) -> DataFrame:
    names = [o for kind, _, _, name in requests for o in output_names(kind, name)]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    own = dict(_OWN)

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable").reset_index(drop=True)
        new = {}
        for kind, params, source, name in requests:
            found = compute(kind, params, bars, source, own)
            new |= {f"{name}__{k}": v for k, v in found.items()} if isinstance(found, dict) else {name: found}
        return bars.assign(**{k: pd.array(v, dtype="Float64") for k, v in new.items()})

    return df.groupBy(*keys).applyInPandas(run, schema)
