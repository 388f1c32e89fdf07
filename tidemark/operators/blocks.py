"""Series that spread over several tasks.

A series is cut into blocks of time. What a block makes of whatever comes before it is summed up in a few numbers (a summary); the summaries of a series, one row a
block, are put together in order, which gives the state that each block starts with; then each block is filled in. Both passes over the bars
are grouped by series and block, so no task holds more than a block, and a long series takes as many tasks as it has blocks.

Summaries: the bars before (`lags`), affine maps y -> a * y + b (`smoothed`), maps of three positions (`walk`), maps with few exits (`ratchets`), products and maxima
(`equity_and_peak`). Each step reads its table twice, so `cut` stands between steps of a longer chain.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import arrays
from tidemark.functions.scalars import timeframe_ms
from tidemark.schemas import KEYS

#: Bars in a block, about, where a block's length in time isn't given.
BLOCK_BARS = 4096
HOUR_MS = 3_600_000


def with_block(df: DataFrame, block_ms: float | None = None) -> DataFrame:
    """df with `_block`: the bars of block_ms, or BLOCK_BARS times the timeframe (an hour where it is unknown)."""
    length = F.lit(float(block_ms)) if block_ms else (F.coalesce(timeframe_ms(F.col("timeframe")), F.lit(HOUR_MS)) if "timeframe" in df.columns else F.lit(HOUR_MS)) * float(BLOCK_BARS)
    return df.withColumn("_block", F.floor(F.col("timestamp") / length))


def in_block(keys: Sequence[str]):
    return Window.partitionBy(*keys, "_block").orderBy("timestamp")


def of_blocks(keys: Sequence[str]):
    """A series' summaries in order: a row for each block."""
    return Window.partitionBy(*keys).orderBy("_block")


def lags(df: DataFrame, wanted: dict[str, tuple[str, int]], keys: Sequence[str] = KEYS) -> DataFrame:
    """df (with blocks) and for each name the column of n bars before; the last bars before a block come from the blocks before."""
    most, columns = max(n for _, n in wanted.values()), sorted({c for c, _ in wanted.values()})
    bars = F.sort_array(F.collect_list(F.struct("timestamp", *columns)))  # of one block
    tails = df.groupBy(*keys, "_block").agg(bars.alias("_t"))
    tails = tails.withColumn("_t", F.slice("_t", F.greatest(F.size("_t") - most + 1, F.lit(1)), most))
    earlier = F.flatten(F.collect_list("_t").over(of_blocks(keys).rowsBetween(-most, -1)))
    rows = df.join(tails.select(*keys, "_block", earlier.alias("_earlier")), [*keys, "_block"])
    w = in_block(keys)
    rows = rows.withColumn("_rn", F.row_number().over(w))
    out = {name: F.when(F.col("_rn") > n, F.lag(c, n).over(w)).otherwise(F.try_element_at("_earlier", F.when(F.col("_rn") <= n, F.col("_rn") - n - 1))[c]) for name, (c, n) in wanted.items()}
    return rows.withColumns(out).drop("_earlier", "_rn")


@dataclass(frozen=True)
class Smooth:
    """A mean y = alpha * x + (1 - alpha) * y of a column without its missing values. It starts with the first value, or for wilder with the mean of the first n; it is missing before n values."""

    column: str
    n: int
    wilder: bool
    name: str

    @property
    def alpha(self) -> float:
        return 1 / self.n if self.wilder else 2 / (self.n + 1)

    def run(self, x: np.ndarray, before: int, y: float) -> np.ndarray:
        """The state after each of x, of which `before` values came earlier and left the state y; wilder: the sum, until there are n."""
        sums = min(len(x), max(0, self.n - 1 - before)) if self.wilder else 0
        first = np.cumsum(np.concatenate([[y], x[:sums]]))[1:]
        if sums == len(x):
            return first
        left, y = x[sums:], float(first[-1]) if sums else y
        if self.wilder and before + sums == self.n - 1:
            left = np.concatenate([[(y + left[0]) / self.n], left[1:]])
            return np.concatenate([first, _ewm(left, self.alpha)])
        if not self.wilder and before == 0:
            return _ewm(left, self.alpha)
        return np.concatenate([first, _ewm(np.concatenate([[y], left]), self.alpha)[1:]])

    def summary(self, x: np.ndarray) -> dict:
        """count; the state after x from the state 0; that of a series that starts with x; for wilder the sums up to each value that may be the n-th of the series, and
        what the values after it add."""
        m = len(x)
        out = {"count": m, "add": 0.0, "start": 0.0, "sums": [], "rest": []}
        if m:
            out["add"] = float(_ewm(np.concatenate([[0.0], x]), self.alpha)[-1])
            out["start"] = float(_ewm(x, self.alpha)[-1])
        if self.wilder:
            weighed = x * self.alpha * (1 - self.alpha) ** np.arange(m - 1, -1, -1.0)
            out["sums"] = np.cumsum(x[: self.n]).tolist()
            out["rest"] = np.append(np.cumsum(weighed[::-1])[::-1], 0.0)[1 : 1 + len(out["sums"])].tolist()
        return out

    def follow(self, before: int, y: float, block: dict) -> float:
        """The state after a block."""
        m, keep = int(block["count"]), 1 - self.alpha
        if not m:
            return y
        if not self.wilder:
            return block["start"] if before == 0 else keep**m * y + block["add"]
        if before >= self.n:
            return keep**m * y + block["add"]
        if before + m < self.n:
            return y + block["sums"][-1]
        p = self.n - 1 - before
        return keep ** (m - p - 1) * (y + block["sums"][p]) / self.n + block["rest"][p]


def _ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy() if alpha < 1 else x


def _seen(bars: pd.DataFrame, column: str) -> np.ndarray:
    x = bars[column].to_numpy(float)
    return np.flatnonzero(~np.isnan(x))


_SUMMARY = T.ArrayType(T.StructType([T.StructField("count", T.LongType()), T.StructField("add", T.DoubleType()), T.StructField("start", T.DoubleType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("sums", "rest")]]))


def smoothed(df: DataFrame, means: Sequence[Smooth], keys: Sequence[str] = KEYS) -> DataFrame:
    """df (with blocks) and a column for each mean. What a block makes of the state before it is affine: (1 - alpha) ** count times the state, and what its own values add."""
    of_key = [df.schema[k] for k in (*keys, "_block")]
    columns = sorted({m.column for m in means})

    def summary(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        return bars[[*keys, "_block"]].head(1).assign(_s=[[m.summary(bars[m.column].to_numpy(float)[_seen(bars, m.column)]) for m in means]])

    def follow(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        y, before, ys, befores = [0.0] * len(means), [0] * len(means), [], []
        for row in blocks["_s"]:
            ys.append(y)
            befores.append(before)
            y = [float(m.follow(n, v, x)) for m, n, v, x in zip(means, before, y, row, strict=True)]
            before = [n + int(x["count"]) for n, x in zip(before, row, strict=True)]
        return blocks[[*keys, "_block"]].assign(_y=ys, _before=befores)

    maps = df.select(*keys, "_block", "timestamp", *columns).groupBy(*keys, "_block").applyInPandas(summary, T.StructType([*of_key, T.StructField("_s", _SUMMARY)]))
    states = maps.groupBy(*keys).applyInPandas(follow, T.StructType([*of_key, T.StructField("_y", T.ArrayType(T.DoubleType())), T.StructField("_before", T.ArrayType(T.LongType()))]))
    names = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(m.name, T.DoubleType()) for m in means]])

    def fill(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        new = {}
        for k, m in enumerate(means):
            at, before = _seen(bars, m.column), int(bars["_before"].iloc[0][k])
            y = np.array(m.run(bars[m.column].to_numpy(float)[at], before, float(bars["_y"].iloc[0][k])))
            y[: max(0, m.n - 1 - before)] = np.nan
            new[m.name] = np.full(len(bars), np.nan)
            new[m.name][at] = y
        return bars[names].assign(**{k: pd.array(v, dtype="Float64") for k, v in new.items()})

    return df.join(states, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(fill, schema)


def _folded(maps: DataFrame, columns: Sequence[str], start: str, step: str, kind: str, keys: Sequence[str]) -> DataFrame:
    """keys, _block and _y, the state before each block: `start`, then what `step` makes of the state acc.y and a block x; a series' blocks are one list."""
    lists = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_block", *columns))).alias("_blocks"))
    out = f"cast(array() AS array<struct<_block:bigint,_y:{kind}>>)"
    fold = f"aggregate(_blocks, struct(cast({start} AS {kind}) AS y, {out} AS out), (acc, x) -> struct(cast({step} AS {kind}) AS y, concat(acc.out, array(struct(x._block AS _block, acc.y AS _y))) AS out), acc -> acc.out)"
    return lists.select(*keys, F.inline(F.expr(fold)))


def walk(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "position", flags: Sequence[str] = ("long", "short", "exit")) -> DataFrame:
    """df (with blocks and flags for long, short and exit) and the position after each bar; a block's summary is what it makes of short, flat and long."""

    def maps_of(bars: pd.DataFrame) -> np.ndarray:
        return arrays.composed(arrays.transitions(*(bars[c].to_numpy(bool) for c in flags)))

    def summary(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        return bars[[*keys, "_block"]].head(1).assign(_m=[maps_of(bars)[-1].tolist()])

    small = T.StructType([*[df.schema[k] for k in (*keys, "_block")], T.StructField("_m", T.ArrayType(T.IntegerType()))])
    maps = df.select(*keys, "_block", "timestamp", *flags).groupBy(*keys, "_block").applyInPandas(summary, small)
    states = _folded(maps, ["_m"], "1", "element_at(x._m, acc.y + 1)", "int", keys)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])

    def fill(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        return bars[names].assign(**{name: maps_of(bars)[:, int(bars["_y"].iloc[0])].astype(np.int32) - 1})

    return df.join(states, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(fill, schema)


def exits_of(top: np.ndarray, floor: np.ndarray) -> list[dict[str, float]]:
    """What a block makes of a band u, which stays as it is until u > top or u < floor (NaN: no floor) and is top from there: the bars at which some u ends, in order,
    with the value that the band has after the block; neighbours that lead to the same value are one."""
    n = len(top)
    lowest, highest = np.minimum.accumulate(top), np.fmax.accumulate(floor)
    record = np.concatenate([[True], (lowest[1:] < lowest[:-1]) | (highest[1:] > highest[:-1]) | (np.isnan(highest[:-1]) & ~np.isnan(highest[1:]))])[:n]
    end = np.empty(n)
    for j in range(n - 1, -1, -1):  # the next bar at which the band of bar j ends
        after = np.flatnonzero((top[j + 1 : j + 65] < top[j]) | (floor[j + 1 : j + 65] > top[j]))
        if not len(after) and j + 65 < n:
            after = 64 + np.flatnonzero((top[j + 65 :] < top[j]) | (floor[j + 65 :] > top[j]))
        end[j] = end[j + 1 + after[0]] if len(after) else top[j]
    out: list[dict[str, float]] = []
    for j in np.flatnonzero(record).tolist():
        low = -np.inf if np.isnan(floor[j]) else float(floor[j])
        if out and out[-1]["end"] == end[j]:
            out[-1]["top"], out[-1]["floor"] = min(out[-1]["top"], float(top[j])), max(out[-1]["floor"], low)
        else:
            out.append({"top": float(top[j]), "floor": low, "end": float(end[j])})
    return out


def ratchets(df: DataFrame, bands: dict[str, tuple[str, str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """df (with blocks) and bands name -> (top, floor): a band is top at first, and wherever top is below it or it is below floor; elsewhere it is as before.
    Missing where top is; `name`_first is whether the band starts there."""
    given = sorted({c for pair in bands.values() for c in pair})
    names, of_key = df.columns, [df.schema[k] for k in (*keys, "_block")]

    def columns(bars: pd.DataFrame, top: str, floor: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = _seen(bars, top)
        return at, bars[top].to_numpy(float)[at], bars[floor].to_numpy(float)[at]

    def summary(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        found = [columns(bars, *pair)[1:] for pair in bands.values()]
        return bars[[*keys, "_block"]].head(1).assign(_e=[[exits_of(t, f) if len(t) else [] for t, f in found]])

    exits = T.ArrayType(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("top", "floor", "end")])))
    maps = df.select(*keys, "_block", "timestamp", *given).groupBy(*keys, "_block").applyInPandas(summary, T.StructType([*of_key, T.StructField("_e", exits)]))
    step = "zip_with(x._e, acc.y, (e, u) -> coalesce(get(filter(e, b -> u > b.top OR u < b.floor), 0).end, u))"
    states = _folded(maps, ["_e"], f"array_repeat(double('Infinity'), {len(bands)})", step, "array<double>", keys)
    schema = T.StructType([*df.schema.fields, *[T.StructField(*x) for name in bands for x in ((name, T.DoubleType()), (f"{name}_first", T.BooleanType()))]])

    def fill(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        new = {}
        for k, (name, pair) in enumerate(bands.items()):
            at, t, f = columns(bars, *pair)
            u, out, first = float(bars["_y"].iloc[0][k]), np.full(len(bars), np.nan), np.zeros(len(bars), bool)
            if len(at) and u == np.inf:
                first[at[0]] = True
            for i, (x, low) in enumerate(zip(t.tolist(), f.tolist(), strict=True)):
                if u > x or u < low:
                    u = x
                out[at[i]] = u
            new |= {name: pd.array(out, dtype="Float64"), f"{name}_first": first}
        return bars[names].assign(**new)

    return df.join(states, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(fill, schema)


def equity_and_peak(df: DataFrame, factor: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """df (with blocks), `equity`, the running product of the factors, and `peak`, its highest value so far. A block's summary are its product and its highest running product."""
    so_far = in_block(keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_f", factor).withColumn("_own", F.product("_f").over(so_far))
    rows = rows.withColumn("_top", F.max("_own").over(so_far))
    earlier = of_blocks(keys).rowsBetween(Window.unboundedPreceding, -1)
    small = rows.groupBy(*keys, "_block").agg(F.product("_f").alias("_all"), F.max("_own").alias("_high"))
    small = small.withColumn("_start", F.coalesce(F.product("_all").over(earlier), F.lit(1.0)))
    small = small.withColumn("_before", F.max(F.col("_start") * F.col("_high")).over(earlier)).select(*keys, "_block", "_start", "_before")
    rows = rows.join(small, [*keys, "_block"])
    out = {"equity": F.col("_start") * F.col("_own"), "peak": F.greatest("_before", F.col("_start") * F.col("_top"))}
    return rows.withColumns(out).drop("_f", "_own", "_top", "_start", "_before")


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, in tests one of this process."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return f"file://{_own_folder[0]}"


def cut(df: DataFrame) -> DataFrame:
    """df written once and its lineage cut, where what follows reads it again and again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
