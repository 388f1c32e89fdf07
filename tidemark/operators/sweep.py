"""Parameter sweeps with an out-of-sample split.

Every trial of every strategy is a set of parameters with which the strategy's own rules, bindings and exits run over each series, timeframe
and slice. Trials are rows of a table, not branches of a plan: Spark makes the grid of series and blocks of trials, and a numpy kernel runs a block
over one series, so that trials that ask for the same indicator share it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import arrays
from tidemark.functions.scalars import param_range, sample_param, verdict
from tidemark.operators import positions, recursive
from tidemark.operators.strategies import PRICE_ONLY, Strategy, assemblable, bounded_params, record_json, resolve_params, strategy_of
from tidemark.schemas import KEYS

#: Trials of one strategy in a unit of work.
TRIALS = 64
#: So many trials, of some hundred bytes each, are broadcast to the series; more are not.
BROADCAST_TRIALS = 100_000


def parameter_ranges(specs: DataFrame) -> DataFrame:
    """spec_id, name and range of the swept parameters of specs(spec_id, parameters map of numbers)."""
    rows = specs.select("spec_id", F.explode("parameters").alias("name", "value"))
    return rows.withColumn("range", param_range(F.col("name"), F.col("value"))).filter(F.col("range").isNotNull())


def trial_grid(spark, specs: DataFrame, trials: int, seed: int = 0) -> DataFrame:
    """spec_id, trial and params: a draw of every swept parameter, the author's default for the others; trial -1 is all defaults."""
    ranges = parameter_ranges(specs).groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("name", "range"))).alias("ranges"))
    grid = specs.join(ranges, "spec_id", "left").crossJoin(spark.range(-1, trials).select(F.col("id").cast("int").alias("trial")))
    drawn = F.transform("ranges", lambda r: F.struct(r["name"].alias("key"), sample_param(r["range"], seed, F.col("spec_id"), F.col("trial"), r["name"]).alias("value")))
    swept = F.coalesce(F.map_from_entries(drawn), F.create_map().cast("map<string,double>"))
    kept = F.map_filter("parameters", lambda k, v: ~F.array_contains(F.map_keys(swept), k))
    return grid.select("spec_id", "trial", F.when(F.col("trial") < 0, F.col("parameters")).otherwise(F.map_concat(kept, swept)).alias("params"))


_METRICS = ("trades", "win_rate", "total_return", "max_drawdown", "sharpe")
_OF_BACKTEST = ("total_trades", *_METRICS[1:])
_BARS = ("timestamp", "open", "high", "low", "close", "volume")


class SeriesRun:
    """One series, over which trials run: indicators are kept by type, parameters and source, as many trials ask for the same."""

    def __init__(self, stamps: np.ndarray, bars: dict[str, np.ndarray], own: dict):
        self.stamps, self.bars, self.own, self.n = stamps, bars, own, len(stamps)
        self.made: dict[tuple, np.ndarray | dict[str, np.ndarray]] = {}

    def indicator(self, s: Strategy, key: str, above: tuple[str, ...] = ()) -> tuple[tuple, np.ndarray | dict[str, np.ndarray]]:
        """What names the values of a binding, and the values."""
        b = s.bindings[key]
        if key in above:
            raise ValueError(f"bindings in a circle: {', '.join(above)}")
        kind, params = b.type.upper(), resolve_params(b.params, s.parameters)
        base, _, output = b.source.partition(".")
        if kind in PRICE_ONLY:
            source, x = ("close",), self.bars["close"]
        elif base in s.bindings:
            source, x = self.indicator(s, base, (*above, key))
            x, source = (x[output], (*source, output)) if output else (x, source)
        else:
            source, x = (b.source,), arrays.price(self.bars, b.source)
        name = (kind, tuple(sorted(params.items())), source)
        if name not in self.made:
            self.made[name] = self._values(kind, params, x)
        return name, self.made[name]

    def _values(self, kind: str, params: dict[str, float], x: np.ndarray) -> np.ndarray | dict[str, np.ndarray]:
        if kind in self.own:
            return self.own[kind][0](pd.DataFrame({"timestamp": self.stamps, **self.bars}), x, params)
        if kind not in arrays.BOUNDED and kind not in recursive.DEFAULTS:
            raise ValueError(f"{kind} is no type over arrays; register it as a function")
        if kind in recursive.DEFAULTS:
            return recursive.of_arrays(kind, params, self.bars, x)
        return arrays.bounded(kind, bounded_params(kind, params), self.bars, x)

    def score(self, s: Strategy, cost_bps: float) -> dict[str, float]:
        names: dict[str, np.ndarray | float] = dict(resolve_params(s.parameters, {}))
        for key in s.bindings:
            _, x = self.indicator(s, key)
            names |= {f"{key}.{o}": v for o, v in x.items()} if isinstance(x, dict) else {key: x}
        resolve = arrays.resolver(self.bars, names, self.n)
        longs, shorts = positions.split_sides(s.direction, s.conditions)
        up, down, leave = (arrays.any_rule(rules, resolve, self.n) for rules in (longs, shorts, s.exits))
        return arrays.backtest(self.stamps, self.bars["close"], arrays.walked(up, down, leave), cost_bps)


def series_rows(candles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each series, with an array for each column of its bars in order of time: so the length of a series bounds a row."""
    rows = candles.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*_BARS))).alias("bars"))
    return rows.select(*keys, *[F.col(f"bars.{c}").alias(f"bar_{c}") for c in _BARS])


def score_trials(candles: DataFrame, strategies: Sequence[Strategy] | DataFrame, trials: DataFrame, cost_bps: float = positions.COST_BPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, slice, spec_id, trial and metrics of each of trials(spec_id, trial, params) on each series and slice of the candles.

    strategies: a spec table, of which those that can run are taken, or strategies. Trials are rows: TRIALS of one strategy over one series and slice are one
    unit of work, so the plan, its scans and its exchanges are the same for any number of trials and, with a spec table, of strategies.
    """
    whole = [*keys, "slice"]
    draws = F.sort_array(F.collect_list(F.struct("trial", F.map_entries("params").alias("params")))).alias("trials")
    if isinstance(strategies, DataFrame):
        ready = strategies.join(assemblable(strategies).filter("ok").select("id"), "id", "left_semi")
        table = trials.join(ready.select(F.col("id").alias("spec_id"), record_json(ready).alias("record")), "spec_id")
        by_id: dict[str, Strategy] = {}
    else:
        by_id = {s.id: s for s in strategies}
        table = trials.filter(F.col("spec_id").isin(*by_id)).withColumn("record", F.lit(None).cast("string"))
    blocks = table.groupBy("spec_id", F.floor(F.col("trial") / TRIALS).alias("block")).agg(F.first("record").alias("record"), draws)
    if trials.count() <= BROADCAST_TRIALS:
        blocks = F.broadcast(blocks)
    jobs = series_rows(candles, whole).crossJoin(blocks)  # the grid of all series and all blocks is what is asked for
    schema = T.StructType([*[candles.schema[k] for k in whole], T.StructField("spec_id", T.StringType()), trials.schema["trial"], T.StructField("trades", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in _METRICS[1:]]])
    own = dict(recursive._OWN)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.to_dict("records"):
            bars = {c: np.asarray(row[f"bar_{c}"], float) for c in _BARS[1:]}
            one = SeriesRun(np.asarray(row["bar_timestamp"], np.int64), bars, own)
            s = strategy_of(json.loads(row["record"])) if row["record"] is not None else by_id[row["spec_id"]]
            for t in row["trials"]:
                params = {e["key"]: e["value"] for e in (t["params"] if t["params"] is not None else ())}
                m = one.score(replace(s, parameters=params), cost_bps)
                out.append((*(row[k] for k in whole), row["spec_id"], t["trial"], *(m[c] for c in _OF_BACKTEST)))
        return pd.DataFrame(out, columns=schema.names)

    return jobs.groupBy(*whole, "spec_id", "block").applyInPandas(run, schema)


def train_and_test(scores: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each trial: train_ and test_ metrics."""
    pick = lambda s, m: F.max(F.when(F.col("slice") == s, F.col(m))).alias(f"{s}_{m}")
    return scores.groupBy(*keys, "spec_id", "trial").agg(*[pick(s, m) for s in ("train", "test") for m in _METRICS])


def sweep_summary(trials: DataFrame, min_trades: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each series and strategy: trials, valid_n, train_good_n, held_up_n, best and oracle test figures, the defaults' figures and the verdict."""
    drawn = F.col("trial") >= 0
    valid = drawn & (F.col("train_trades") >= min_trades)
    good = valid & (F.col("train_sharpe") > 1)
    row = F.struct("train_sharpe", "test_sharpe", "test_return", "test_trades", "trial")
    first = F.struct("train_sharpe", (-F.col("trial")).alias("t"))
    out = trials.withColumnRenamed("test_total_return", "test_return").groupBy(*keys, "spec_id").agg(
        F.count_if(drawn).alias("trials"),
        F.count_if(valid).alias("valid_n"),
        F.count_if(good).alias("train_good_n"),
        F.count_if(good & (F.col("test_sharpe") > 1)).alias("held_up_n"),
        F.max_by(F.when(valid, row), F.when(valid, first)).alias("best"),
        F.max(F.when(valid, F.col("test_sharpe"))).alias("oracle_test_sharpe"),
        F.max(F.when(~drawn, F.col("train_sharpe"))).alias("default_train_sharpe"),
        F.max(F.when(~drawn, F.col("test_sharpe"))).alias("default_test_sharpe"),
    )
    flat = [F.col(f"best.{c}").alias(f"best_{c}") for c in ("trial", "train_sharpe", "test_sharpe", "test_return", "test_trades")]
    return out.select(*[c for c in out.columns if c != "best"], *flat, verdict(F.col("best"), min_trades).alias("verdict"))


def sweep_board(summaries: DataFrame) -> DataFrame:
    """By the best configuration's test Sharpe ratio, missing ones last."""
    return summaries.orderBy(F.desc(F.coalesce("best_test_sharpe", F.lit(-99.0))), "spec_id")
