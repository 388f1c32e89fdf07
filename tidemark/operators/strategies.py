"""Strategy records: which can run, parameters, bindings in order, and the grid of what is to be ranked."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import RuleError, rule_identifiers, unknown_calls
from tidemark.operators import indicators as finite
from tidemark.operators import positions, recursive
from tidemark.schemas import KEYS

_PRICES = ("open", "high", "low", "close", "volume", "hl2", "hlc3", "ohlc4")
# Types that bounded windows compute: builder, default parameters, outputs.
_FINITE: dict[str, tuple[Callable[..., DataFrame], dict[str, float], tuple[str, ...]]] = {
    "SMA": (finite.sma, {"period": 20}, ()),
    "WMA": (finite.wma, {"period": 20}, ()),
    "HMA": (finite.hma, {"period": 20}, ()),
    "STDDEV": (finite.stddev, {"period": 20}, ()),
    "HIGHEST_HIGH": (finite.highest, {"period": 14}, ()),
    "LOWEST_LOW": (finite.lowest, {"period": 14}, ()),
    "BB": (finite.bollinger, {"period": 20, "k": 2.0}, ("middle", "upper", "lower")),
    "ROC": (finite.roc, {"period": 12}, ()),
    "MOM": (finite.mom, {"period": 10}, ()),
    "TR": (finite.true_range, {}, ()),
    "VWAP": (finite.vwap, {}, ()),
    "VWMA": (finite.vwma, {"period": 20}, ()),
    "CCI": (finite.cci, {"period": 20}, ()),
    "STOCH": (finite.stoch, {"k": 14, "slow": 3, "d": 3}, ("stochK", "stochD", "stochJ")),
}
PRICE_ONLY = {"TR", "VWAP", "VWMA", "CCI", "STOCH"}


@dataclass(frozen=True)
class Binding:
    type: str
    params: dict[str, Any] = field(default_factory=dict)
    source: str = "close"


@dataclass(frozen=True)
class Strategy:
    id: str
    direction: str
    conditions: tuple[str, ...]
    exits: tuple[str, ...] = ()
    bindings: dict[str, Binding] = field(default_factory=dict)
    parameters: dict[str, Any] = field(default_factory=dict)
    trigger: str | None = None


def is_known(kind: str) -> bool:
    return kind.upper() in _FINITE or kind.upper() in recursive.DEFAULTS or kind.upper() in recursive._OWN


def _outputs(kind: str) -> tuple[str, ...]:
    kind = kind.upper()
    return _FINITE[kind][2] if kind in _FINITE else recursive._OWN[kind][1] if kind in recursive._OWN else recursive.OUTPUTS.get(kind, ())


def register_columns(name: str, build: Callable[..., Column | dict[str, Column]], defaults: dict[str, float] | None = None, outputs: Sequence[str] = ()) -> None:
    """Make build(source, keys, **parameters) a type of its own, a Column or, with `outputs`, one for each: windows over `window(keys)` join the pass that all bounded indicators share.

    Parameters are whole where their default is. A sweep's kernel works on arrays and needs `recursive.register_indicator` in place of this.
    """

    def run(df: DataFrame, source: str = "close", keys: Sequence[str] = KEYS, name: str = name, **params: float) -> DataFrame:
        made = build(F.col(source), keys, **params)
        return df.withColumns({f"{name}__{o}": c for o, c in made.items()} if isinstance(made, dict) else {name: made})

    _FINITE[name.upper()] = (run, dict(defaults or {}), tuple(outputs))


def resolve_params(params: dict[str, Any], parameters: dict[str, Any]) -> dict[str, float]:
    """Numbers, or the values of the numeric parameters named; other names are dropped, so the default holds."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    found = {k: parameters.get(v) if isinstance(v, str) else v for k, v in params.items()}
    return {k: v for k, v in found.items() if number(v)}


def resolved_map(params: Column, parameters: Column) -> Column:
    """The same on tables: a map of texts, each a number or a parameter's name, as a map of numbers without the unresolved."""
    value = lambda k, v: F.coalesce(v.try_cast("double"), F.try_element_at(parameters, v).try_cast("double"))
    return F.map_filter(F.transform_values(params, value), lambda k, v: v.isNotNull())


def with_params(df: DataFrame, parameters: dict[str, Any]) -> DataFrame:
    """Numeric parameters as constant columns."""
    return df.withColumns({k: F.lit(float(v)) for k, v in resolve_params(parameters, {}).items() if k not in df.columns})


def provided(s: Strategy) -> set[str]:
    out = {*_PRICES, *resolve_params(s.parameters, {})}
    for key, b in s.bindings.items():
        if is_known(b.type):
            out |= {f"{key}.{o}" for o in _outputs(b.type)} or {key}
    return out


def check(s: Strategy) -> tuple[str | None, list[str]]:
    """(reason, missing) why a strategy cannot run; (None, []) if it can."""
    rules = [*s.conditions, *s.exits, *([s.trigger] if s.trigger else [])]
    if not rules:
        return "no entry conditions or trigger", []
    for r in rules:
        if "'" in r or '"' in r:
            return "string comparison not supported", []
    have, missing = provided(s), set()
    for r in rules:
        try:
            missing |= {i for i in rule_identifiers(r) if i not in have} | {f"call:{c}" for c in unknown_calls(r)}
        except RuleError as e:
            return f"unparseable condition: {e}", []
    bases = {h.split(".")[0] for h in have}
    for key, b in s.bindings.items():
        if not is_known(b.type):
            missing.add(f"indicator:{b.type}")
        if b.source not in have and b.source.split(".")[0] not in bases:
            missing.add(f"binding:{key}.source({b.source})")
    return (f"{len(missing)} unresolved identifier(s)", sorted(missing)) if missing else (None, [])


def assemblable(specs: DataFrame) -> DataFrame:
    """id, ok, reason and missing of each record of a spec table.

    Spec tables hold one row for each strategy; the reading of rule strings is row-wise work, done in an Arrow batch.
    """
    @F.pandas_udf("struct<reason:string,missing:array<string>>")
    def checked(records: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(strategy_of(json.loads(r))) for r in records], columns=["reason", "missing"])

    rows = specs.select("id", checked.asNondeterministic()(record_json(specs)).alias("c"))
    return rows.select("id", F.col("c.reason").isNull().alias("ok"), F.col("c.reason").alias("reason"), F.col("c.missing").alias("missing"))


#: The parts of a record that say what a strategy does; those that a table lacks count as empty.
_PARTS = ("id", "entry", "exit", "indicators", "bindings", "parameters")


def record_json(specs: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in _PARTS if c in specs.columns]))


def strategy_of(record: dict) -> Strategy:
    """A record of the spec table as a strategy. Its `indicators` are bindings under their output keys, unless a binding has that name."""
    entry, numbers = record.get("entry") or {}, {k: float(v) for k, v in (record.get("parameters") or {}).items() if _is_number(v)}
    value = lambda v: float(v) if _is_number(v) else v
    params = lambda x: {k: value(v) for k, v in (x.get("params") or {}).items()}
    given = {x["outputKey"]: Binding(x["type"], params(x), x["input"] if x.get("input") in _PRICES else "close") for x in record.get("indicators") or [] if x.get("outputKey")}
    given |= {k: Binding(x["type"], params(x), x.get("source") or "close") for k, x in (record.get("bindings") or {}).items()}
    exits = tuple((record.get("exit") or {}).get("conditions") or ())
    return Strategy(str(record.get("id")), entry.get("direction") or "BOTH", tuple(entry.get("conditions") or ()), exits, given, numbers, entry.get("trigger"))


def strategies_of(specs: DataFrame, most: int = 5000) -> list[Strategy]:
    """The strategies of the records that can run, by id. They shape the plan, so they come to the driver: `most` at most, more is refused."""
    ready = specs.join(assemblable(specs).filter("ok").select("id"), "id", "left_semi")
    rows = ready.select(record_json(ready).alias("record")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} strategies; rank them in parts")
    return sorted((strategy_of(json.loads(r["record"])) for r in rows), key=lambda s: s.id)


def _is_number(x: str | None) -> bool:
    try:
        float(x)
    except (TypeError, ValueError):
        return False
    return str(x).lower() not in ("nan", "inf", "-inf", "infinity", "-infinity")


#: An indicator to compute: type, parameters, source column, name of the new column.
Request = tuple[str, dict[str, float], str, str]


def bounded_params(kind: str, params: dict[str, float]) -> dict[str, float]:
    """All parameters of a bounded type, whole where the default is."""
    params = {"k" if k == "stdDev" and kind == "BB" else k: v for k, v in params.items()}
    return {k: type(d)(params.get(k, d)) for k, d in _FINITE[kind][1].items()}


def with_indicators(df: DataFrame, requests: Sequence[Request], keys: Sequence[str] = KEYS) -> DataFrame:
    """df with a column, or several, for each request: the bounded ones as windows, the recursive ones in one pass."""
    left = []
    for kind, params, source, name in requests:
        if kind in _FINITE:
            df = _FINITE[kind][0](df, **bounded_params(kind, params), **({} if kind in PRICE_ONLY else {"source": source}), keys=keys, name=name)
        else:
            left.append((kind, params, source, name))
    return recursive.recursive_indicators(df, left, keys) if left else df


def compose_all(df: DataFrame, strategies: Sequence[Strategy], keys: Sequence[str] = KEYS) -> tuple[DataFrame, list[dict[str, str]]]:
    """df with a column for each different indicator that the strategies' bindings ask for, and for each strategy the column of each binding.

    Indicators whose sources are ready are made together, sources before what is made from them.
    """
    from tidemark.functions.scalars import typical_prices

    wanted = {b.source for s in strategies for b in s.bindings.values()}
    df = df.withColumns({k: v for k, v in typical_prices().items() if k in wanted and k not in df.columns})
    made: dict[tuple, str] = {}
    columns: list[dict[str, str]] = [{} for _ in strategies]
    while waiting := [{k: b for k, b in s.bindings.items() if k not in own} for s, own in zip(strategies, columns, strict=True)]:
        if not any(waiting):
            break
        requests: list[Request] = []
        found: list[dict[str, str]] = []
        for s, own, rest in zip(strategies, columns, waiting, strict=True):
            found.append({})
            for key, b in rest.items():
                kind, base = b.type.upper(), b.source.split(".")[0]
                if base in rest and kind not in PRICE_ONLY:
                    continue
                source = "" if kind in PRICE_ONLY else (own.get(base, base) + b.source[len(base) :]).replace(".", "__")
                params = resolve_params(b.params, s.parameters)
                same = (kind, tuple(sorted(params.items())), source)
                if same not in made:
                    made[same] = f"_ind{len(made)}"
                    requests.append((kind, params, source or "close", made[same]))
                found[-1][key] = made[same]
        if not any(found):
            raise ValueError(f"bindings in a circle: {', '.join(k for w in waiting for k in w)}")
        df = with_indicators(df, requests, keys)
        for own, new in zip(columns, found, strict=True):
            own.update(new)
    return df, columns


def _names(s: Strategy, columns: dict[str, str]) -> dict[str, Column]:
    """What the names in a strategy's rules stand for: bindings, outputs of bindings, numeric parameters."""
    out = {k: F.lit(float(v)) for k, v in resolve_params(s.parameters, {}).items()}
    for key, column in columns.items():
        outputs = _outputs(s.bindings[key].type)
        out |= {f"{key}__{o}": F.col(f"{column}__{o}") for o in outputs} or {key: F.col(column)}
    return out


def compose(df: DataFrame, bindings: dict[str, Binding], parameters: dict[str, Any] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """df with a column for each binding, sources before what is made from them."""
    s = Strategy("", "BUY", (), (), dict(bindings), parameters or {})
    out, (columns,) = compose_all(df, [s], keys)
    own = {k: v for k, v in _names(replace(s, parameters={}), columns).items()}
    return out.withColumns(own).drop(*[c for c in out.columns if c.startswith("_ind")])


def evaluate_strategy(s: Strategy, keys: Sequence[str] = KEYS) -> Callable[[DataFrame], DataFrame]:
    """candles -> candles with the strategy's flags and position, for DataFrame.transform."""

    def run(candles: DataFrame) -> DataFrame:
        return positions.evaluate(with_params(compose(candles, s.bindings, s.parameters, keys), s.parameters), s.direction, s.conditions, s.exits, keys)

    return run


def job_grid(specs: DataFrame, markets: DataFrame, windows: DataFrame) -> DataFrame:
    """Each strategy for each market's timeframes and windows; windows is a few rows for each series, of bounded number."""
    return markets.join(windows, list(KEYS)).crossJoin(F.broadcast(specs.select(F.col("id").alias("spec_id"))))


#: Strategies of one plan; more are evaluated in several.
JOBS = 48


@dataclass(frozen=True)
class Job:
    """A strategy to backtest, with the values of the columns that name it in the result."""

    strategy: Strategy
    labels: tuple[tuple[str, Any], ...]


def backtest_jobs(candles: DataFrame, jobs: Sequence[Job], cost_bps: float = positions.COST_BPS, keys: Sequence[str] = KEYS, grid: DataFrame | None = None) -> DataFrame:
    """keys, the jobs' labels and the metrics of every job over every series; with grid(keys, labels) only of those in it.

    The candles are read and shuffled once for JOBS jobs: every different indicator is a column, every job a struct of flags in
    each bar; from there the bars of each job are series of their own in the same partitions.
    """
    return union_markets(*[positions.backtest(rows, cost_bps, own) for rows, own in _job_positions(candles, jobs, keys, grid)])


def trade_jobs(candles: DataFrame, jobs: Sequence[Job], cost_bps: float = positions.COST_BPS, keys: Sequence[str] = KEYS, grid: DataFrame | None = None) -> DataFrame:
    """The trades of the same jobs, under the same keys and labels."""
    return union_markets(*[positions.trades(rows, cost_bps, own) for rows, own in _job_positions(candles, jobs, keys, grid)])


def _job_positions(candles: DataFrame, jobs: Sequence[Job], keys: Sequence[str], grid: DataFrame | None) -> list[tuple[DataFrame, list[str]]]:
    """Tables of positions of the jobs, each with its keys and labels."""
    if not jobs:
        raise ValueError("no strategies")
    return [t for i in range(0, len(jobs), JOBS) for t in _block_positions(candles, jobs[i : i + JOBS], keys, grid)]


def _block_positions(candles: DataFrame, jobs: Sequence[Job], keys: Sequence[str], grid: DataFrame | None) -> list[tuple[DataFrame, list[str]]]:
    df, columns = compose_all(candles, [j.strategy for j in jobs], keys)
    labels = [name for name, _ in jobs[0].labels]
    own_keys = [*keys, *labels]
    automata: list[Column] = []
    windows: list[Column] = []
    for job, own in zip(jobs, columns, strict=True):
        s = job.strategy
        longs, shorts = positions.split_sides(s.direction, s.conditions)
        flags = {name: positions.any_rule(rules, df.columns, keys, _names(s, own)) for name, rules in (("long", longs), ("short", shorts), ("exit", s.exits))}
        two = bool(longs and shorts)
        shape = {"_two": F.lit(two), "_sign": F.lit(1 if longs or two else -1)}
        row = F.struct(*[F.lit(v).alias(k) for k, v in job.labels], *[x.alias(k) for k, x in (flags | shape).items()])
        (automata if two and s.exits else windows).append(row)
    out = []
    for structs, evaluate in ((windows, positions.shaped_position), (automata, positions.automaton_position)):
        if structs:
            rows = df.select(*keys, "timestamp", "close", F.array(*structs).alias("_jobs")).select(*keys, "timestamp", "close", F.inline("_jobs"))
            if grid is not None:
                rows = rows.join(grid.select(*own_keys), own_keys, "left_semi")
            out.append((evaluate(rows, own_keys), own_keys))
    return out


def ranking(candles: DataFrame, strategies: Sequence[Strategy] | DataFrame, windows: DataFrame | None = None, cost_bps: float = positions.COST_BPS, keys: Sequence[str] = KEYS, grid: DataFrame | None = None) -> DataFrame:
    """Metrics of every strategy over every series and window, or those in grid(keys, spec_id), ranked by return within each.

    strategies: a spec table, of which those that can run are taken, or strategies.
    """
    from tidemark.operators.series import window_slices

    if windows is not None:
        candles, keys = window_slices(candles, windows, keys), [*keys, "years"]
    return rank(backtest_jobs(candles, spec_jobs(strategies), cost_bps, keys, grid), keys)


def spec_jobs(strategies: Sequence[Strategy] | DataFrame) -> list[Job]:
    """A job for each strategy, or each record of a spec table that can run, named by spec_id."""
    given = strategies_of(strategies) if isinstance(strategies, DataFrame) else strategies
    return [Job(s, (("spec_id", s.id),)) for s in given]


def rank(metrics: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """rank by total return, ties by spec_id, and vs_hold. Returns that agree to six decimals tie, as the last digits of a product depend on the order of its factors."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("total_return", 6).desc(), "spec_id"))
    return metrics.withColumns({"rank": place, "vs_hold": F.col("total_return") - F.col("buy_hold")})


def leaderboard(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("total_return"), "spec_id")


def union_markets(*rankings: DataFrame) -> DataFrame:
    out = rankings[0]
    for r in rankings[1:]:
        out = out.unionByName(r)
    return out


def trade_rows(ranked: DataFrame, width: int = 26) -> DataFrame:
    """Cells of a ranking for display: whole percents, Sharpe with a typographic minus, dashes where there was no trade, long names cut."""
    from tidemark.functions.scalars import MINUS, ipct, js_round

    cell = lambda x: F.when(F.col("total_trades") > 0, x).otherwise("—")
    name = F.when(F.length("spec_id") > width, F.concat(F.substring("spec_id", 1, width - 1), F.lit("…"))).otherwise(F.col("spec_id"))
    sharpe = F.regexp_replace(F.format_string("%.2f", F.col("sharpe")), "-", MINUS)
    whole = lambda x: F.concat(js_round(x).cast("string"), F.lit("%"))
    keys = [c for c in ranked.columns if c in (*KEYS, "years")]
    return ranked.select(
        *keys, "rank", name.alias("name"), cell(ipct(F.col("total_return"))).alias("ret"), cell(ipct(F.col("vs_hold"))).alias("vs_hold"), cell(sharpe).alias("sharpe"),
        cell(whole(F.col("max_drawdown"))).alias("max_dd"), cell(whole(F.col("win_rate") * 100)).alias("win_rate"), F.col("total_trades").alias("trades"),
    )


def report_rows(ranked: DataFrame) -> DataFrame:
    """The same for a report: one decimal, whole names, no dashes."""
    from tidemark.functions.scalars import pct

    keys = [c for c in ranked.columns if c in (*KEYS, "years")]
    drawdown = F.concat(F.format_string("%.1f", F.col("max_drawdown")), F.lit("%"))
    return ranked.select(*keys, "rank", F.col("spec_id").alias("name"), pct(F.col("total_return")).alias("ret"), pct(F.col("vs_hold")).alias("vs_hold"), F.format_string("%.2f", F.col("sharpe")).alias("sharpe"), drawdown.alias("max_dd"), F.col("total_trades").alias("trades"))


def promotion_gate(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strategies that pass on both slices: sharpe > 1, drawdown under 20 %, 50 trades at least."""
    good = lambda df: df.filter("sharpe > 1 AND max_drawdown < 20 AND total_trades >= 50").select(*keys)
    return good(train).join(good(test), list(keys))


def valid_trials(trials: DataFrame, min_trades: int = 5) -> DataFrame:
    return trials.filter(F.col("train_trades") >= min_trades)


def top_tally(tally: DataFrame, k: int, key: str, n: str = "n") -> DataFrame:
    return tally.orderBy(F.desc(n), key).limit(k)


def missing_tally(checked: DataFrame, k: int = 15) -> DataFrame:
    """The most frequent missing names of `assemblable`."""
    counts = checked.select(F.explode("missing").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return top_tally(counts, k, "name")
