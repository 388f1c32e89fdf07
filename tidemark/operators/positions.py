"""From rule flags to positions, signals, trades, returns and metrics.

Windows all run over the same keys in order of time, so a series is shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import rule_column, window
from tidemark.operators import blocks
from tidemark.operators.series import GAPS, yearly_bars
from tidemark.schemas import KEYS

COST_BPS = 5.0


def split_sides(direction: str, conditions: Sequence[str]) -> tuple[list[str], list[str]]:
    """The long and the short conditions: with BOTH, the first is long and all others are short."""
    conditions = list(conditions)
    if direction == "BUY":
        return conditions, []
    return ([], conditions) if direction == "SELL" else (conditions[:1], conditions[1:])


def any_rule(rules: Sequence[str], columns: Sequence[str], keys: Sequence[str] = KEYS, names: dict[str, Column] | None = None) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | rule_column(r, columns, keys, names)
    return out


def signal_flags(df: DataFrame, direction: str, conditions: Sequence[str], exits: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """long, short and exit: whether any condition of that side holds."""
    longs, shorts = split_sides(direction, conditions)
    return df.withColumns({name: any_rule(rules, df.columns, keys) for name, rules in (("long", longs), ("short", shorts), ("exit", exits))})


def _resettable(flags: DataFrame, reset: Column, toggle: Column, off: Column | int, before: int, keys: Sequence[str]) -> DataFrame:
    """Position = what the last reset says (1 or `off`), turned over by each toggle since; `before` holds until the first event."""
    so_far = window(keys).rowsBetween(Window.unboundedPreceding, 0)
    off = F.lit(off) if isinstance(off, int) else off
    rows = flags.withColumns({"_reset": reset, "_toggle": F.when(toggle, 1).otherwise(0)})
    rows = rows.withColumn("_part", F.count("_reset").over(so_far))
    in_part = Window.partitionBy(*keys, "_part").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first("_reset").over(in_part)
    rows = rows.withColumns({"_start": start, "_turns": F.sum("_toggle").over(in_part)})
    odd = F.col("_turns") % 2 == 1
    turned = F.when(F.col("_start") == 1, off).otherwise(1)
    position = F.when(F.col("_start").isNull(), F.when(F.col("_turns") == 0, before).when(odd, 1).otherwise(off)).when(odd, turned).otherwise(F.col("_start"))
    return rows.withColumn("position", position.cast("int")).drop("_reset", "_toggle", "_part", "_start", "_turns")


def position(flags: DataFrame, two_sided: bool, has_exit: bool, keys: Sequence[str] = KEYS, block_ms: float | None = None) -> DataFrame:
    """flags with `position`, +1, 0 or -1, after each bar.

    One-sided: a bar with its side alone goes in, with the exit alone out, with both turns over. Two-sided without exits: one flag sets the
    side, both turn it over. Both are windows of resets and turns; two sides with exits are an automaton.
    """
    if two_sided and has_exit:
        return automaton_position(flags, keys, block_ms)
    shape = {"_two": F.lit(two_sided), "_sign": F.lit(1)} if two_sided else {"_two": F.lit(False), "_sign": F.when(F.max(F.col("short").cast("int")).over(Window.partitionBy(*keys)) == 1, -1).otherwise(1)}
    return shaped_position(flags.withColumns(shape), keys).drop("_two", "_sign")


def automaton_position(flags: DataFrame, keys: Sequence[str] = KEYS, block_ms: float | None = None) -> DataFrame:
    """The position of series that have both sides and exits: a bar is a map of three states, and blocks of the series put their maps together."""
    return blocks.walk(blocks.with_block(flags, block_ms), keys).drop("_block")


def shaped_position(flags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The same for series of different shapes at once: `_two` (both sides, no exits) or one side, which is `_sign`."""
    up, down, leave, two = F.col("long"), F.col("short"), F.col("exit"), F.col("_two")
    side = up | down
    reset = F.when(two, F.when(up & ~down, 1).when(down & ~up, -1)).otherwise(F.when(side & ~leave, 1).when(leave & ~side, 0))
    toggle = F.when(two, up & down).otherwise(side & leave)
    rows = _resettable(flags, reset, toggle, F.when(two, -1).otherwise(0), 0, keys)
    return rows.withColumn("position", F.when(two, F.col("position")).otherwise(F.col("position") * F.col("_sign")))


def evaluate(df: DataFrame, direction: str, conditions: Sequence[str], exits: Sequence[str] = (), keys: Sequence[str] = KEYS, block_ms: float | None = None) -> DataFrame:
    """df with flags and position for one strategy."""
    longs, shorts = split_sides(direction, conditions)
    return position(signal_flags(df, direction, conditions, exits, keys), bool(longs and shorts), bool(exits), keys, block_ms)


def signals(positions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, timestamp, type, price and reason of the bars where the position changes."""
    before = F.coalesce(F.lag("position").over(window(keys)), F.lit(0))
    rows = positions.withColumn("_before", before).filter(F.col("position") != F.col("_before"))
    kind = F.when(F.col("position") > 0, "BUY").when(F.col("position") < 0, "SELL").otherwise("CLOSE")
    reason = F.when(F.col("position") == 0, "exit").when(F.col("_before") == 0, "entry").otherwise("reversal")
    return rows.select(*keys, "timestamp", kind.alias("type"), F.col("close").alias("price"), reason.alias("reason"))


def signals_to_bars(candles: DataFrame, table: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Candles with the position that a table of signals(keys, timestamp, type, seq) asks for.

    Of signals of one bar the last counts; CLOSE is flat, the others hold until the next.
    """
    one = Window.partitionBy(*keys, "timestamp").orderBy(F.desc("seq"))
    last = table.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*keys, "timestamp", F.col("type").alias("_type"))
    rows = candles.join(last, [*keys, "timestamp"], "left")
    wanted = F.when(F.col("_type") == "BUY", 1).when(F.col("_type") == "SELL", -1).when(F.col("_type") == "CLOSE", 0)
    so_far = window(keys).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("position", F.coalesce(F.last(wanted, ignorenulls=True).over(so_far), F.lit(0))).drop("_type")


def trades(positions: DataFrame, cost_bps: float = COST_BPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each stretch of a position: in at its first close, out at the close of the change, or at the last bar."""
    w = window(keys)
    whole = Window.partitionBy(*keys)
    rows = positions.select(*keys, "timestamp", "close", "position", F.coalesce(F.lag("position").over(w), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_last", F.max(F.struct("timestamp", "close")).over(whole)).filter(F.col("position") != F.col("_before"))
    leave = F.coalesce(F.lead(F.struct("timestamp", "close")).over(w), F.col("_last"))
    rows = rows.withColumn("_out", leave).filter("position != 0")
    gain = (F.col("position") * (F.col("_out.close") / F.col("close") - 1) - 2 * cost_bps / 10_000) * 100
    kind = F.when(F.col("position") > 0, "LONG").otherwise("SHORT")
    out = rows.select(*keys, F.col("timestamp").alias("entry_timestamp"), F.col("close").alias("entry_price"), F.col("_out.timestamp").alias("exit_timestamp"), F.col("_out.close").alias("exit_price"), kind.alias("type"), gain.alias("pnl_percent"))
    sign = F.when(F.col("type") == "LONG", 1).otherwise(-1)
    return out.withColumn("pnl", sign * (F.col("exit_price") - F.col("entry_price")))


def curve(positions: DataFrame, cost_bps: float = COST_BPS, keys: Sequence[str] = KEYS, block_ms: float | None = None) -> DataFrame:
    """positions with ret, equity and drawdown. With block_ms a series is worked on in blocks of that length, in several tasks: the positions and closes before a block, and
    the product and the peak of the blocks before, are rows of small tables."""
    if block_ms is None:
        return drawdown(equity(bar_returns(positions, cost_bps, keys), keys), keys)
    rows = blocks.lags(blocks.with_block(positions, block_ms), {"_held": ("position", 1), "_held2": ("position", 2), "_close1": ("close", 1)}, keys)
    changed = F.abs(F.col("_held") - F.coalesce("_held2", F.lit(0)))
    rows = rows.withColumn("ret", F.col("_held") * (F.col("close") / F.col("_close1") - 1) - changed * cost_bps / 10_000)
    rows = blocks.equity_and_peak(rows, 1 + F.coalesce("ret", F.lit(0.0)), keys)
    peak = F.greatest(F.lit(1.0), F.col("peak"))
    return rows.withColumn("drawdown", (peak - F.col("equity")) / peak).drop("_block", "_held", "_held2", "_close1", "peak")


def bar_returns(positions: DataFrame, cost_bps: float = COST_BPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Return `ret` of each bar after the first, held by the position before it, less the cost of the change before that."""
    w = window(keys)
    held = F.lag("position", 1).over(w)
    changed = F.abs(held - F.coalesce(F.lag("position", 2).over(w), F.lit(0)))
    ret = held * (F.col("close") / F.lag("close").over(w) - 1) - changed * cost_bps / 10_000
    return positions.withColumn("ret", ret)


def equity(returns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Running product of 1 + ret, from 1."""
    so_far = window(keys).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(so_far))


def drawdown(curve: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(peak - equity) / peak, the peak being 1 at least."""
    so_far = window(keys).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(1.0), F.max("equity").over(so_far))
    return curve.withColumn("drawdown", (peak - F.col("equity")) / peak)


def backtest_metrics(curve: DataFrame, trade_table: DataFrame, per_year: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """total_trades, win_rate, avg_pnl, total_return, max_drawdown and sharpe of each series of a curve with drawdown."""
    won = trade_table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"), F.avg(F.when(F.col("pnl_percent") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("pnl_percent").alias("avg_pnl")
    )
    rows = curve.groupBy(*keys).agg(
        F.avg("ret").alias("_mean"), F.stddev_pop("ret").alias("_dev"), ((F.max_by("equity", "timestamp") - 1) * 100).alias("total_return"), (F.max("drawdown") * 100).alias("max_drawdown")
    )
    rows = rows.join(won, list(keys), "left").join(per_year, list(keys), "left").na.fill({"total_trades": 0, "win_rate": 0.0, "avg_pnl": 0.0})
    sharpe = F.when(F.col("_dev") > 0, F.col("_mean") / F.col("_dev") * F.sqrt("bars_per_year")).otherwise(0.0)
    return rows.select(*keys, "total_trades", "win_rate", "avg_pnl", "total_return", "max_drawdown", sharpe.alias("sharpe"))


def backtest(positions: DataFrame, cost_bps: float = COST_BPS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Metrics and buy_hold of each series of positions, in one pass: windows over the bars, then one aggregate.

    A trade ends at the bar where the position changes, or at the last bar; its gain is known there, from the close where it began.
    """
    w, cost = window(keys), cost_bps / 10_000
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = drawdown(equity(bar_returns(positions.select(*keys, "timestamp", "close", "position"), cost_bps, keys), keys), keys)
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    rows = rows.withColumns({"_i": F.row_number().over(w), "_gap": F.col("timestamp") - F.lag("timestamp").over(w), "_before": before, "_final": F.lead("timestamp").over(w).isNull()})
    rows = rows.withColumn("_since", F.last(F.when(F.col("position") != F.col("_before"), F.col("close")), ignorenulls=True).over(so_far))
    rows = rows.withColumn("_from", F.lag("_since").over(w))
    gain = lambda side, entry: (side * (F.col("close") / entry - 1) - 2 * cost) * 100
    ended = F.when((F.col("_before") != 0) & (F.col("position") != F.col("_before")), gain(F.col("_before"), F.col("_from")))
    forced = F.when(F.col("_final") & (F.col("position") != 0), gain(F.col("position"), F.col("_since")))
    rows = rows.withColumns({"_ended": ended, "_forced": forced})
    n = F.count("_ended") + F.count("_forced")
    won = F.count_if(F.col("_ended") > 0) + F.count_if(F.col("_forced") > 0)
    total = F.coalesce(F.sum("_ended"), F.lit(0.0)) + F.coalesce(F.sum("_forced"), F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        n.alias("total_trades"), won.alias("_won"), total.alias("_gain"), F.avg("ret").alias("_mean"), F.stddev_pop("ret").alias("_dev"),
        ((F.max_by("equity", "timestamp") - 1) * 100).alias("total_return"), (F.max("drawdown") * 100).alias("max_drawdown"), F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.when(F.col("_i") <= GAPS, F.col("_gap")))).alias("_gaps"), ((F.max_by("close", "timestamp") / F.min_by("close", "timestamp") - 1) * 100).alias("buy_hold"),
    )
    sharpe = F.when(F.col("_dev") > 0, F.col("_mean") / F.col("_dev") * F.sqrt(yearly_bars(F.col("_gaps"), F.col("_n")))).otherwise(0.0)
    share = lambda x: F.when(F.col("total_trades") > 0, F.col(x) / F.col("total_trades")).otherwise(0.0)
    return out.select(*keys, "total_trades", share("_won").alias("win_rate"), share("_gain").alias("avg_pnl"), "total_return", "max_drawdown", sharpe.alias("sharpe"), "buy_hold")


def signal_counts(table: DataFrame, by: Sequence[str]) -> DataFrame:
    return table.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"))
