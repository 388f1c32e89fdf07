"""The whole ranking as a job: candle and record files in, result records and a table of cells out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import positions, series, strategies
from tidemark.schemas import KEYS
from tidemark.sources import specs as spec_source


def rank_files(spark: SparkSession, candles: DataFrame, spec_path: str, out: str, windows: bool = False, one_a_file: bool = True, cost_bps: float = positions.COST_BPS) -> int:
    """Rank the records in spec_path that can run over every series of candles, and with `windows` over its look-back windows.

    Writes out/results (a record for each strategy and series with its metrics and trades, in folders of market and timeframe) and
    out/table (the cells of the ranking). Gives the number of strategies; without any nothing is written.
    """
    jobs = strategies.spec_jobs(spec_source.read_specs(spark, spec_path, one_a_file))
    if not jobs:
        return 0
    keys = [*KEYS]
    if windows:
        candles, keys = series.window_slices(candles, series.window_list(candles)), [*keys, "years"]
    ranked = strategies.rank(strategies.backtest_jobs(candles, jobs, cost_bps, keys), keys)
    schema = spec_source.write_results(ranked, strategies.trade_jobs(candles, jobs, cost_bps, keys), f"{out}/results", keys=[*keys, "spec_id"])
    strategies.trade_rows(spec_source.read_results(spark, f"{out}/results", schema)).write.mode("overwrite").parquet(f"{out}/table")
    return len(jobs)
