"""Spark jobs for researching trading rules: candles, indicators, rules, backtests, sweeps and script corpora."""
