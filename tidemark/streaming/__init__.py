"""Structured Streaming form of the candle source."""
