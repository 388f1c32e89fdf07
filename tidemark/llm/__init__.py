"""Operators of a training-data pipeline: secrets, token files, deduplication, decontamination, quality."""
