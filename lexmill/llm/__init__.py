"""Operators of a training-data pipeline: search, tokenising, scans, dedup, packing, rollups."""
