"""Operators of a training-data pipeline: formatting, scans, extraction, sharding, filters, deduplication, packing."""
