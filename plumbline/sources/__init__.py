"""Readers, writers, digests and run bookkeeping."""
