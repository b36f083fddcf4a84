"""Readers: JSON / JSONL records and the driver's Parquet tables."""
