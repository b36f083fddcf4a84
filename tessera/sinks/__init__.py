"""Writers: JSONL, JSON arrays and the Parquet training dataset."""
