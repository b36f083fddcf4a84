"""Arrow batches of bounded size between Spark and Python tasks."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import SparkSession

# Arrow batches of document rows: 10,000 texts in one batch can exceed a Python
# worker's memory, and so can a thousand long ones.
BATCH_ROWS = 1000
BATCH_BYTES = 1 << 20


@contextmanager
def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
    """Arrow batches of at most so many rows and bytes for the actions inside; the
    session's own limits hold again afterwards."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (rows, size)):
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def slices(batches, column: int, rows: int = BATCH_ROWS, size: int = BATCH_BYTES):
    """Arrow batches cut, without copies, into ones of at most ``rows`` rows and about
    ``size`` bytes in ``column``; a longer value stays whole, alone. The function that
    reads them needs no setting of the session."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(lo, hi - lo)
            lo = hi
