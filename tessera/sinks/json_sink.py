"""JSON / JSONL sinks.

Output order is input order: the writer sorts on ``ord`` (range-partitioned,
so part files are in order and each is sorted). A JSON array cannot be split
across tasks, so every part file is one complete, compact array.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import arrow_limits, slices
from ..session import ship_package


def output_format(path: str, fmt: str = "auto") -> str:
    """Explicit format, else ``.jsonl`` suffix -> ``jsonl``, anything else -> ``json``."""
    if fmt not in ("auto", "json", "jsonl"):
        raise ValueError("fmt must be 'auto', 'json' or 'jsonl'")
    if fmt != "auto":
        return fmt
    return "jsonl" if path.rstrip("/").lower().endswith(".jsonl") else "json"


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def output_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def check_output(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Refuse an existing output before any work starts, unless ``overwrite``."""
    if output_exists(spark, path) and not overwrite:
        raise FileExistsError(f"{path} is there already (overwrite=True replaces it)")


def _json_col(col: Column | str, text: str | None = None) -> Column:
    """JSON of a value, or the text that already is its JSON where that column has one."""
    c = F.col(col) if isinstance(col, str) else col
    made = F.to_json(c, {"ignoreNullFields": "false"})
    return made if text is None else F.coalesce(F.col(text), made)


def write_jsonl(df: DataFrame, path: str, record: Column | str = "rec", order_col: str | None = "ord",
                overwrite: bool = False, text: str | None = None) -> None:
    """One JSON object per line, nulls kept, non-ASCII unescaped, in ``order_col`` order."""
    out = df.orderBy(order_col) if order_col else df
    out.select(_json_col(record, text).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_json_array(df: DataFrame, path: str, record: Column | str = "rec", order_col: str | None = "ord",
                     overwrite: bool = False, text: str | None = None) -> None:
    """Each part file is one valid JSON array (compact, one element per line). A task holds
    about a megabyte of records at a time, whatever their length."""
    ship_package(df.sparkSession)
    out = df.orderBy(order_col) if order_col else df
    lines = out.select(_json_col(record, text).alias("value"))

    def frame(batches):
        started = False
        for b in slices(batches, 0):
            rows = []
            for v in b.column(0).to_pylist():
                rows.append(("[" if not started else ",") + v)
                started = True
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if started else "[]"], pa.string())], names=["value"])

    with arrow_limits(df.sparkSession):
        lines.mapInArrow(frame, "value string").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_records(df: DataFrame, path: str, fmt: str = "auto", record: Column | str = "rec",
                  order_col: str | None = "ord", overwrite: bool = False, text: str | None = None) -> str:
    """Write records in input order (``text``: a column of ready JSON that goes before
    the record); returns the format used."""
    kind = output_format(path, fmt)
    (write_jsonl if kind == "jsonl" else write_json_array)(df, path, record, order_col, overwrite, text)
    return kind


def write_dataset(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """The training dataset (``text`` [, ``prompt_text``]) as Parquet."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
