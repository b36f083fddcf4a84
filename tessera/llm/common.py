"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import BATCH_BYTES, BATCH_ROWS, arrow_limits, slices  # noqa: F401
from ..session import checkpoint_root, scratch_path

# The white space of every contract here: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by position: an exact name wins over one that differs
    only in case, so extra columns with clashing names do no harm."""
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    chosen = []
    for n in names:
        hits = [i for i, c in enumerate(df.columns) if c == n] or \
               [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not hits:
            raise ValueError(f"column {n!r} is missing; there are {df.columns}")
        chosen.append(F.col(f"_c{hits[0]}").alias(n))
    return plain.select(*chosen)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared work folder: later steps read data, so a
    lost executor repeats tasks of one step and never changes ids given here."""
    spark = df.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: joined by shuffle at every size,
    so that small inputs take the way that large ones need."""
    return df.hint("merge")


def crc32_text(col: Column) -> Column:
    """crc32 of the decimal text of an id; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
