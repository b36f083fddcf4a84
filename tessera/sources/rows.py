"""What both record readers share: error codes, strict parsing of one JSON value,
tables in the shared folder, ids of chosen rows and prefix sums over splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..session import scratch_path
from . import ordinals

# Error codes (fixed values).
BAD_JSON = "BAD_JSON"
NOT_OBJECT = "NOT_OBJECT"
BAD_UTF8 = "BAD_UTF8"
NOT_LIST = "NOT_LIST"


_GUARD = "c1d7a0e4-end-of-record"  # any string will do: it must come last in the wrapped line


def _with_guard(value: Column) -> Column:
    # Most lines are objects without white space around them.
    bare = F.when(F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}")), value).otherwise(ustrip(value))
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit(f',"{_GUARD}"]'))),
                             "$", "array<variant>")


def _guarded(both: Column) -> Column:
    strict = (F.size(both) == 2) & (F.try_variant_get(F.get(both, F.lit(1)), "$", "string") == F.lit(_GUARD))
    return F.when(F.coalesce(strict, F.lit(False)), F.get(both, F.lit(0)))


def parse_record(value: Column) -> Column:
    """The JSON value a line holds, or NULL unless the line is exactly one value.

    ``parse_json`` stops after the first value. Wrapped as ``[line, guard]``, a
    line with anything after its value, or with several values, no longer parses
    to the two elements value and guard."""
    return _guarded(_with_guard(value))


def with_record(df: DataFrame, value: Column, where: Column | None = None) -> DataFrame:
    """``df`` with ``rec``, the ``parse_record`` of ``value`` on the rows for which ``where``
    holds. The parsed line is a column of its own: below a condition, each of its three
    uses would parse the line again."""
    both = _with_guard(value)
    return df.withColumn("_both", both if where is None else F.when(where, both)).withColumn("rec", _guarded(F.col("_both"))).drop("_both")


def raw_text(value: Column) -> Column:
    """The text of a record that may hold an integer too long for a VARIANT (which has 38
    digits and makes a double of more); NULL for all others."""
    return F.when(value.rlike("[0-9]{39}"), ustrip(value))


class LayoutError(RuntimeError):
    """The input or its splits changed while it was being read."""


def numbered(flag: Column) -> Column:
    """Consecutive ids, within a task, of the rows for which ``flag`` holds; NULL for the
    others. The id is evaluated on those rows alone; the readers check on
    the written rows that none is missing."""
    return F.when(flag, F.monotonically_increasing_id())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    spark = df.sparkSession
    where = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def sums_in_file(splits: DataFrame, sums: list[str]) -> DataFrame:
    """A table of splits with ``<c>_before``, the sum over the file's earlier splits."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})


def prefix_sums(small: DataFrame, order: list[str], sums: list[str], n: int) -> DataFrame:
    """A written table of ``n`` splits or files with ``<c>_before``: one window while a
    broadcast could hold it, beyond that spread over ranges."""
    if n > ordinals.BROADCAST_ROWS:
        return ordinals.running_sums(small, order, sums).checkpoint(eager=True)
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return small.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums})
