"""Dense, stable row positions without a global sort into one task.

``table_ordinal`` numbers rows in a key order: one range-partitioned sort,
checkpointed to the shared folder so that counting and numbering see the same
partitions, then per-partition offsets (one row per partition) joined back.

Lines of files are numbered by ``records``, elements of arrays by ``arrays``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

# Offset tables have one row per partition or file block. Below this many rows
# they are broadcast; above it they are joined by a shuffle join.
BROADCAST_ROWS = 200_000

ROW_BITS = 33  # monotonically_increasing_id = partition << 33 | row number


def maybe_broadcast(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def row_in_partition(mid: Column) -> Column:
    return mid.bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def partition_of(mid: Column) -> Column:
    return F.shiftright(mid, ROW_BITS)


def table_ordinal(df: DataFrame, *order_cols, name: str = "ord") -> DataFrame:
    """Add ``name``: the 0-based position of each row when ordered by ``order_cols``.

    Ties are broken arbitrarily but consistently (the sorted data is
    checkpointed once). Select only the columns you need before calling.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    ordered = df.orderBy(*order_cols).checkpoint(eager=True)
    tagged = ordered.withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy(partition_of(F.col("_mid")).alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    n_parts = ordered.rdd.getNumPartitions()
    out = tagged.withColumn("_pid", partition_of(F.col("_mid"))).join(maybe_broadcast(offsets, n_parts), "_pid")
    return out.withColumn(name, F.col("_off") + row_in_partition(F.col("_mid"))).drop("_mid", "_pid", "_off")


def running_sums(df: DataFrame, order_cols: list[str], sum_cols: list[str], parts: int | None = None) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over all rows strictly before each
    row in ``order_cols`` order, without gathering the table in one task.

    Rows are range-partitioned on the order (checkpointed, so the assignment is
    fixed), each range is summed, the ranges' totals are prefix-summed (one
    row per range, at most ``parts``), and a window inside each range adds the
    local prefix.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order_cols).withColumn("_rp", F.spark_partition_id()) \
        .checkpoint(eager=True)
    totals = ranged.groupBy("_rp").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    earlier = Window.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_rp", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_po_{c}")
                                  for c in sum_cols])
    local = Window.partitionBy("_rp").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(maybe_broadcast(offs, parts), "_rp")
    out = out.withColumns({f"{c}_before": F.col(f"_po_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0))
                           for c in sum_cols})
    return out.drop("_rp", *[f"_po_{c}" for c in sum_cols])
