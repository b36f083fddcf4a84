"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes of their normalised text, most
significant first: every round takes the next block of bytes as the digit and
divides each group by it. Documents alone in their group leave at once, and so
do groups whose texts have ended; only the others go on with the next block.
Blocks grow by a constant factor, so a text of n bytes takes O(log n) rounds.
Groups are told apart by their bytes alone, never by a digest.

A round is one partial aggregation over (group, digit) and one join of the rows
with the groups of two or more. A hot group costs one row per task in the
aggregation, and the join lets AQE split its rows. Each round is a table in the
shared folder; the first carries whole rows, later ones only what is undecided.

Defined cases: null text counts as empty, empty texts equal each other, a null
``doc_id`` sorts last, and of repeated rows (same id, same text) one stays. An
empty table gives an empty result; other columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, merged, pick, written

FIRST_DIGIT = 64   # bytes of the first radix digit
DIGIT_GROWTH = 8   # each digit is this many times longer than the one before


def squeezed(text: Column) -> Column:
    """The text that is compared, as bytes: all white space removed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "").cast("binary")


def exact_groups(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``
    and the ``carry`` columns (for instance the text)."""
    held = [c for c in dict.fromkeys(("text", *carry)) if c != "doc_id"]
    rows = pick(docs, "doc_id", *held).toDF("doc_id", *[f"v_{c}" for c in held])
    text = F.col("v_text")
    norm = squeezed(text)
    rows = rows.select(
        "doc_id", *[f"v_{c}" for c in held], F.length(F.coalesce(text, F.lit(""))).alias("n_chars"),
        F.unhex(F.sha2(norm, 256)).alias("sha"), F.lit(0).cast("long").alias("gid"),
        F.substring(norm, 1, FIRST_DIGIT).alias("digit"), (F.length(norm) <= FIRST_DIGIT).alias("ended"))
    out, width, rest, level = [], FIRST_DIGIT, F.substring(norm, FIRST_DIGIT + 1, 2**31 - 1), 0
    while True:
        result = _round(rows, rest, level, held if carry else [])
        out.append(result.filter("done"))
        undecided = result.filter("not done")
        if undecided.isEmpty():
            break
        level, width = level + 1, width * DIGIT_GROWTH
        rows = undecided.select(
            "uid", "doc_id", *[c for c in undecided.columns if c.startswith("v_")], "n_chars", "sha",
            F.col("next_gid").alias("gid"), F.substring("rest", 1, width).alias("digit"),
            (F.length("rest") <= width).alias("ended"), "rest")
        rest = F.substring("rest", width + 1, 2**31 - 1)
    final = out[0]
    for more in out[1:]:
        final = final.unionByName(more)
    alone = F.col("n").isNull()
    return final.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("best.uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), *[F.col(f"v_{c}").alias(c) for c in carry if c != "doc_id"])


def _round(rows: DataFrame, rest: Column, level: int, held: list[str]) -> DataFrame:
    """Split by one digit. Level 0 gives every row its ``uid`` as data and leaves
    even ended groups to level 1, whose tie-break can then use it."""
    uid = F.col("uid") if level else F.lit(0).cast("long")
    key = ["gid", "digit", "ended"]
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id").alias("doc_id"), uid.alias("uid"))).alias("best")
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), best).filter("n > 1")
    groups = written(groups.withColumn("next_gid", F.monotonically_increasing_id()), f"radix-groups-{level}")
    done = F.col("n").isNull() | (F.col("ended") if level else F.lit(False))
    keep = [f"v_{c}" for c in held]  # without columns to carry, the text goes after its first cut
    joined = rows.join(merged(groups), key, "left")
    return written(joined.select(
        (F.col("uid") if level else F.monotonically_increasing_id()).alias("uid"), "doc_id", *keep, "n_chars", "sha",
        "n", "best", "next_gid", done.alias("done"), F.when(~done, rest).alias("rest")), f"radix-{level}")
