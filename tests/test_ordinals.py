"""Dense positions and distributed prefix sums."""

import random

from pyspark.sql import functions as F

from tessera.sources.ordinals import running_sums, table_ordinal


def test_table_ordinal_matches_rank(spark):
    keys = list(range(0, 3000, 3))
    random.Random(7).shuffle(keys)
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k long, v string").repartition(7)
    got = sorted((r.k, r.ord) for r in table_ordinal(df, "k").collect())
    assert got == [(k, i) for i, k in enumerate(range(0, 3000, 3))]


def test_running_sums_match_python(spark):
    rows = [(f"f{i // 50:03d}", i % 50, (i * 7) % 11) for i in range(1000)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "file string, block long, n long")
    out = running_sums(df, ["file", "block"], ["n"], parts=5)
    got = {(r.file, r.block): r.n_before for r in out.collect()}
    acc, want = 0, {}
    for f, b, n in sorted(rows):
        want[(f, b)] = acc
        acc += n
    assert got == want
    assert out.where(F.col("n_before").isNull()).count() == 0
