"""Plan shape: the properties the scale design relies on."""

import contextlib
import io
import os
import re
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
from tessera.operators import infer as I  # noqa: E402
from tessera.plans import stubs  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_flagship_has_one_shuffle_and_no_lambdas_after_it(spark):
    p = plan(E.entry(spark))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "lambdafunction" not in p
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in p


def test_generation_shares_one_shuffle(spark):
    df = spark.range(50).select(F.col("id").alias("ord"), F.lit("hi").alias("text"))
    padded = I.pad_batches(I.repeat_items(df, 2, 4, 1), "codepoint", "left")
    p = plan(I.generate(padded, stubs.echo_model_factory, {}, checkpoint=False))
    assert len(re.findall(r"Exchange ", p)) == 1
    assert "REPARTITION_BY_NUM" in p  # explicit count: adaptive execution keeps model work spread out
    assert "FlatMapGroupsInPandas" in p


def test_scans_read_only_needed_columns(spark):
    p = plan(E.queries()["tokenize_truncate"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    p = plan(E.queries()["render_plain"](spark, SF))
    assert "ReadSchema: struct<item_id:bigint,text:string>" in p
