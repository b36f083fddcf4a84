"""Collating moves widths, not texts, and tokenizes once."""

import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import ROOT  # noqa: F401
from test_plans import plan
from tessera.functions import tokens as K
from tessera.operators import collate as C
from tessera.operators import infer as I
from tessera.plans import stubs


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 50)), max_size=30), st.integers(1, 4))
def test_run_widths(rows, size):
    ids, ns = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    want, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        want += [max(n for _, n in rows[i:j]) if j - i == size else None] * (j - i)
        i = j
    got = [None if np.isnan(x) else int(x) for x in C.run_widths(ids, ns, size)]
    assert got == want


def brute(rows, length, size, side):
    out = []
    for i, text, prompt in rows:
        ids = [ord(c) for c in text][:length]
        width = max(min(len(t), length) for k, t, _ in rows if k // size == i // size)
        labels = [-100 if k < min(len(prompt), length) else x for k, x in enumerate(ids)]
        fill = width - len(ids)

        def padded(a, v):
            return a + [v] * fill if side == "right" else [v] * fill + a
        out.append((i, i // size, padded(ids, 0), padded([1] * len(ids), 0), padded(labels, -100),
                    None if any(x != -100 for x in labels) else "NO_RESPONSE_TOKENS"))
    return out


@pytest.mark.parametrize("parts,shuffled,batch_rows", [(1, False, 10000), (5, False, 7), (5, False, 10000), (4, True, 10000)])
def test_batches_over_any_partitions(spark, parts, shuffled, batch_rows):
    rng = random.Random(parts)
    rows = [(i, "x" * rng.randrange(12) + "é", "x" * rng.randrange(14)) for i in range(103)]
    df = spark.createDataFrame(rows, "ord long, text string, prompt_text string")
    df = df.repartition(parts) if shuffled else df.coalesce(1).repartitionByRange(parts, "ord").sortWithinPartitions("ord")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, batch_rows)
    try:
        for side in ("right", "left"):
            out = C.collate(df, "codepoint", 8, 4, side)
            got = sorted(tuple(r) for r in out.select("ord", "batch_id", "input_ids", "attention_mask", "labels", "_error").collect())
            assert got == brute(rows, 8, 4, side)
    finally:
        spark.conf.set(key, was)


def test_no_text_and_no_ids_are_shuffled(spark):
    df = spark.range(1000).select(F.col("id").alias("ord"), F.repeat(F.lit("t"), F.col("id").cast("int") % 9 + 1).alias("text"), F.lit("t").alias("prompt_text"))
    p = plan(C.collate(df, "codepoint", 16, 8))
    assert "Exchange hashpartitioning" not in p and "Exchange rangepartitioning" not in p and "Window" not in p
    assert "BroadcastExchange" in p  # of the widths of batches that a task's border cuts


class _Counting:
    def encode(self, texts):
        return [[len(w) for w in t.split()] for t in texts]

    def encode_prompts(self, texts):
        return [[1, *ids] for ids in self.encode(texts)]

    def decode(self, ids):
        return [" ".join(map(str, i)) for i in ids]


def test_each_text_is_tokenized_once(spark):
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    tok = K.PandasTokenizer(_Counting, eos_id=0)
    df = spark.createDataFrame([(0, "aa b ccc", "aa"), (1, "dd", ""), (2, None, None)], "ord long, text string, prompt_text string")
    rows = C._encoded(df, tok, 4, "text", "prompt_text")
    rows = rows.withColumn("_w", C.local_widths(F.floor(F.col("ord") / 2), F.size("input_ids"), 2))
    # One Python evaluation for the text with its prompt, one for the widths.
    assert plan(rows).count("ArrowEvalPython") == 2
    out = {r.ord: r for r in C.collate(df, tok, 4, 2).collect()}
    assert out[0].input_ids == [2, 1, 3] and out[0].labels == [-100, 1, 3] and out[1].input_ids == [2, 0, 0]
    assert out[2].input_ids == [] and out[2]._error == "NO_RESPONSE_TOKENS"


def test_only_prompts_have_the_start_token(spark):
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([(0, "aa b")], "ord long, text string")
    for tok, plain in ((K.PandasTokenizer(_Counting, eos_id=0), [2, 1]), (K.CodepointTokenizer(bos_id=1), [97, 97, 32, 98]),
                       (K.Utf8Tokenizer(bos_id=1), [97, 97, 32, 98])):
        padded = I.pad_batches(I.repeat_items(df, 1, 4), tok).first()
        assert padded.input_ids == [1, *plain] and padded.attention_mask == [1] * (len(plain) + 1)
        assert C.label_rows(df, tok, 10, "text", None).first().input_ids == plain
    assert I.pad_batches(I.repeat_items(df, 1, 4), "codepoint").first().input_ids == [97, 97, 32, 98]


def test_generation_options():
    assert I.generation_options(0, 0.9, 5, 3) == {
        "max_new_tokens": 5, "do_sample": False, "temperature": None, "top_p": None, "pad_token_id": 3}
    assert I.generation_options(0.7, 0.9, 5, 0)["temperature"] == 0.7
    assert stubs.echo_model_factory()
