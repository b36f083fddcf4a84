"""Label masks and padding (edge table) and tokenizer round trips."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import tokens as K
from tessera.operators import collate as C


def _arr(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("ids,p,n,want", [
    ([5, 6, 7, 8], 2, 10, [-100, -100, 7, 8]),
    ([5, 6, 7, 8], 2, 3, [-100, -100, 7]),
    ([5, 6, 7, 8], 3, 3, None),
    ([5, 6], 0, 10, [5, 6]),
])
def test_mask_table(spark, ids, p, n, want):
    df = _arr(spark, [(ids, p)], "ids array<int>, p int")
    cut = F.slice("ids", 1, n)
    lab = K.mask_prefix(cut, F.least(F.col("p"), F.lit(n)))
    r = df.select(lab.alias("l"), F.exists(lab, lambda x: x != -100).alias("ok")).collect()[0]
    if want is None:
        assert not r.ok
    else:
        assert r.l == want


def test_padding_sides(spark):
    df = _arr(spark, [([5, 6], 1)], "ids array<int>, p int")
    lab = K.mask_prefix(F.col("ids"), F.col("p"))
    r = df.select(K.pad(lab, F.lit(4), -100, "right").alias("r"), K.pad(lab, F.lit(4), -100, "left").alias("l"),
                  K.attention_mask(F.size("ids"), F.lit(4), "left").alias("m")).collect()[0]
    assert r.r == [-100, 6, -100, -100]
    assert r.l == [-100, -100, -100, 6]
    assert r.m == [0, 0, 1, 1]


def test_eos_equal_to_pad_keeps_label(spark):
    df = _arr(spark, [(0, "ab\u0000", "a"), (1, "abcdef", "")], "ord long, text string, prompt_text string")
    out = {r.ord: r for r in C.collate(df, "codepoint", 16, 2, "right").collect()}
    assert out[0].input_ids == [97, 98, 0, 0, 0, 0]
    assert out[0].labels == [-100, 98, 0, -100, -100, -100]
    assert out[0].attention_mask == [1, 1, 1, 0, 0, 0]


def test_empty_text_has_no_response_tokens(spark):
    df = _arr(spark, [(0, "", "")], "ord long, text string, prompt_text string")
    r = C.collate(df, "codepoint", 8, 1).collect()[0]
    assert r._error == "NO_RESPONSE_TOKENS"
    with pytest.raises(ValueError):
        C.check_tensors(C.collate(df, "codepoint", 8, 1))


def test_codepoint_and_utf8_round_trip(spark):
    s = "héllo 😀 €"
    df = _arr(spark, [(s,)], "t string")
    cp, u8 = K.CodepointTokenizer(), K.Utf8Tokenizer()
    r = df.select(cp.encode(F.col("t")).alias("c"), cp.decode(cp.encode(F.col("t"))).alias("cd"),
                  u8.encode(F.col("t")).alias("u"), u8.decode(u8.encode(F.col("t"))).alias("ud"),
                  cp.encode(F.lit("")).alias("e")).collect()[0]
    assert r.c == [ord(c) for c in s] and r.cd == s
    assert r.u == list(s.encode("utf-8")) and r.ud == s
    assert r.e == []


def test_training_batches_arithmetic(spark):
    df = spark.range(10).withColumnRenamed("id", "ord")
    got = [(r.step, r.micro, r.rank) for r in C.training_batches(df, 1, 2, 2).orderBy("ord").collect()]
    assert got[:5] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0)]


class _WordTokenizer:
    """A stand-in model tokenizer: one id per character class run."""

    def encode(self, texts):
        return [[len(w) for w in t.split()] for t in texts]

    def decode(self, ids):
        return [" ".join("x" * i for i in row if i != 0) for row in ids]


def _word_factory():
    return _WordTokenizer()


def test_pandas_tokenizer_plug(spark):
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import test modules
    tok = K.PandasTokenizer(_word_factory, eos_id=0)
    df = spark.createDataFrame([(0, "aa bbb c", "aa"), (1, "dddd", "")], "ord long, text string, prompt_text string")
    r = df.select("ord", tok.encode(F.col("text"), 2).alias("ids"),
                  tok.decode(tok.encode(F.col("text"))).alias("back")).orderBy("ord").collect()
    assert r[0].ids == [2, 3] and r[1].ids == [4]
    assert r[0].back == "xx xxx x"
    out = {x.ord: x for x in C.collate(df, tok, 8, 2).collect()}
    assert out[0].labels == [-100, 3, 1]
    assert out[1].input_ids == [4, 0, 0] and out[1].labels == [4, -100, -100]
