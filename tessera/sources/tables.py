"""The Parquet tables and the record sets derived from them.

Every query reads these tables (or data Spark derives from them), so its work
grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chat import conversation_messages


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, messages)``: one typed conversation per ``conv_id``."""
    return conversation_messages(load(spark, sf_dir, "conversations"))


# Kinds of derived SFT records and their order in written files (fixed values).
KIND_ORDER = {"conv": 0, "doc": 1, "pair": 2, "label": 3}


def sft_corpus(spark: SparkSession, sf_dir: str, prompt_field: str = "prompt",
               response_field: str = "groundtruth") -> DataFrame:
    """Mixed-shape SFT records ``(kind, key, rid, rec VARIANT)``.

    * ``conv``: ``{"conv_id", "messages"}`` from ``conversations``
    * ``doc``: ``{"doc_id", "text", "lang"}`` from ``documents``
    * ``pair``: ``{"doc_id", <prompt_field>: text, <response_field>: source, "lang"}``
    * ``label``: ``{"doc_id", "quality", "toxic"}`` from ``labels`` (no usable shape)
    """
    conv = conversations(spark, sf_dir).select(
        F.lit("conv").alias("kind"), F.col("conv_id").alias("key"),
        F.to_variant_object(F.struct("conv_id", "messages")).alias("rec"))
    docs = load(spark, sf_dir, "documents")
    doc = docs.select(
        F.lit("doc").alias("kind"), F.col("doc_id").alias("key"),
        F.to_variant_object(F.struct("doc_id", "text", "lang")).alias("rec"))
    pair = docs.select(
        F.lit("pair").alias("kind"), F.col("doc_id").alias("key"),
        F.to_variant_object(F.struct(
            "doc_id", F.col("text").alias(prompt_field), F.col("source").alias(response_field), "lang")).alias("rec"))
    label = load(spark, sf_dir, "labels").select(
        F.lit("label").alias("kind"), F.col("doc_id").alias("key"),
        F.to_variant_object(F.struct("doc_id", "quality", "toxic")).alias("rec"))
    out = conv.unionByName(doc).unionByName(pair).unionByName(label)
    return out.withColumn("rid", F.concat_ws(":", "kind", F.col("key").cast("string")))


def kind_rank():
    expr = F.lit(None).cast("int")
    for kind, rank in KIND_ORDER.items():
        expr = F.when(F.col("kind") == kind, F.lit(rank)).otherwise(expr)
    return expr


PROMPT_KIND_ORDER = {"bench": 0, "conv": 1, "label": 2}


def prompt_records(spark: SparkSession, sf_dir: str, with_invalid: bool = False) -> DataFrame:
    """Inference inputs ``(kind, key, rid, rec)``:

    * ``bench``: ``{"id": item_id, "prompt": text, "Output": "keep"}``
    * ``conv``: ``{"id": conv_id, "messages": [...], "output": "stale"}``
    * ``label`` (only with ``with_invalid``): ``{"doc_id", "quality"}``, no prompt
    """
    bench = load(spark, sf_dir, "benchmark").select(
        F.lit("bench").alias("kind"), F.col("item_id").alias("key"),
        F.to_variant_object(F.struct(F.col("item_id").alias("id"), F.col("text").alias("prompt"),
                                     F.lit("keep").alias("Output"))).alias("rec"))
    conv = conversations(spark, sf_dir).select(
        F.lit("conv").alias("kind"), F.col("conv_id").alias("key"),
        F.to_variant_object(F.struct(F.col("conv_id").alias("id"), "messages",
                                     F.lit("stale").alias("output"))).alias("rec"))
    out = bench.unionByName(conv)
    if with_invalid:
        out = out.unionByName(load(spark, sf_dir, "labels").select(
            F.lit("label").alias("kind"), F.col("doc_id").alias("key"),
            F.to_variant_object(F.struct("doc_id", "quality")).alias("rec")))
    rank = F.lit(None).cast("int")
    for kind, r in PROMPT_KIND_ORDER.items():
        rank = F.when(F.col("kind") == kind, F.lit(r)).otherwise(rank)
    return out.withColumns({"rid": F.concat_ws(":", "kind", F.col("key").cast("string")), "kind_rank": rank})


RANGE_BYTES = 16 << 20  # of a table's files that one range of its rows stands for


def ranges(spark: SparkSession, sf_dir: str, name: str) -> int:
    """In how many ranges a table's rows are dealt when they are sorted as a whole."""
    files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return (files.agg(F.sum("length")).first()[0] or 0) // RANGE_BYTES + 1


def document_json(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The ``doc`` and ``pair`` records of ``sft_corpus`` as JSON text lines ``(kind_rank, key,
    value)``: every document is moved once, to one of ``n`` ranges of ``doc_id``, and each
    range is sorted by kind and key."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").repartitionByRange(n, "doc_id")
    doc = F.to_json(F.struct("doc_id", "text", "lang"))
    pair = F.to_json(F.struct("doc_id", F.col("text").alias("prompt"), F.col("source").alias("groundtruth"), "lang"))
    lines = docs.select(F.col("doc_id").alias("key"), F.explode(F.array(*[
        F.struct(F.lit(KIND_ORDER[kind]).alias("kind_rank"), js.alias("value")) for kind, js in (("doc", doc), ("pair", pair))])).alias("line"))
    return lines.select("line.kind_rank", "key", "line.value").sortWithinPartitions("kind_rank", "key")


def sft_corpus_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``conv`` and ``label`` records of ``sft_corpus`` as JSON text lines ``(kind, key,
    kind_rank, value)``, built straight from structs (no variant round trip) for writing files."""
    conv = conversations(spark, sf_dir).select(
        F.lit("conv").alias("kind"), F.col("conv_id").alias("key"), F.to_json(F.struct("conv_id", "messages")).alias("value"))
    label = load(spark, sf_dir, "labels").select(
        F.lit("label").alias("kind"), F.col("doc_id").alias("key"),
        F.to_json(F.struct("doc_id", "quality", "toxic"), {"ignoreNullFields": "false"}).alias("value"))
    return conv.unionByName(label).withColumn("kind_rank", kind_rank())
