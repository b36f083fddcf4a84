"""A cleaning pipeline over ``documents``: toxic documents go, then exact copies,
then near copies; personal data is masked; what is left is packed.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to the
shared work folder and hands the table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, written
from tessera.llm.exact import exact_groups
from tessera.llm.near import near_groups, unzipped
from tessera.llm.packing import pack
from tessera.llm.pii import find_pii, masked
from tessera.llm.toxicity import toxicity
from tessera.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = tuple(COLUMNS)
NEAR_WORDS = 5  # words of a shingle; op3's own contract has four


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict to be toxic."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity(docs, labels, carry=CARRY).filter("predicted = 0").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one that stays."""
    ship_package(spark)
    return exact_groups(docs, carry=CARRY).filter("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 by shingles of five words) its smallest document."""
    ship_package(spark)
    return unzipped(near_groups(docs, carry=CARRY, width=NEAR_WORDS).filter("kept"), COLUMNS)


def pii_mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    ship_package(spark)
    rows = find_pii(docs, carry=CARRY)
    rows = masked(rows.withColumn("spans", F.concat("base", "found")), F.col("spans"))
    return rows.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))) \
        .withColumn("text", F.when(~F.col("no_text"), F.col("text"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship_package(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii_mask),
          ("packing", packing)]

# A trained classifier and a tokenizer are not SQL: tests compare every stage and run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
