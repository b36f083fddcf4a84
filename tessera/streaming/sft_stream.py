"""Incremental SFT preparation over a growing folder of JSONL files.

Every step of record -> text is stateless per row, so the same projections run
on ``readStream``. Positions are global only in batch reads; a stream keeps the
source file instead. Progress and exactly-once output come from the checkpoint
location (under the shared checkpoint folder unless given).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variant as V
from ..functions.chat import Template
from ..functions.text import is_nonblank
from ..operators import sft
from ..session import scratch_path
from ..sources.records import BAD_JSON, BAD_UTF8, NOT_OBJECT
from ..sources.rows import with_record


def sft_stream(spark: SparkSession, input_dir: str, response_only_loss: bool = True,
               template: Template | str | None = None, prompt_field: str = "prompt",
               response_field: str = "groundtruth", split_field: str | None = None, split=None,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame ``(file, rec_error, text[, prompt_text], _error)``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(input_dir).select("value", F.col("_metadata.file_path").alias("file"))
    recs = with_record(lines.where(is_nonblank(F.col("value"))), F.col("value")).select(
        "file", F.is_valid_utf8(F.col("value")).alias("_utf8"), "rec")
    recs = recs.withColumn("rec_error", F.when(~F.col("_utf8"), F.lit(BAD_UTF8))
                           .when(F.col("rec").isNull(), F.lit(BAD_JSON))
                           .when(~V.is_object(F.col("rec")), F.lit(NOT_OBJECT)))
    if split_field and split is not None:
        # A record that cannot be read has no split: it is reported whatever the split.
        recs = recs.where(F.col("rec_error").isNotNull() | sft.split_condition(F.col("rec"), split_field, split))
    out = sft.project(recs, response_only_loss, template, prompt_field, response_field)
    cols = ["text", "prompt_text"] if response_only_loss else ["text"]
    return out.select("file", "rec_error", *cols, "_error")


def run_sft_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint_location: str | None = None,
                   available_now: bool = True, **kw):
    """Write the stream to Parquet; ``available_now`` processes what is there and stops."""
    location = checkpoint_location or scratch_path(spark, "sft-stream-checkpoint")
    writer = (sft_stream(spark, input_dir, **kw).writeStream.format("parquet")
              .option("compression", "zstd").option("checkpointLocation", location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start(output_dir)
