"""Tokenize, truncate, mask and pad SFT rows into training tensors.

Every text is tokenized once, into ids of at most ``max_length`` beside the number of
masked labels, and these rows are written. A batch is ``batch_size`` consecutive rows,
so its width is known to the task that has all of them: a narrow function over
``(batch_id, n)`` finds it while the rows pass by. Only batches cut by the border of two
tasks are left, a few a task; their widths are one small aggregate, joined back by
``batch_id``. No text and no ids go through a shuffle.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.tokens import Tokenizer
from ..session import checkpoint_root, ship_package
from ..sources.ordinals import maybe_broadcast
from ..sources.rows import stored

NO_RESPONSE_TOKENS = "NO_RESPONSE_TOKENS"


def label_rows(df: DataFrame, tokenizer: Tokenizer | str | None = None, max_length: int = 1024,
               text_col: str = "text", prompt_col: str | None = "prompt_text") -> DataFrame:
    """Add ``input_ids``, ``labels`` and ``_error`` (unpadded).

    The prompt is tokenized on its own (truncated to ``max_length``) and that
    many leading labels are masked; an empty prompt masks nothing. A row whose
    labels are all masked gets ``NO_RESPONSE_TOKENS``.
    """
    out = _encoded(df, K.get_tokenizer(tokenizer), max_length, text_col, prompt_col)
    out = out.withColumn("labels", K.mask_prefix(F.col("input_ids"), F.col("_n_masked")))
    return out.withColumn("_error", _no_response()).drop("_n_masked")


def _encoded(df: DataFrame, tok: Tokenizer, max_length: int, text_col: str, prompt_col: str | None) -> DataFrame:
    """Add ``input_ids`` and ``_n_masked`` (the prompt's number of ids), both from one
    expression, so that a user tokenizer runs once over a batch of rows."""
    prompt = F.lit("") if prompt_col is None else F.coalesce(F.col(prompt_col), F.lit(""))
    out = df.withColumn("_e", tok.encode_pair(F.col(text_col), prompt, max_length))
    return out.withColumns({"input_ids": F.col("_e.ids"), "_n_masked": F.col("_e.masked")}).drop("_e")


def _no_response() -> Column:
    """All labels are masked, or there is none."""
    return F.when(F.col("_n_masked") >= F.size("input_ids"), F.lit(NO_RESPONSE_TOKENS))


def run_widths(batch_id: np.ndarray, n: np.ndarray, batch_size: int) -> np.ndarray:
    """The greatest ``n`` of each run of equal batch ids, on all its rows; NaN where the
    run is not a whole batch."""
    first = np.flatnonzero(np.diff(batch_id, prepend=batch_id[0] - 1 if len(batch_id) else 0) != 0)
    if not len(first):
        return np.zeros(0)
    size = np.diff(np.append(first, len(batch_id)))
    return np.repeat(np.where(size == batch_size, np.maximum.reduceat(n, first), np.nan), size)


def local_widths(batch_id: Column, n: Column, batch_size: int) -> Column:
    """The widths of batches whose rows follow each other in one task, else NULL."""
    @F.pandas_udf("int")
    def widths(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ids, ns = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b, k in batches:
            ids, ns = np.concatenate([ids, b.to_numpy(np.int64)]), np.concatenate([ns, k.to_numpy(np.int64)])
            other = np.flatnonzero(ids != ids[-1]) if len(ids) else []
            last = int(other[-1]) + 1 if len(other) else 0  # where the last run begins
            if len(ids) - last >= batch_size:
                last = len(ids)
            if last:  # else the run may go on in the next Arrow batch
                yield pd.Series(run_widths(ids[:last], ns[:last], batch_size)).astype("Int32")
                ids, ns = ids[last:], ns[last:]
        if len(ids):
            yield pd.Series(run_widths(ids, ns, batch_size)).astype("Int32")

    return widths(batch_id, n)


def collate(df: DataFrame, tokenizer: Tokenizer | str | None = None, max_length: int = 1024,
            batch_size: int = 4, side: str = "right", text_col: str = "text",
            prompt_col: str | None = "prompt_text", order_col: str = "ord") -> DataFrame:
    """Rows ``(ord, text[, prompt_text])`` -> padded ``input_ids``, ``attention_mask``,
    ``labels`` per row, with ``batch_id = ord div batch_size``.

    Pads use the tokenizer's pad id (the end-of-sequence id when unset); pad
    labels are ``-100`` by position, so a real end-of-sequence id equal to the
    pad id keeps its label. A row whose text is NULL has NULL for all three and no part
    in its batch's width.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    if side not in ("left", "right"):
        raise ValueError("side must be 'left' or 'right'")
    spark = df.sparkSession
    checkpoint_root(spark)
    ship_package(spark)
    tok = K.get_tokenizer(tokenizer)
    keep = [c for c in df.columns if c not in (text_col, prompt_col)]
    narrow = df.select(
        *keep,
        F.floor(F.col(order_col) / batch_size).cast("bigint").alias("batch_id"),
        tok.prefix(F.col(text_col), max_length).alias("_t"),
        (tok.prefix(F.col(prompt_col), max_length) if prompt_col else F.lit("")).alias("_p"),
    )
    rows = _encoded(narrow, tok, max_length, "_t", "_p").drop("_t", "_p")
    rows = stored(rows.withColumn("_w", local_widths(F.col("batch_id"), F.coalesce(F.size("input_ids"), F.lit(0)), batch_size)), "tokens")
    cut = stored(rows.where("_w is null").groupBy("batch_id").agg(F.max(F.size("input_ids")).alias("_cut")), "cut-batches")
    whole = rows.join(maybe_broadcast(cut, cut.count()), "batch_id", "left")
    labelled = whole.withColumns({
        "_w": F.coalesce("_w", "_cut"), "_error": _no_response(),
        "labels": K.mask_prefix(F.col("input_ids"), F.col("_n_masked"))})
    return labelled.select(
        *keep, "batch_id",
        K.pad(F.col("input_ids"), F.col("_w"), tok.effective_pad_id, side).alias("input_ids"),
        K.attention_mask(F.size("input_ids"), F.col("_w"), side).alias("attention_mask"),
        K.pad(F.col("labels"), F.col("_w"), K.IGNORE_INDEX, side).alias("labels"),
        "_error",
    )


def check_tensors(df: DataFrame, order_col: str = "ord", known: str | None = None) -> DataFrame:
    """Fail on the first row whose response did not survive truncation. Rows for which the
    column ``known`` is set were reported before; they alone may keep an ``_error``."""
    failed = F.col("_error").isNotNull() & (F.col(known).isNull() if known else F.lit(True))
    bad = df.agg(F.min(F.when(failed, F.col(order_col))).alias("b")).collect()[0]["b"]
    if bad is not None:
        raise ValueError(f"row {bad}: {NO_RESPONSE_TOKENS} (every label within max_length is masked)")
    return df if known else df.drop("_error")


def effective_batch_size(per_device: int, accumulation: int = 1, devices: int = 1) -> int:
    return per_device * accumulation * devices


def training_batches(df: DataFrame, per_device: int = 1, accumulation: int = 4, devices: int = 1,
                     order_col: str = "ord") -> DataFrame:
    """Assign each row, in input order, an optimizer ``step``, a ``micro`` step
    and a device ``rank``: ``effective = per_device * accumulation * devices``
    rows per step. Pure arithmetic on ``ord``; no shuffle."""
    eff = effective_batch_size(per_device, accumulation, devices)
    o = F.col(order_col)
    pos = F.pmod(o, F.lit(eff))
    return df.withColumns({
        "step": F.floor(o / eff).cast("bigint"),
        "micro": F.floor(pos / (per_device * devices)).cast("bigint"),
        "rank": F.floor(F.pmod(pos, F.lit(per_device * devices)) / per_device).cast("bigint"),
    })
