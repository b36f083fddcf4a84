"""Bulk generation: prompts -> messages -> text -> repeated, batched work items
-> user model on executors -> gathered outputs widened onto the input rows.

Everything but the model call is DataFrame expressions. The model runs in
``applyInPandas`` grouped by ``batch_id`` (each group is one fixed-size batch,
so no group can grow with the data), built once per Python worker by a
user-supplied factory. Generations are written before the gather (by the job in
committed slices, else as a checkpoint), so a failure afterwards never repeats
model work.
"""

from __future__ import annotations

import hashlib
import json
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chat
from ..functions import text as T
from ..functions import tokens as K
from ..functions import variant as V
from ..session import checkpoint_root, ship_package

MESSAGES_NOT_LIST = "MESSAGES_NOT_LIST"
EMPTY_PROMPT = "EMPTY_PROMPT"

SEED_BITS = 31  # per-item seeds are the low bits of a digest of seed and work_idx


def prompt_messages(records: DataFrame, prompt_field: str = "prompt", messages_field: str = "messages",
                    system_prompt: str | None = None, rec_col: str = "rec") -> DataFrame:
    """Add ``messages ARRAY<VARIANT>`` and ``_error``.

    A present ``messages`` key (even null) must hold a list, passed on
    unchanged and without a system message; otherwise ``prompt`` must be a
    non-blank string, preceded by the system prompt when one is given.
    """
    rec = F.col(rec_col)
    mv = V.field(rec, messages_field)
    present = mv.isNotNull()
    arr = V.as_array(mv)
    prompt = V.as_string(V.field(rec, prompt_field))
    built = [F.to_variant_object(chat.message("user", prompt))]
    if system_prompt:
        built.insert(0, F.to_variant_object(chat.message("system", F.lit(system_prompt))))
    messages = F.when(present, arr).when(V.nonblank_string(rec, prompt_field), F.array(*built))
    error = (F.when(present & arr.isNull(), F.lit(MESSAGES_NOT_LIST))
             .when(~present & ~V.nonblank_string(rec, prompt_field), F.lit(EMPTY_PROMPT)))
    return records.withColumns({"messages": messages, "_error": error})


def render_prompt(messages: Column, template: chat.Template | str | None = None) -> Column:
    """Prompt text: the lenient ``role: content`` rendering when no template is
    given, else the template with its generation prompt."""
    if template is None:
        return chat.render_inference(messages)
    tpl = chat.get_template(template)
    if tpl.whole:
        return tpl.render_json(chat.messages_json(messages), True)
    return chat.render(chat.typed_messages(messages), template, True)


def generation_config(temperature: float | Column, top_p: float | Column, max_new_tokens: int) -> Column:
    """Sampling when ``temperature > 0`` (with temperature and top_p), else greedy
    with both unset."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    p = top_p if isinstance(top_p, Column) else F.lit(float(top_p))
    sample = t > 0
    return F.struct(sample.alias("do_sample"), F.when(sample, t).alias("temperature"),
                    F.when(sample, p).alias("top_p"), F.lit(int(max_new_tokens)).alias("max_new_tokens"))


def generation_options(temperature: float, top_p: float, max_new_tokens: int, pad_id: int) -> dict:
    """The same settings as ``generation_config`` for a model's ``generate``, with the id
    it pads with."""
    sample = temperature > 0
    return {"max_new_tokens": int(max_new_tokens), "do_sample": sample, "temperature": temperature if sample else None,
            "top_p": top_p if sample else None, "pad_token_id": int(pad_id)}


def item_seed(seed: int, work_idx: Column) -> Column:
    """A 31-bit seed per work item, from a digest of ``seed:work_idx``: any size of
    ``seed`` is accepted, and neighbouring seeds have nothing in common."""
    text = F.concat(F.lit(f"{int(seed)}:"), work_idx.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint").bitwiseAND(
        F.lit((1 << SEED_BITS) - 1))


def repeat_items(df: DataFrame, num_repeats: int, batch_size: int | None = None, seed: int | None = None,
                 order_col: str = "ord") -> DataFrame:
    """One work item per (row, repeat), row-major: ``work_idx = ord * n + rep``,
    ``batch_id = work_idx div batch_size``; optional per-item seed that does not
    depend on partitioning. Render before calling this: rows are rendered once."""
    if num_repeats < 1:
        raise ValueError("num_repeats must be >= 1")
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(num_repeats - 1))))
    out = out.withColumn("work_idx", F.col(order_col) * num_repeats + F.col("rep"))
    if batch_size is not None:
        if batch_size < 1:
            raise ValueError("batch_size must be >= 1")
        out = out.withColumn("batch_id", F.floor(F.col("work_idx") / batch_size).cast("bigint"))
    if seed is not None:
        out = out.withColumn("seed", item_seed(seed, F.col("work_idx")))
    return out


def pad_batches(items: DataFrame, tokenizer: K.Tokenizer | str | None = None, side: str = "left",
                text_col: str = "text", group_batches: int = 64, partitions: int | None = None) -> DataFrame:
    """Tokenize prompts and pad each batch to its longest row (left by default).

    Consecutive batches are grouped ``group_batches`` at a time (``_group``);
    one hash shuffle on ``_group`` serves both the batch-width window and the
    grouped model call, and every group holds at most
    ``group_batches * batch_size`` rows. The shuffle has an explicit partition
    count (default ``spark.sql.shuffle.partitions``) so adaptive execution does
    not merge small partitions: model work is CPU/GPU-bound, not byte-bound.
    """
    tok = K.get_tokenizer(tokenizer)
    n = int(partitions or items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = items.withColumn("_group", F.floor(F.col("batch_id") / int(group_batches)).cast("bigint")) \
        .repartition(n, "_group")
    ids = grouped.withColumn("input_ids", tok.encode_prompt(F.col(text_col)))
    width = F.max(F.size("input_ids")).over(Window.partitionBy("_group", "batch_id"))
    ids = ids.withColumn("_w", width)
    return ids.withColumns({
        "attention_mask": K.attention_mask(F.size("input_ids"), F.col("_w"), side),
        "input_ids": K.pad(F.col("input_ids"), F.col("_w"), tok.effective_pad_id, side),
    }).drop("_w")


_MODEL: dict[str, object] = {}


def factory_key(factory) -> str:
    """Digest of the pickled factory, made once on the driver: two closures of one
    function with different captured values are different models."""
    from pyspark import cloudpickle
    return hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()


def _model(key: str, factory):
    """One model per Python worker, kept across tasks while the key is the same;
    another factory replaces it."""
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = factory()
    return _MODEL[key]


def generate(items: DataFrame, model_factory: Callable[[], object], config: dict,
             checkpoint: bool = True) -> DataFrame:
    """Run ``model.generate(input_ids, attention_mask, config, seeds)`` once per batch.

    ``items`` carries ``work_idx, batch_id, input_ids, attention_mask`` and
    optionally ``seed`` and ``_group`` (from ``pad_batches``). Ids reach the
    model as numpy arrays; it returns full sequences (prompt + new ids), one
    integer sequence per row. Output: ``work_idx, n_input`` (padded prompt
    length) ``, output_ids``.
    """
    ship_package(items.sparkSession)
    has_seed = "seed" in items.columns
    key = "_group" if "_group" in items.columns else "batch_id"
    cols = ["work_idx", "batch_id", "input_ids", "attention_mask"] + (["seed"] if has_seed else [])
    cols += [key] if key != "batch_id" else []
    conf = dict(config)
    model_key = factory_key(model_factory)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = _model(model_key, model_factory)
        pdf = pdf.sort_values("work_idx", kind="stable")
        outs = []
        for _, b in pdf.groupby("batch_id", sort=True):
            seeds = [int(x) for x in b["seed"]] if has_seed else None
            res = model.generate(list(b["input_ids"]), list(b["attention_mask"]), conf, seeds)
            outs.append(pd.DataFrame({"work_idx": b["work_idx"].to_numpy(),
                                      "n_input": [len(x) for x in b["input_ids"]],
                                      "output_ids": [np.asarray(o, dtype=np.int32) for o in res]}))
        return pd.concat(outs, ignore_index=True) if outs else pd.DataFrame(
            {"work_idx": [], "n_input": [], "output_ids": []})

    gen = items.select(*cols).groupBy(key).applyInPandas(
        run, "work_idx bigint, n_input int, output_ids array<int>")
    if checkpoint:
        checkpoint_root(items.sparkSession)
        gen = gen.checkpoint(eager=True)
    return gen


def decode_outputs(gen: DataFrame, tokenizer: K.Tokenizer | str | None = None) -> DataFrame:
    """Keep ids after the padded prompt, decode skipping special ids, strip."""
    tok = K.get_tokenizer(tokenizer)
    new = K.new_tokens(F.col("output_ids"), F.col("n_input"))
    return gen.withColumn("output", T.ustrip(tok.decode(new)))


def gather(outputs: DataFrame, num_repeats: int, always_list: bool = False,
           output_col: str = "output") -> DataFrame:
    """``(ord, rep, output)`` -> one row per ``ord`` with outputs in repeat order;
    a scalar when ``num_repeats == 1`` unless ``always_list``. Groups hold
    ``num_repeats`` items."""
    g = outputs.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("rep", output_col))).alias("_o"))
    arr = F.col(f"_o.{output_col}")
    value = arr if (num_repeats > 1 or always_list) else F.element_at(arr, 1)
    return g.select("ord", value.alias(output_col))


def widen(records: DataFrame, gathered: DataFrame, output_field: str = "output", rec_col: str = "rec") -> DataFrame:
    """Original record plus ``output_field`` (an existing key of that exact name is
    replaced); positional re-join on ``ord``. Records with a ``raw`` text (integers that
    no VARIANT holds) get their widened text there too, for the sink: the text as it
    stands with the field put last, so that it wins over an earlier one."""
    has_raw = "raw" in records.columns
    j = records.select("ord", rec_col, *["raw"] * has_raw).join(gathered, "ord")
    as_map = F.col(rec_col).try_cast("map<string,variant>")
    kept = F.map_filter(as_map, lambda k, v: k != F.lit(output_field))
    out_v = F.to_variant_object(F.struct(F.col(output_field).alias("v")))
    added = F.create_map(F.lit(output_field), F.try_variant_get(out_v, "$.v", "variant"))
    wide = F.to_variant_object(F.map_concat(kept, added)).alias(rec_col)
    if not has_raw:
        return j.select("ord", wide)
    field = F.expr("substring(to_json(named_struct('v', {}), map('ignoreNullFields', 'false')), 5)".format(f"`{output_field}`"))
    text = F.concat(F.expr("left(raw, length(raw) - 1)"), F.lit("," + json.dumps(output_field, ensure_ascii=False)), field)
    return j.select("ord", wide, text.alias("raw"))


def batch_progress(items: DataFrame, batch_size: int) -> DataFrame:
    """Per batch: its size and generations done after it (fixed-size batches over
    dense ``work_idx``, so the running total is arithmetic, not a window)."""
    per = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"), F.max("work_idx").alias("_last"))
    return per.select("batch_id", "size", (F.col("_last") + 1).alias("done"))
