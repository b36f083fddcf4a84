"""End-to-end jobs: read -> transform -> (model / endpoint) -> write.

Each is a composition of the operators; options mirror the command lines
they replace and become keyword arguments.
"""

from __future__ import annotations

import logging
import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.chat import Template
from ..operators import api as A
from ..operators import collate as C
from ..operators import infer as I
from ..operators import sft
from ..sinks import json_sink as S
from ..sources.ordinals import table_ordinal
from ..sources.records import check_columns, raise_from_stats, scan_records
from .durable import WorkDir, input_digest

DEFAULT_SYSTEM_PROMPT = "You are a helpful assistant."

log = logging.getLogger("tessera")


def load_sft_dataset(spark: SparkSession, path: str, template: Template | str | None = None,
                     prompt_field: str = "prompt", response_field: str = "groundtruth",
                     split_field: str | None = None, split=None, response_only_loss: bool = True,
                     on_error: str = "fail") -> DataFrame:
    """J1: records file -> split filter -> (response-only) texts -> ``(ord, idx, text[, prompt_text])``.

    ``ord`` is the position in the file, ``idx`` the position among the rows
    that passed the split filter (the index the reference's dataset has).

    All checks (bad records, empty input, empty split, first bad example) come
    from one aggregate job; the returned DataFrame is lazy.

    ``on_error="keep"`` checks the same, but a record of the split that is no example is
    only logged: it stays in its place with its code in ``_error`` and what its fields
    give, unchecked, as texts. ``"report"`` raises for nothing and returns bad records too.
    """
    if on_error not in ("fail", "keep", "report"):
        raise ValueError("on_error must be 'fail', 'keep' or 'report'")
    use_split = bool(split_field) and split is not None
    select = (lambda rec: sft.split_condition(rec, split_field, split)) if use_split else (lambda rec: F.lit(True))
    recs, fmt, sel = scan_records(spark, path, "train", select=select, raw=False)
    cols = ["text", "prompt_text"] if response_only_loss else ["text"]
    proj = sft.project(sel, response_only_loss, template, prompt_field, response_field, unchecked=on_error == "keep")
    if on_error == "report":
        bad_recs = recs.where(F.col("_error").isNotNull()).select(
            "ord", F.lit(None).cast("bigint").alias("idx"), *[F.lit(None).cast("string").alias(c) for c in cols],
            "_error")
        return proj.select("ord", "idx", *cols, "_error").unionByName(bad_recs)
    # One aggregate job checks records and examples together: the projection
    # is evaluated on every record, flagged by the split predicate.
    flagged = recs.withColumnRenamed("_error", "_rec_error")
    flagged = flagged.withColumn("_sel", F.col("_rec_error").isNull() & select(F.col("rec")))
    checked = sft.project(flagged, response_only_loss, template, prompt_field, response_field)
    no_example = F.col("_sel") & F.col("_error").isNotNull()
    stats = checked.agg(*check_columns("_rec_error"), F.count_if("_sel").alias("_n_sel"),
                        F.count_if(no_example).alias("_n_bad"), F.min(F.when(no_example, F.col("ord"))).alias("_bad")
                        ).collect()[0]
    raise_from_stats(stats, recs, path, "train", fmt)
    log.info("Loaded %d records from %s; %d selected", stats["_c_n"], path, stats["_n_sel"])
    if stats["_n_sel"] == 0:
        if use_split:
            raise ValueError(f"{path}: no record has {split!r} in '{split_field}'")
        raise ValueError(f"{path}: no records to train on")
    if stats["_bad"] is not None and on_error == "keep":
        log.warning("%s: %d of %d records are no examples, first record %d", path, stats["_n_bad"], stats["_n_sel"], stats["_bad"])
    elif stats["_bad"] is not None:
        bad = proj.where(F.col("ord") == stats["_bad"]).select("idx", "_error").collect()[0]
        raise ValueError(f"{path}: record {stats['_bad']} (index {bad['idx']}): "
                         + sft.says(bad["_error"], response_only_loss, prompt_field, response_field))
    return proj.select("ord", "idx", *cols, *(["_error"] if on_error == "keep" else []))


def save_sft_dataset(dataset: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write J1's dataset (``ord, idx, text[, prompt_text]``) as Parquet."""
    S.write_dataset(dataset, path, overwrite)


def load_sft_jsonl(spark: SparkSession, path: str, template: Template | str | None = None) -> DataFrame:
    """Backward-compatible loader: a file, a template and every other option's default."""
    return load_sft_dataset(spark, path, template)


def training_tensors(dataset: DataFrame, tokenizer: K.Tokenizer | str | None = None, max_length: int = 1024,
                     batch_size: int = 4, side: str = "right", loss_on_prompt: bool = False,
                     check: bool = True) -> DataFrame:
    """J4: dataset ``(ord[, idx], text[, prompt_text])`` -> padded ids, mask and labels per row,
    in batches of ``batch_size`` consecutive ``idx``. J1's ``_error``, if it is there, goes
    along as ``example_error``; rows that have it pass the check and keep ``_error`` beside it."""
    prompt_col = None if loss_on_prompt or "prompt_text" not in dataset.columns else "prompt_text"
    # Batches are formed over the rows that survived the split filter: J1
    # already numbers them (``idx``); other inputs are numbered by ``ord``.
    dataset = dataset.withColumnRenamed("_error", "example_error")
    dense = dataset if "idx" in dataset.columns else table_ordinal(dataset, "ord", name="idx")
    out = C.collate(dense, tokenizer, max_length, batch_size, side, prompt_col=prompt_col, order_col="idx")
    return C.check_tensors(out, "idx", "example_error" if "example_error" in out.columns else None) if check else out


def checked_prompts(spark: SparkSession, path: str, dialect: str, prompt_field: str = "prompt",
                    messages_field: str = "messages", system_prompt: str | None = DEFAULT_SYSTEM_PROMPT):
    """Read records and build their messages; bad records and rows without a
    usable prompt are found by one aggregate job, before any model or endpoint
    call. Returns the rows ``(ord, rec, messages, raw)`` and their number."""
    recs, fmt, _ = scan_records(spark, path, dialect)
    pm = I.prompt_messages(recs.withColumnRenamed("_error", "_rec_error"), prompt_field, messages_field,
                           system_prompt)
    stats = pm.agg(*check_columns("_rec_error"),
                   F.min(F.when(F.col("_rec_error").isNull() & F.col("_error").isNotNull(), F.col("ord")))
                   .alias("_bad")).collect()[0]
    raise_from_stats(stats, recs, path, dialect, fmt)
    log.info("Loaded %d rows from %s", stats["_c_n"], path)
    if stats["_bad"] is not None:
        code = pm.where(F.col("ord") == stats["_bad"]).select("_error").collect()[0]["_error"]
        raise ValueError(f"{path}: record {stats['_bad']}: {code} (needs text in '{prompt_field}' or an array in '{messages_field}')")
    return pm.select("ord", "rec", "messages", "raw"), stats["_c_n"]


def batch_inference(spark: SparkSession, input_path: str, output_path: str, model_factory: Callable[[], object],
                    tokenizer: K.Tokenizer | str | None = None, num_repeats: int = 1, batch_size: int = 4,
                    always_list_output: bool = False, output_field: str = "output", output_format: str = "auto",
                    max_new_tokens: int = 256, temperature: float = 0.7, top_p: float = 0.9,
                    seed: int | None = None, overwrite: bool = False, template: Template | str | None = None,
                    prompt_field: str = "prompt", messages_field: str = "messages",
                    system_prompt: str | None = DEFAULT_SYSTEM_PROMPT, work_dir: str | None = None,
                    slice_batches: int = 16_384, in_flight: int = 2) -> DataFrame:
    """J2: records -> prompts -> generations -> widened records written in input order.
    Returns the widened records ``(ord, rec)``.

    Rendered prompts are written once, in slices of ``slice_batches`` whole batches;
    generations are committed slice by slice, ``in_flight`` slices at a time. With
    ``work_dir`` an interrupted run, started again on the same folder by any session,
    reads no input again and generates only the slices that are missing; batches, seeds
    and results are those of an uninterrupted run."""
    if num_repeats < 1:
        raise ValueError("num_repeats must be >= 1")
    if batch_size < 1 or slice_batches < 1:
        raise ValueError("batch_size and slice_batches must be >= 1")
    S.check_output(spark, output_path, overwrite)
    tok = K.get_tokenizer(tokenizer)
    config = I.generation_options(temperature, top_p, max_new_tokens, tok.effective_pad_id)
    # Rows of a slice: a number of items that whole batches make up.
    rows = slice_batches * batch_size // math.gcd(slice_batches * batch_size, num_repeats)
    work = WorkDir(spark, work_dir, "batch-inference", {
        "input": input_digest(spark, input_path), "num_repeats": num_repeats, "batch_size": batch_size, "config": config, "seed": seed,
        "template": template if isinstance(template, str) else type(template).__name__, "tokenizer": tok.name,
        "prompt_field": prompt_field, "messages_field": messages_field, "system_prompt": system_prompt, "slice_rows": rows})

    def prompts() -> DataFrame:
        pm, _ = checked_prompts(spark, input_path, "infer", prompt_field, messages_field, system_prompt)
        return pm.select("ord", "rec", "raw", I.render_prompt(F.col("messages"), template).alias("text"),
                         F.floor(F.col("ord") / rows).cast("bigint").alias("slice"))

    prompt_schema = "ord bigint, rec variant, raw string, text string"
    work.write_inputs("prompts", prompts)

    def generate(k: int, _: int):
        texts = work.read_slice("prompts", k, prompt_schema).select("ord", "text")
        padded = I.pad_batches(I.repeat_items(texts, num_repeats, batch_size, seed), tok, "left")
        gen = I.generate(padded, model_factory, config, checkpoint=False)
        # Row-major layout: (ord, rep) follow from work_idx, no join back to the items.
        return I.decode_outputs(gen, tok).select(
            F.floor(F.col("work_idx") / num_repeats).cast("bigint").alias("ord"),
            F.pmod(F.col("work_idx"), F.lit(num_repeats)).cast("bigint").alias("rep"), "output"), []

    work.run("prompts", "outputs", generate, in_flight)
    outs = work.read("outputs", "ord bigint, rep bigint, output string")
    gathered = I.gather(outs, num_repeats, always_list_output).withColumnRenamed("output", output_field)
    wide = I.widen(work.read("prompts", prompt_schema), gathered, output_field)
    S.write_records(wide, output_path, output_format, "rec", "ord", overwrite, text="raw")
    return wide.drop("raw")


_REQUEST = "ord bigint, body string, _carry_id string, _carry_prompt string"
_RESPONSE = A.RESPONSE_SCHEMA + ", _carry_id string, _carry_prompt string"


def api_inference(spark: SparkSession, input_path: str, output_path: str | None, base_url: str, model: str,
                  transport: A.Transport | None = None, prompt_field: str = "prompt",
                  messages_field: str = "messages", system_prompt: str | None = DEFAULT_SYSTEM_PROMPT,
                  max_tokens: int = 512, temperature: float = 0.7, top_p: float = 0.9, concurrency: int = 4,
                  timeout: float = 120.0, api_key: str | None = None, id_field: str = "id",
                  overwrite: bool = False, done: DataFrame | None = None, tasks: int | None = None,
                  work_dir: str | None = None, slice_rows: int = 2000, retry_failed: bool = False) -> DataFrame:
    """J3: JSONL -> messages -> one chat completion per row -> results in input order.

    Requests are written once, in slices of at most ``slice_rows``; each slice is one task
    with its share of ``concurrency``, committed when its calls have ended, and ``tasks``
    of them (default: one a core, not more than calls) run side by side. With ``work_dir``
    an interrupted run, started again on the same folder, calls only the rows of slices
    that are missing; ``retry_failed`` calls once more the rows whose last answer is an
    error. ``done``: results of an earlier run (with ``index``); those rows are not called
    and are unioned into the output.
    """
    A.check_field_names(id_field, prompt_field)
    if output_path:
        S.check_output(spark, output_path, overwrite)
    work = WorkDir(spark, work_dir, "api-inference", {
        "input": input_digest(spark, input_path), "url": A.endpoint_url(base_url), "model": model, "max_tokens": max_tokens,
        "temperature": temperature, "top_p": top_p, "prompt_field": prompt_field, "messages_field": messages_field,
        "system_prompt": system_prompt, "id_field": id_field})
    widths = A.shares(concurrency, tasks or min(concurrency, spark.sparkContext.defaultParallelism))

    def sliced(req: DataFrame, n: int) -> DataFrame:
        """So many rows a slice that all calls are in flight even for few rows."""
        rows = max(1, min(slice_rows, -(-n // (4 * len(widths)))))
        return req.withColumn("slice", F.floor(F.col("ord") / rows).cast("bigint"))

    def requests() -> DataFrame:
        pm, n = checked_prompts(spark, input_path, "api", prompt_field, messages_field, system_prompt)
        req = pm.select("ord", A.request_body(F.col("messages"), model, max_tokens, temperature, top_p).alias("body"),
                        *A.carried_fields(F.col("rec"), id_field, prompt_field, F.col("raw")))
        if done is not None:
            req = req.join(done.select(F.col("index").alias("ord")), "ord", "left_anti")
        return sliced(req, n)

    def attempt(i: int) -> DataFrame:
        """All answers of the ``i``-th round of calls, those not there yet called now."""
        def ask(k: int, lane: int):
            resp = A.call(work.read_slice(f"requests-{i}", k, _REQUEST), A.endpoint_url(base_url), api_key, transport, timeout,
                          widths[lane], checkpoint=False, tasks=1, carry=["_carry_id", "_carry_prompt"])
            return resp, [F.count_if(F.col("exc").isNull() & (F.col("status") < 400)).alias("answered")]
        work.run(f"requests-{i}", f"responses-{i}", ask, len(widths))
        return work.read(f"responses-{i}", _RESPONSE) if work.slices(f"requests-{i}") else spark.createDataFrame([], _RESPONSE)

    work.write_inputs("requests-0", requests)
    resp, last = attempt(0), 0
    while work.has(f"requests-{last + 1}"):  # retries of earlier runs, whole or not
        last += 1
        resp = resp.join(work.read(f"requests-{last}", _REQUEST).select("ord"), "ord", "left_anti").unionByName(attempt(last))
    if retry_failed:
        failed = A.envelope(resp).where("not ok").select("ord")
        n = failed.count()
        if n:
            last += 1
            again = work.read("requests-0", _REQUEST).join(failed, "ord", "left_semi")
            work.write_inputs(f"requests-{last}", lambda: sliced(again, n))
            resp = resp.join(failed, "ord", "left_anti").unionByName(attempt(last))
    # id / prompt travelled with each request: no join back to the input.
    res = A.results_carried(resp, id_field, prompt_field)
    if done is not None:
        res = res.unionByName(done, allowMissingColumns=True).orderBy("index")
    if output_path:
        out = res.select(F.col("index").alias("ord"), A.result_record(res, id_field, prompt_field).alias("rec"), "_id_text", "_prompt_text")
        out = out.withColumn("text", A.result_text(F.col("rec"), id_field, prompt_field))
        S.write_jsonl(out, output_path, "rec", "ord", overwrite, text="text")
    return res.drop("_id_text", "_prompt_text")


def read_results(spark: SparkSession, path: str, id_field: str = "id", prompt_field: str = "prompt") -> DataFrame:
    """Read a results file written by ``api_inference`` back into the result
    schema, e.g. to pass its answered rows as ``done`` when resuming."""
    from ..functions import variant as V
    from ..sources.records import read_records
    r = F.col("rec")
    return read_records(spark, path, "api").select(
        F.variant_get(r, "$.index", "bigint").alias("index"),
        F.variant_get(r, "$.ok", "boolean").alias("ok"),
        F.try_variant_get(r, "$.response", "string").alias("response"),
        F.try_variant_get(r, "$.raw_response", "variant").alias("raw_response"),
        F.try_variant_get(r, "$.error", "string").alias("error"),
        F.try_variant_get(r, "$.latency_sec", "double").alias("latency_sec"),
        V.field(r, id_field).alias(id_field),
        V.field(r, prompt_field).alias(prompt_field),
    )
