"""Chat-completion calls as a Spark job.

Requests are built with column expressions (``messages`` stays VARIANT, so
extra fields and non-string content are forwarded unchanged). Calls run in
``mapInArrow`` with a sliding window of calls per task; each row gets a response or a
captured error, never a failed task. Responses are written right after the calls so no
later action repeats a paid request; parsing the response and building the result
envelope are column expressions again.
"""

from __future__ import annotations

import json
import os
import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, as_completed, wait
from typing import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from ..session import checkpoint_root, ship_package

Transport = Callable[[str, bytes, dict, float], tuple[int, str]]


def endpoint_url(base_url: str) -> str:
    return base_url.rstrip("/") + "/chat/completions"


def resolve_api_key(api_key: str | None = None) -> str:
    """Argument, else ``OPENAI_API_KEY`` from the driver's environment, else ``EMPTY``.
    Resolved once on the driver; never stored in rows."""
    return api_key or os.environ.get("OPENAI_API_KEY") or "EMPTY"


def request_body(messages: Column, model: str, max_tokens: int = 512, temperature: float = 0.7,
                 top_p: float = 0.9) -> Column:
    """The JSON request body, non-ASCII unescaped."""
    return F.to_json(F.struct(F.lit(model).alias("model"), messages.alias("messages"),
                              F.lit(int(max_tokens)).alias("max_tokens"),
                              F.lit(float(temperature)).alias("temperature"), F.lit(float(top_p)).alias("top_p")))


def http_transport(url: str, body: bytes, headers: dict, timeout: float) -> tuple[int, str]:
    """POST with the standard library; HTTP errors come back as (status, body)."""
    import urllib.error
    import urllib.request

    req = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(req, timeout=timeout) as resp:
            return resp.status, resp.read().decode("utf-8")
    except urllib.error.HTTPError as exc:
        return exc.code, exc.read().decode("utf-8", errors="replace")


RESPONSE_SCHEMA = "ord bigint, status int, body string, exc string, latency_sec double"


EMIT_ROWS = 32  # answers that leave a task together, at most


def shares(concurrency: int, tasks: int) -> list[int]:
    """Calls in flight for each task: all of ``concurrency``, one each at least."""
    tasks = max(1, min(int(tasks), int(concurrency)))
    return [concurrency // tasks + (i < concurrency % tasks) for i in range(tasks)]


def windowed(rows, send: Callable, width: int):
    """``send(row)`` for all rows with at most ``width`` calls in flight: the next one
    begins when any of them ends. Yields lists of what the calls return, in the order of
    their ends, so a slow call holds up nothing but itself."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        flying, ready = set(), []
        for row in rows:
            if len(flying) >= width:
                ended, flying = wait(flying, return_when=FIRST_COMPLETED)
                ready += [f.result() for f in ended]
            flying.add(pool.submit(send, row))
            if len(ready) >= EMIT_ROWS:
                yield ready
                ready = []
        for f in as_completed(flying):
            ready.append(f.result())
            if len(ready) >= EMIT_ROWS:
                yield ready
                ready = []
        if ready:
            yield ready


def call(requests: DataFrame, url: str, api_key: str | None = None, transport: Transport | None = None,
         timeout: float = 120.0, concurrency: int = 4, checkpoint: bool = True,
         tasks: int | None = None, carry: list[str] | tuple = ()) -> DataFrame:
    """``(ord, body)`` -> ``(ord, status, body, exc, latency_sec)``, one call per row.

    ``concurrency`` is the number of calls in flight in all: the requests are
    spread over ``tasks`` tasks (default: as many as ``concurrency``), and each task keeps
    a sliding window of its share of the calls, the remainder included. No retry: a
    failure is a row. With ``checkpoint`` the answers are written before anything reads
    them. ``carry`` names string columns passed through unchanged.
    """
    ship_package(requests.sparkSession)
    send = transport or http_transport
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {resolve_api_key(api_key)}"}
    widths = shares(int(concurrency), int(tasks or concurrency))
    requests = requests.coalesce(1) if len(widths) == 1 else requests.repartition(len(widths))
    carried = list(carry)

    def one(row: tuple) -> tuple:
        ord_, body, *rest = row
        started = time.time()
        try:
            status, text = send(url, body.encode("utf-8"), headers, timeout)
            return (ord_, int(status), text, None, round(time.time() - started, 4), *rest)
        except Exception as exc:  # noqa: BLE001 - every service error becomes a row
            return (ord_, None, None, repr(exc), round(time.time() - started, 4), *rest)

    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), *[pa.string()] * len(carried)]
    names = ["ord", "status", "body", "exc", "latency_sec", *carried]

    def run(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for answers in windowed(rows, one, widths[TaskContext.get().partitionId() % len(widths)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*answers), types)], names=names)

    schema = RESPONSE_SCHEMA + "".join(f", {c} string" for c in carried)
    out = requests.select("ord", "body", *carried).mapInArrow(run, schema)
    if checkpoint:
        checkpoint_root(requests.sparkSession)
        out = out.checkpoint(eager=True)
    return out


def envelope(responses: DataFrame) -> DataFrame:
    """Add ``ok, response, raw_response, error`` from ``status, body, exc``.

    Content is ``choices[0].message.content``; a missing piece is reported the
    way a Python lookup would fail (``KeyError('choices')`` ...). A null content
    is still ``ok``.
    """
    status, exc = F.col("status"), F.col("exc")
    http_ok = exc.isNull() & (status < 400)
    raw = F.when(http_ok, F.try_parse_json(F.col("body")))
    choices = F.try_variant_get(raw, "$.choices", "variant")
    first = F.try_variant_get(raw, "$.choices[0]", "variant")
    msg = F.try_variant_get(raw, "$.choices[0].message", "variant")
    content = F.try_variant_get(raw, "$.choices[0].message.content", "variant")
    error = (
        F.when(exc.isNotNull(), exc)
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.col("body")))
        .when(raw.isNull(), F.lit("JSONDecodeError('Expecting value')"))
        .when(choices.isNull(), F.lit("KeyError('choices')"))
        .when(first.isNull(), F.lit("IndexError('list index out of range')"))
        .when(msg.isNull(), F.lit("KeyError('message')"))
        .when(content.isNull(), F.lit("KeyError('content')"))
    )
    ok = error.isNull()
    text = F.when(V.is_string(content), F.variant_get(content, "$", "string")) \
        .when(~V.is_variant_null(content), F.to_json(content))
    return responses.withColumns({
        "ok": ok,
        "response": F.when(ok, text),
        "raw_response": F.when(ok, raw),
        "error": error,
    })


def results(records: DataFrame, responses: DataFrame, id_field: str = "id", prompt_field: str = "prompt",
            rec_col: str = "rec") -> DataFrame:
    """The per-row result: ``index`` + envelope + copies of ``id`` / ``prompt``
    when the key is present (also for message rows), in input order."""
    env = envelope(responses)
    # Only the two copied fields travel through the join, not whole records.
    copied = records.select("ord", V.field(F.col(rec_col), id_field).alias(id_field),
                            V.field(F.col(rec_col), prompt_field).alias(prompt_field))
    j = env.join(copied, "ord")
    return j.select(
        F.col("ord").alias("index"), "ok", "response", "raw_response", "error", "latency_sec",
        id_field, prompt_field,
    ).orderBy("index")


def _field_text(rec: Column, name: str, raw: Column | None) -> Column:
    """A field as JSON text. Where the record's own text is kept in ``raw``, as a VARIANT
    has not all digits of its integers, the field stands as it does there; of a key that
    occurs twice with different values, the last one's as the VARIANT has it."""
    value = V.field(rec, name)
    text = F.to_json(value)
    if raw is None or any(c in name for c in "'?\\"):
        return text
    exact = F.get_json_object(raw, f"$['{name}']")
    agrees = ~V.is_string(value) & (F.to_json(F.try_parse_json(exact)) == text)
    return F.when(raw.isNotNull() & agrees, exact).otherwise(text)


def carried_fields(rec: Column, id_field: str = "id", prompt_field: str = "prompt", raw: Column | None = None) -> list[Column]:
    """``id`` / ``prompt`` as JSON text for ``call(carry=...)``: NULL when the key
    is missing, ``"null"`` when it holds JSON null."""
    return [_field_text(rec, id_field, raw).alias("_carry_id"), _field_text(rec, prompt_field, raw).alias("_carry_prompt")]


# Columns of a result besides the copied fields.
RESULT_KEYS = ("index", "ok", "response", "raw_response", "error", "latency_sec")


def check_field_names(id_field: str, prompt_field: str) -> None:
    """Raise before any call if the copied fields would collide in the results."""
    taken = {k.lower() for k in RESULT_KEYS}
    for name in (id_field, prompt_field):
        if name.lower() in taken:
            raise ValueError(f"{name!r} is a column of the results and cannot be copied from the input")
    if id_field.lower() == prompt_field.lower():
        raise ValueError("id_field and prompt_field must differ")


def results_carried(responses: DataFrame, id_field: str = "id", prompt_field: str = "prompt") -> DataFrame:
    """The per-row result from responses that carried ``id`` / ``prompt`` along
    (no join back to the records), in input order. ``_id_text`` / ``_prompt_text``: the
    text of a field with an integer that its VARIANT has not all digits of, for the sink."""
    env = envelope(responses)
    exact = [F.when(F.col(c).rlike("[0-9]{39}") & ~F.col(c).startswith('"'), F.col(c)) for c in ("_carry_id", "_carry_prompt")]
    return env.select(
        F.col("ord").alias("index"), "ok", "response", "raw_response", "error", "latency_sec",
        F.parse_json(F.col("_carry_id")).alias(id_field),
        F.parse_json(F.col("_carry_prompt")).alias(prompt_field),
        exact[0].alias("_id_text"), exact[1].alias("_prompt_text"),
    ).orderBy("index")


def result_record(res: DataFrame, id_field: str = "id", prompt_field: str = "prompt") -> Column:
    """One VARIANT object per result with the keys the row really has:
    ``response``/``raw_response`` only when ok, ``error`` only when not, ``id`` /
    ``prompt`` only when present in the input."""
    def entry(key, value):
        return F.struct(F.lit(key).alias("k"), F.try_variant_get(
            F.to_variant_object(F.struct(value.alias("v"))), "$.v", "variant").alias("v"))

    items = F.array(
        entry("index", F.col("index")), entry("ok", F.col("ok")),
        F.when(F.col("ok"), entry("response", F.col("response"))),
        F.when(F.col("ok"), F.struct(F.lit("raw_response").alias("k"), F.col("raw_response").alias("v"))),
        F.when(~F.col("ok"), entry("error", F.col("error"))),
        entry("latency_sec", F.col("latency_sec")),
        F.when(F.col(id_field).isNotNull(), F.struct(F.lit(id_field).alias("k"), F.col(id_field).alias("v"))),
        F.when(F.col(prompt_field).isNotNull(),
               F.struct(F.lit(prompt_field).alias("k"), F.col(prompt_field).alias("v"))),
    )
    present = F.filter(items, lambda x: x.isNotNull())
    return F.to_variant_object(F.map_from_entries(present))


def result_text(rec: Column, id_field: str = "id", prompt_field: str = "prompt") -> Column:
    """The JSON of a result whose ``id`` or ``prompt`` goes into the file as its text
    (``_id_text``, ``_prompt_text``), put last so that it wins; NULL for all others."""
    def entry(name, text):
        return F.coalesce(F.concat(F.lit("," + json.dumps(name, ensure_ascii=False) + ":"), F.col(text)), F.lit(""))

    rest = F.map_filter(rec.try_cast("map<string,variant>"), lambda k, _: ~(
        ((k == F.lit(id_field)) & F.col("_id_text").isNotNull()) | ((k == F.lit(prompt_field)) & F.col("_prompt_text").isNotNull())))
    made = F.to_json(F.to_variant_object(rest), {"ignoreNullFields": "false"})
    return F.when(F.col("_id_text").isNotNull() | F.col("_prompt_text").isNotNull(), F.concat(
        made.substr(F.lit(1), F.length(made) - 1), entry(id_field, "_id_text"), entry(prompt_field, "_prompt_text"), F.lit("}")))


def status_summary(res: DataFrame) -> DataFrame:
    """Rows per outcome (``ok`` true / false)."""
    return res.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))
