"""Records -> supervised fine-tuning text (full-sequence or response-only).

All projections are narrow CASE chains over the record's VARIANT column, so
they run inside whole-stage codegen with no shuffle. Rows that cannot be
converted get an error code in ``_error`` instead of raising, so a bad row is
reported with its position; ``on_error="fail"`` turns the first one into an
exception the way the single-process loader does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chat
from ..functions import variant as V
from ..functions.chat import Template
from ..functions.text import is_nonblank

# Error codes (fixed values).
MESSAGE_FIELDS = "MESSAGE_FIELDS"
LAST_NOT_ASSISTANT = "LAST_NOT_ASSISTANT"
NO_PROMPT_MESSAGE = "NO_PROMPT_MESSAGE"
UNSUPPORTED_ROW = "UNSUPPORTED_ROW"

def says(code: str, response_only_loss: bool, prompt_field: str, response_field: str) -> str:
    """An error code with the fields that it is about."""
    if code == MESSAGE_FIELDS:
        about = "messages[*].role and messages[*].content are texts"
    elif code == LAST_NOT_ASSISTANT:
        about = "messages[-1].role is 'assistant' and its content a text"
    elif code == NO_PROMPT_MESSAGE:
        about = "messages[-1] answers a message before it"
    else:
        pair = f"'{prompt_field}' with '{response_field}'"
        order = ["messages", pair, "text"] if response_only_loss else ["text", "messages", pair]
        about = "looked for " + ", then ".join(order)
    return f"{code} ({about})"


def _stage_fields(df: DataFrame, rec_col: str, prompt_field: str, response_field: str) -> DataFrame:
    """Extract each field once into its own column (separate projections keep
    Catalyst from re-inlining variant extraction into every later reference)."""
    rec = F.col(rec_col)
    return df.withColumns({
        "_m": V.as_array(V.field(rec, "messages")),
        "_t": V.as_string(V.field(rec, "text")),
        "_p": V.as_string(V.field(rec, prompt_field)),
        "_r": V.as_string(V.field(rec, response_field)),
    }).withColumns({
        "_m_ok": F.coalesce(F.size("_m") > 0, F.lit(False)),
        "_t_ok": is_nonblank(F.col("_t")),
        "_pair_ok": is_nonblank(F.col("_p")) & is_nonblank(F.col("_r")),
    })


_STAGE_COLS = ["_m", "_t", "_p", "_r", "_m_ok", "_t_ok", "_pair_ok"]


def full_text_df(df: DataFrame, template: Template | str | None = None, prompt_field: str = "prompt",
                 response_field: str = "groundtruth", rec_col: str = "rec", unchecked: bool = False) -> DataFrame:
    """Add ``text`` and ``_error``: ``text`` first, then ``messages``, then the pair.
    ``unchecked`` as in ``response_only_df``."""
    tpl = chat.get_template(template)
    st = _stage_fields(df, rec_col, prompt_field, response_field)
    pair = F.array(chat.message("user", F.col("_p")), chat.message("assistant", F.col("_r")))
    if tpl.whole:
        st = st.withColumns({"_m_valid": F.lit(True), "_whole": tpl.render_json(
            F.when(~F.col("_t_ok"), F.when(F.col("_m_ok"), chat.messages_json(F.col("_m")))
                   .when(F.col("_pair_ok"), chat.messages_json(pair))), False)})
    else:
        st = st.withColumn("_m_valid", chat.all_valid(F.col("_m")))
    text = F.when(F.col("_t_ok"), F.col("_t")).otherwise(F.col("_whole")) if tpl.whole else (F.when(F.col("_t_ok"), F.col("_t"))
            .when(F.col("_m_ok") & F.col("_m_valid"), tpl.render(chat.typed_messages(F.col("_m")), False))
            .when(~F.col("_m_ok") & F.col("_pair_ok"), tpl.render(pair, False)))
    error = (F.when(F.col("_t_ok"), F.lit(None))
             .when(F.col("_m_ok"), F.when(~F.col("_m_valid"), F.lit(MESSAGE_FIELDS)))
             .when(F.col("_pair_ok"), F.lit(None))
             .otherwise(F.lit(UNSUPPORTED_ROW)))
    if unchecked:
        p, r = F.col("_p").isNotNull(), F.col("_r").isNotNull()
        bare = ~F.col("_t_ok") & ~F.col("_m_ok") & ~F.col("_pair_ok")
        text = F.when(bare, F.when(p | r, tpl.render(F.when(bare & p & r, pair), False)).otherwise(F.col("_t"))).otherwise(text)
    return st.withColumns({"text": text, "_error": error}).drop(*_STAGE_COLS, "_m_valid", "_whole")


def _texts(df: DataFrame, prompt_msgs: str, answer: str, template, prefix: str, full_msgs: str | None = None) -> DataFrame:
    """Render prompt and full text once each. Where the full text does not begin with the
    prompt text, it becomes prompt text plus answer, so that the prompt can be masked.
    With ``full_msgs`` both columns hold JSON for a template that takes messages whole."""
    tpl = chat.get_template(template)
    pm, a = F.col(prompt_msgs), F.col(answer)
    df = df.withColumns({
        f"{prefix}_prompt": tpl.render_json(pm, True), f"{prefix}_full": tpl.render_json(F.col(full_msgs), False),
    }) if full_msgs else df.withColumns({
        f"{prefix}_prompt": tpl.render(pm, True),
        f"{prefix}_full": tpl.render(F.concat(pm, F.array(chat.message("assistant", a))), False),
    })
    aligned = F.startswith(F.col(f"{prefix}_full"), F.col(f"{prefix}_prompt"))
    return df.withColumn(f"{prefix}_text", F.when(aligned, F.col(f"{prefix}_full"))
                         .otherwise(F.concat(F.col(f"{prefix}_prompt"), a))).drop(f"{prefix}_full")


def response_only_df(df: DataFrame, template: Template | str | None = None, prompt_field: str = "prompt",
                     response_field: str = "groundtruth", rec_col: str = "rec", unchecked: bool = False) -> DataFrame:
    """Add ``text``, ``prompt_text`` and ``_error``: ``messages`` first, then the
    pair, then legacy ``text`` (which masks nothing). With ``unchecked`` a row of no
    usable shape has, beside its error, what its pair or else its text gives as it is,
    NULL where a field is missing."""
    whole = chat.get_template(template).whole
    st = _stage_fields(df, rec_col, prompt_field, response_field)
    n = F.size("_m")
    st = st.withColumns({
        "_last": F.try_element_at("_m", F.lit(-1)),
        "_pm": F.slice("_m", F.lit(1), F.greatest(n - 1, F.lit(0))),
    }).withColumns({
        "_last_obj": V.is_object(F.col("_last")),
        "_last_content": V.as_string(V.field(F.col("_last"), "content")),
        "_last_role": V.as_string(V.field(F.col("_last"), "role")),
        "_pm_valid": F.lit(True) if whole else chat.all_valid(F.col("_pm")),
    })
    msg_error = (F.when(~F.col("_last_obj"), F.lit(MESSAGE_FIELDS))
                 .when(~F.coalesce((F.col("_last_role") == "assistant") & F.col("_last_content").isNotNull(),
                                   F.lit(False)), F.lit(LAST_NOT_ASSISTANT))
                 .when(n == 1, F.lit(NO_PROMPT_MESSAGE))
                 .when(~F.col("_pm_valid"), F.lit(MESSAGE_FIELDS)))
    st = st.withColumn("_error", F.when(F.col("_m_ok"), msg_error)
                       .when(F.col("_pair_ok") | F.col("_t_ok"), F.lit(None))
                       .otherwise(F.lit(UNSUPPORTED_ROW)))
    # Render only what the row uses: prompt messages (typed, or JSON of the whole) and the answer.
    pair = [chat.message("user", F.col("_p")), chat.message("assistant", F.col("_r"))]
    use_pair = F.col("_pair_ok") | (F.lit(unchecked) & ~F.col("_t_ok") & F.col("_p").isNotNull())
    st = st.withColumns({
        "_tpm": F.when(F.col("_m_ok"), F.when(F.col("_error").isNull(), chat.messages_json(F.col("_pm"))))
                 .when(use_pair, chat.messages_json(F.array(pair[0]))),
        "_tfull": F.when(F.col("_m_ok"), F.when(F.col("_error").isNull(), chat.messages_json(F.col("_m"))))
                   .when(use_pair, chat.messages_json(F.array(*pair))),
        "_ans": F.when(F.col("_m_ok"), F.col("_last_content")).otherwise(F.col("_r")),
    }) if whole else st.withColumns({
        "_tpm": F.when(F.col("_m_ok"), F.when(F.col("_error").isNull(), chat.typed_messages(F.col("_pm"))))
                 .when(use_pair, F.array(pair[0])),
        "_ans": F.when(F.col("_m_ok"), F.col("_last_content")).otherwise(F.col("_r")),
    })
    st = _texts(st, "_tpm", "_ans", template, "_x", "_tfull" if whole else None)
    ok = F.col("_error").isNull()
    use = F.col("_m_ok") | F.col("_pair_ok")
    text = F.when(ok, F.when(use, F.col("_x_text")).otherwise(F.col("_t")))
    prompt = F.when(ok, F.when(use, F.col("_x_prompt")).otherwise(F.lit("")))
    if unchecked:
        bare, some = F.col("_error") == UNSUPPORTED_ROW, F.col("_p").isNotNull() | F.col("_r").isNotNull()
        text = text.when(bare, F.when(some, F.when(F.col("_r").isNotNull(), F.col("_x_text"))).otherwise(F.col("_t")))
        prompt = prompt.when(bare, F.when(some, F.col("_x_prompt")).otherwise(F.lit("")))
    st = st.withColumns({"text": text, "prompt_text": prompt})
    return st.drop(*_STAGE_COLS, "_last", "_pm", "_last_obj", "_last_content", "_last_role", "_pm_valid",
                   "_tpm", "_tfull", "_ans", "_x_text", "_x_prompt")


def response_only_typed(df: DataFrame, messages_col: str = "messages",
                        template: Template | str | None = None) -> DataFrame:
    """Response-only texts for rows that already hold typed messages
    (``ARRAY<STRUCT<role, content>>``, e.g. built from a table): same checks,
    no variant work. Adds ``text``, ``prompt_text``, ``_error``."""
    m = F.col(messages_col)
    n = F.size(m)
    last = F.try_element_at(m, F.lit(-1))
    valid = F.coalesce(F.forall(m, lambda x: x["role"].isNotNull() & x["content"].isNotNull()), F.lit(False))
    error = (F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(UNSUPPORTED_ROW))
             .when(~F.coalesce((last["role"] == "assistant") & last["content"].isNotNull(), F.lit(False)),
                   F.lit(LAST_NOT_ASSISTANT))
             .when(n == 1, F.lit(NO_PROMPT_MESSAGE))
             .when(~valid, F.lit(MESSAGE_FIELDS)))
    st = df.withColumn("_error", error).withColumns({
        "_tpm": F.when(F.col("_error").isNull(), F.slice(m, F.lit(1), n - 1)),
        "_ans": last["content"],
    })
    st = _texts(st, "_tpm", "_ans", template, "_x")
    return st.withColumnsRenamed({"_x_text": "text", "_x_prompt": "prompt_text"}).drop("_tpm", "_ans")


def response_only_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                        content: str = "text", template: Template | str | None = None) -> DataFrame:
    """Response-only texts straight from a table of turns ``(key, order, role, content)``.

    Each turn is rendered before the gather (a narrow, code-generated
    projection); the aggregate collects rendered pieces and the last turn; the
    texts are then slices and joins of those pieces (no lambda functions).
    Same checks as ``response_only_typed``. Needs a linear template.
    """
    tpl = chat.get_template(template)
    if not tpl.linear:
        msgs = chat.conversation_messages(turns.select(
            F.col(key).alias("conv_id"), F.col(order).alias("turn"), F.col(role).alias("role"),
            F.col(content).alias("text")))
        return response_only_typed(msgs.withColumnRenamed("conv_id", key), "messages", tpl)
    r, c, o = F.col(role), F.col(content), F.col(order)
    pieces = turns.select(key, order, role, content, tpl.message_text(r, c).alias("_piece"),
                          (r.isNull() | c.isNull()).alias("_invalid"))
    g = pieces.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(order, "_piece"))).alias("_parts"),
        F.max_by(F.struct(r.alias("role"), c.alias("content")), o).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.count_if("_invalid").alias("_n_invalid"),
    )
    n = F.col("_n")
    error = (F.when(~F.coalesce((F.col("_last.role") == "assistant") & F.col("_last.content").isNotNull(),
                                F.lit(False)), F.lit(LAST_NOT_ASSISTANT))
             .when(n == 1, F.lit(NO_PROMPT_MESSAGE))
             .when(F.col("_n_invalid") > 0, F.lit(MESSAGE_FIELDS)))
    lines = F.col("_parts._piece")
    g = g.withColumn("_error", error).withColumns({
        "_x_prompt": tpl.join(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(1))), True),
        "_x_full": tpl.join(lines, False),
    })
    aligned = F.startswith(F.col("_x_full"), F.col("_x_prompt"))
    ok = F.col("_error").isNull()
    return g.select(
        key,
        F.when(ok, F.when(aligned, F.col("_x_full")).otherwise(F.concat("_x_prompt", "_last.content"))).alias("text"),
        F.when(ok, F.col("_x_prompt")).alias("prompt_text"),
        "_error",
    )


def split_filter(df: DataFrame, split_field: str | None, split, rec_col: str = "rec") -> DataFrame:
    """Keep rows whose ``split_field`` equals ``split`` (no-op when either is unset).

    Equality follows JSON types: the string ``"1"`` never equals the number ``1``;
    a row without the key is dropped.
    """
    if not split_field or split is None:
        return df
    return df.where(split_condition(F.col(rec_col), split_field, split))


def split_condition(rec: Column, split_field: str, split) -> Column:
    """``rec.get(split_field) == split`` with JSON types (never NULL)."""
    v = V.field(rec, split_field)
    t = V.type_of(v)
    if isinstance(split, str):
        cond = V.is_string(v) & (F.variant_get(v, "$", "string") == F.lit(split))
    elif isinstance(split, (bool, int, float)):
        whole = t.isin("TINYINT", "SMALLINT", "INT", "BIGINT") | t.startswith("DECIMAL")
        numeric = t.isin("BOOLEAN", "FLOAT", "DOUBLE") | whole
        cond = numeric & (F.try_variant_get(v, "$", "double") == F.lit(float(split)))
        if isinstance(split, int) and abs(int(split)) < 10**38:
            # Integers beyond 2^53 are not told apart as doubles.
            exact = F.try_variant_get(v, "$", "decimal(38,0)") == F.lit(str(int(split))).cast("decimal(38,0)")
            cond = cond & F.when(whole, F.coalesce(exact, F.lit(False))).otherwise(F.lit(True))
    else:
        raise TypeError(f"unsupported split value type: {type(split).__name__}")
    return F.coalesce(cond, F.lit(False))


def project(df: DataFrame, response_only_loss: bool = True, template: Template | str | None = None,
            prompt_field: str = "prompt", response_field: str = "groundtruth", rec_col: str = "rec",
            unchecked: bool = False) -> DataFrame:
    """Add ``text`` (+ ``prompt_text``) and ``_error`` columns to a records DataFrame."""
    if response_only_loss:
        return response_only_df(df, template, prompt_field, response_field, rec_col, unchecked)
    return full_text_df(df, template, prompt_field, response_field, rec_col, unchecked)


def first_error(df: DataFrame, order_col: str = "ord"):
    """The row with the smallest ``order_col`` whose ``_error`` is set, or None.

    One distributed top-1 (``TakeOrderedAndProject``), no global sort.
    """
    rows = df.where(F.col("_error").isNotNull()).orderBy(order_col).limit(1).collect()
    return rows[0] if rows else None


def sft_dataset(records: DataFrame, response_only_loss: bool = True, template: Template | str | None = None,
                prompt_field: str = "prompt", response_field: str = "groundtruth",
                split_field: str | None = None, split=None, on_error: str = "fail",
                source: str = "<records>") -> DataFrame:
    """Load an SFT dataset from a records DataFrame ``(ord, rec, ...)``.

    Split filter, projection and validation. ``on_error="fail"`` raises on the
    first bad row with its index among the rows that passed the split filter
    (one aggregate job; one more only on the error path); ``"report"`` keeps
    ``ord``, ``_error`` and returns every row that passed the split.
    """
    if on_error not in ("fail", "report"):
        raise ValueError("on_error must be 'fail' or 'report'")
    use_split = bool(split_field) and split is not None
    sel = split_condition(F.col("rec"), split_field, split) if use_split else F.lit(True)
    projected = project(records.withColumn("_sel", sel), response_only_loss, template, prompt_field,
                        response_field)
    cols = ["text", "prompt_text"] if response_only_loss else ["text"]
    if on_error == "report":
        return projected.where("_sel").select("ord", *cols, "_error")
    stats = projected.agg(F.count_if("_sel").alias("n"),
                          F.min(F.when(F.col("_sel") & F.col("_error").isNotNull(), F.col("ord"))).alias("bad"),
                          ).collect()[0]
    if stats["n"] == 0:
        if use_split:
            raise ValueError(f"{source}: no record has {split!r} in '{split_field}'")
        raise ValueError(f"{source}: no records to train on")
    if stats["bad"] is not None:
        row = projected.where(F.col("ord") == stats["bad"]).select("_error").collect()[0]
        idx = projected.where(F.col("_sel") & (F.col("ord") < stats["bad"])).count()
        raise ValueError(f"{source}: record {stats['bad']} (index {idx}): "
                         + says(row["_error"], response_only_loss, prompt_field, response_field))
    return projected.where("_sel").select("ord", *cols)
