"""Messages and chat templates as column expressions.

A *typed* conversation is ``ARRAY<STRUCT<role STRING, content STRING>>``.
Records read from JSON hold ``messages`` as an ``ARRAY<VARIANT>``; they are
validated element by element *before* the cast, because casting a variant
turns the number ``1`` into the string ``'1'``.
"""

from __future__ import annotations

import json
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import variant as V

MESSAGE_TYPE = "array<struct<role:string,content:string>>"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def valid_message(e: Column) -> Column:
    """A JSON object whose ``role`` and ``content`` are both strings."""
    return V.is_object(e) & V.is_string(V.field(e, "role")) & V.is_string(V.field(e, "content"))


def all_valid(arr: Column) -> Column:
    return F.coalesce(F.forall(arr, valid_message), F.lit(False))


def typed_messages(arr: Column) -> Column:
    """``ARRAY<VARIANT>`` -> typed messages (call on validated arrays only)."""
    return F.transform(
        arr,
        lambda e: F.struct(
            F.try_variant_get(e, V.path("role"), "string").alias("role"),
            F.try_variant_get(e, V.path("content"), "string").alias("content"),
        ),
    )


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Flat ``(conv_id, turn, role, text)`` turns -> ``(conv_id, messages)``.

    One shuffle on ``conv_id``; the turns of one conversation form one training
    example, so they are gathered into one row by definition.
    """
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    g = conversations.groupBy("conv_id").agg(parts.alias("_parts"))
    # Field extraction and zip instead of a lambda: stays in generated code.
    return g.select("conv_id", F.arrays_zip(F.col("_parts.role"), F.col("_parts.text"))
                    .cast(MESSAGE_TYPE).alias("messages"))


# --------------------------------------------------------------------------
# Templates: (typed messages, add_generation_prompt) -> rendered text column.
# --------------------------------------------------------------------------


class Template:
    """Renders typed messages. *Linear* templates (all built-ins) render each
    message on its own and join the pieces, so messages stored as rows can be
    rendered before they are gathered (``message_text`` + ``join``)."""

    name = "template"
    linear = True
    whole = False  # takes messages as they stand in the record (``render_json``), unchecked
    separator = ""
    generation_prompt = ""

    def message_text(self, role: Column, content: Column) -> Column:  # pragma: no cover
        raise NotImplementedError

    def join(self, pieces: Column, add_generation_prompt: bool) -> Column:
        """Join rendered messages (``ARRAY<STRING>``), optionally adding the generation prompt."""
        if add_generation_prompt:
            pieces = F.concat(pieces, F.array(F.lit(self.generation_prompt)))
        return F.array_join(pieces, self.separator)

    def render(self, messages: Column, add_generation_prompt: bool) -> Column:
        pieces = F.transform(messages, lambda x: self.message_text(x["role"], x["content"]))
        return self.join(pieces, add_generation_prompt)


class RoleContentTemplate(Template):
    """``role: content`` lines joined by newlines; generation prompt ``assistant:``."""

    name = "role_content"
    separator = "\n"
    generation_prompt = "assistant:"

    def message_text(self, role, content):
        return F.concat(role, F.lit(": "), content)


class ChatMLTemplate(Template):
    """The public ChatML layout."""

    name = "chatml"
    generation_prompt = "<|im_start|>assistant\n"

    def message_text(self, role, content):
        return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


class InstructionTemplate(Template):
    """Headed blocks whose generation prompt (``### Response:``) differs from
    the assistant header, so the full text does not start with the prompt text
    and the prefix repair of response-only rendering is exercised."""

    name = "instruction"
    generation_prompt = "### Response:\n"

    def message_text(self, role, content):
        return F.concat(F.lit("### "), role, F.lit("\n"), content, F.lit("\n\n"))


class PythonTemplate(Template):
    """A user callable ``fn(messages: list[dict], add_generation_prompt) -> str``
    (for example a tokenizer's chat template), run through an Arrow-batched
    pandas UDF. The callable is built once per task by ``factory``.

    It gets the messages whole: other keys, contents that are no text and messages of
    any make are its own affair, so they travel as JSON and are not checked before."""

    name = "python"
    linear = False
    whole = True

    def __init__(self, factory: Callable[[], Callable[[list, bool], str]]):
        self.factory = factory

    def render_json(self, messages: Column, add_generation_prompt: bool) -> Column:
        """Render a JSON array of messages; NULL stays NULL."""
        from ..session import ship_package
        ship_package()
        factory = self.factory
        gen = bool(add_generation_prompt)

        @F.pandas_udf("string")
        def _render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            fn = factory()  # once per task
            for col in batches:
                yield pd.Series([None if m is None else fn(json.loads(m), gen) for m in col], dtype="object")

        return _render(messages)

    def render(self, messages, add_generation_prompt):
        return self.render_json(messages_json(messages), add_generation_prompt)


def messages_json(messages: Column) -> Column:
    """An array of messages, typed or VARIANT, as JSON text with its nulls."""
    return F.to_json(messages, {"ignoreNullFields": "false"})


TEMPLATES: dict[str, Template] = {
    t.name: t for t in (RoleContentTemplate(), ChatMLTemplate(), InstructionTemplate())
}


def get_template(template: Template | str | None) -> Template:
    if template is None:
        return TEMPLATES["role_content"]
    if isinstance(template, Template):
        return template
    return TEMPLATES[template]


def render(messages: Column, template: Template | str | None = None, add_generation_prompt: bool = False) -> Column:
    return get_template(template).render(messages, add_generation_prompt)


# --------------------------------------------------------------------------
# Lenient inference rendering over unvalidated VARIANT messages.
# --------------------------------------------------------------------------


def _python_str(v: Column, default: str) -> Column:
    """What ``str(item.get(key, default))`` prints for a JSON value."""
    t = V.type_of(v)
    return (
        F.when(v.isNull(), F.lit(default))
        .when(t == "VOID", F.lit("None"))
        .when(t == "STRING", F.variant_get(v, "$", "string"))
        .when(t == "BOOLEAN", F.initcap(F.variant_get(v, "$", "string")))
        .when(t.startswith("OBJECT") | t.startswith("ARRAY"), F.to_json(v))
        .otherwise(F.variant_get(v, "$", "string"))
    )


def render_inference(arr: Column) -> Column:
    """Lines ``role: content`` with role defaulting to ``user`` and content to
    the empty string when the key is missing; no generation prompt."""
    return F.array_join(
        F.transform(
            arr,
            lambda e: F.concat(_python_str(V.field(e, "role"), "user"), F.lit(": "), _python_str(V.field(e, "content"), "")),
        ),
        "\n",
    )


def render_plain(prompt: Column, system_prompt: str | None) -> Column:
    """``system + "\\n\\n" + prompt`` when a system prompt is given, else the prompt."""
    if system_prompt:
        return F.concat(F.lit(system_prompt + "\n\n"), prompt)
    return prompt
