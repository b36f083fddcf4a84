"""Typed access to schemaless records held as one VARIANT column.

A record keeps its exact JSON shape: a missing key is SQL NULL, a JSON
``null`` is a variant null, and a number is never coerced into a string.
Field names are exact top-level keys (bracket paths), never dotted paths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_nonblank


def path(name: str) -> str | None:
    """Bracket path for one top-level key, safe for dots, spaces and any letters:
    the path takes the raw name in either kind of quotes. None for a name that
    holds both kinds (or a backslash), which no path can spell."""
    if "\\" in name or ('"' in name and "'" in name):
        return None
    quote = "'" if '"' in name else '"'
    return f"$[{quote}{name}{quote}]"


def field(rec: Column | str, name: str) -> Column:
    """The raw variant value of ``rec[name]``; SQL NULL when the key is missing."""
    rec = F.col(rec) if isinstance(rec, str) else rec
    where = path(name)
    if where is None:
        return F.try_element_at(rec.try_cast("map<string,variant>"), F.lit(name))
    return F.try_variant_get(rec, where, "variant")


def has_key(rec: Column | str, name: str) -> Column:
    """``name in rec``: true for present keys, JSON null included."""
    return field(rec, name).isNotNull()


def type_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_string(v: Column) -> Column:
    return F.coalesce(type_of(v) == F.lit("STRING"), F.lit(False))


def as_string(v: Column) -> Column:
    """String value if ``v`` holds a JSON string, else NULL (no coercion)."""
    return F.when(is_string(v), F.variant_get(v, "$", "string"))


def nonblank_string(rec: Column | str, name: str) -> Column:
    """``isinstance(rec.get(name), str) and rec[name].strip()``."""
    return is_nonblank(as_string(field(rec, name)))


def as_array(v: Column) -> Column:
    """``ARRAY<VARIANT>`` if ``v`` holds a JSON array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def is_array(v: Column) -> Column:
    return as_array(v).isNotNull()


def is_nonempty_array(v: Column) -> Column:
    return F.coalesce(F.size(as_array(v)) > 0, F.lit(False))


def is_object(v: Column) -> Column:
    return v.try_cast("map<string,variant>").isNotNull() & v.isNotNull()


def is_variant_null(v: Column) -> Column:
    return F.coalesce(F.is_variant_null(v), F.lit(False))
