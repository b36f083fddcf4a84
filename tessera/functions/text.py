"""Unicode-aware blank tests and stripping.

Spark's one-argument ``trim`` removes U+0020 only, while Python's
``str.strip()`` removes every character for which ``str.isspace()`` holds.
The set is derived from that rule, once, at import time.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point Python treats as whitespace (25 of them).
WHITESPACE = "".join(chr(cp) for cp in range(sys.maxunicode + 1) if chr(cp).isspace())


def _ranges(chars: str) -> str:
    """Regex character-class body for ``chars`` using \\x{..} escapes (Java and RE2)."""
    cps = sorted(ord(c) for c in chars)
    parts, start, prev = [], cps[0], cps[0]
    for cp in cps[1:] + [None]:
        if cp is not None and cp == prev + 1:
            prev = cp
            continue
        parts.append(f"\\x{{{start:X}}}" if start == prev else f"\\x{{{start:X}}}-\\x{{{prev:X}}}")
        if cp is not None:
            start = prev = cp
    return "".join(parts)


WS_CLASS = "[" + _ranges(WHITESPACE) + "]"
NON_WS_CLASS = "[^" + _ranges(WHITESPACE) + "]"


def ustrip(col: Column) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.trim(col, F.lit(WHITESPACE))


def is_nonblank(col: Column) -> Column:
    """True when ``col`` has a non-whitespace character (``s.strip() != ''``); NULL-safe false."""
    return F.coalesce(F.ltrim(col, F.lit(WHITESPACE)) != F.lit(""), F.lit(False))


def sql_whitespace_class() -> str:
    """The whitespace class for SQL regexes (DuckDB/RE2 and Java accept it)."""
    return WS_CLASS
