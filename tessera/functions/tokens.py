"""Tokenizers as column expressions, and label arrays.

Built-in tokenizers run inside the JVM:

* ``codepoint``: one id per Unicode code point (``ascii`` of each character),
* ``utf8``: one id per UTF-8 byte.

For both, the first ``max_length`` tokens depend only on a bounded prefix of
the text, so truncation is pushed *before* tokenizing: a 128k-character
document never becomes a 128k-element array. Model tokenizers plug in through
``PandasTokenizer`` (Arrow-batched, loaded once per worker).
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_INDEX = -100  # label value ignored by the loss (fixed value)


class Tokenizer:
    name = "tokenizer"
    eos_id: int = 0
    bos_id: int | None = None
    pad_id: int | None = None
    special_ids: Sequence[int] = ()

    def encode(self, text: Column, max_length: int | None = None) -> Column:  # pragma: no cover
        raise NotImplementedError

    def decode(self, ids: Column) -> Column:  # pragma: no cover
        raise NotImplementedError

    def count(self, text: Column, max_length: int | None = None) -> Column:
        """Number of tokens of ``text`` after truncation."""
        return F.size(self.encode(text, max_length))

    def prefix(self, text: Column, max_length: int | None) -> Column:
        """A prefix of ``text`` whose first ``max_length`` tokens equal the text's."""
        return text

    def encode_prompt(self, text: Column) -> Column:
        """Ids of a prompt for generation: with the start token, which training ids lack."""
        ids = self.encode(text)
        return ids if self.bos_id is None else F.concat(F.array(F.lit(int(self.bos_id))), ids)

    def encode_pair(self, text: Column, prompt: Column, max_length: int) -> Column:
        """``struct(ids, masked)``: the text's ids and the number of the prompt's, both
        after truncation. An empty prompt has none."""
        return F.struct(self.encode(text, max_length).alias("ids"), self.count(prompt, max_length).alias("masked"))

    @property
    def effective_pad_id(self) -> int:
        """The pad id, defaulting to the end-of-sequence id."""
        return self.eos_id if self.pad_id is None else self.pad_id


class CodepointTokenizer(Tokenizer):
    name = "codepoint"

    def __init__(self, eos_id: int = 0, pad_id: int | None = None, special_ids: Sequence[int] = (0,), bos_id: int | None = None):
        self.eos_id, self.pad_id, self.special_ids, self.bos_id = eos_id, pad_id, tuple(special_ids), bos_id

    def encode(self, text, max_length=None):
        s = text if max_length is None else F.substring(text, 1, int(max_length))
        ids = F.transform(F.split(s, ""), lambda c: F.ascii(c))
        return F.when(s == "", F.array().cast("array<int>")).otherwise(ids)

    def count(self, text, max_length=None):
        n = F.length(text)
        return n if max_length is None else F.least(n, F.lit(int(max_length)))

    def prefix(self, text, max_length):
        return text if max_length is None else F.substring(text, 1, int(max_length))

    def decode(self, ids):
        keep = F.filter(ids, lambda x: ~x.isin(*self.special_ids)) if self.special_ids else ids
        hexed = F.array_join(F.transform(keep, lambda x: F.lpad(F.hex(x), 8, "0")), "")
        # A byte order mark in front: without it the decoder takes a leading U+FEFF for one.
        return F.decode(F.unhex(F.concat(F.lit("0000FEFF"), hexed)), "UTF-32")


class Utf8Tokenizer(Tokenizer):
    name = "utf8"

    def __init__(self, eos_id: int = 0, pad_id: int | None = None, special_ids: Sequence[int] = (0,), bos_id: int | None = None):
        self.eos_id, self.pad_id, self.special_ids, self.bos_id = eos_id, pad_id, tuple(special_ids), bos_id

    def encode(self, text, max_length=None):
        b = F.encode(text, "UTF-8")
        if max_length is not None:
            b = F.substring(b, 1, int(max_length))
        # Hex digits in pairs, found in one linear pass (per-index substrings
        # would walk the string from the start every time).
        pairs = F.regexp_extract_all(F.hex(b), F.lit("[0-9A-F]{2}"), 0)
        ids = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))
        return F.when(F.octet_length(b) == 0, F.array().cast("array<int>")).otherwise(ids)

    def count(self, text, max_length=None):
        n = F.octet_length(text)
        return n if max_length is None else F.least(n, F.lit(int(max_length)))

    def prefix(self, text, max_length):
        # max_length characters hold at least max_length bytes
        return text if max_length is None else F.substring(text, 1, int(max_length))

    def decode(self, ids):
        keep = F.filter(ids, lambda x: ~x.isin(*self.special_ids)) if self.special_ids else ids
        return F.decode(F.unhex(F.array_join(F.transform(keep, lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")


class PandasTokenizer(Tokenizer):
    """A model tokenizer built by ``factory()`` once per Python worker.

    ``encode(texts: list[str]) -> list[list[int]]`` must not add special
    tokens; ``decode(ids: list[list[int]]) -> list[str]`` should skip them;
    ``encode_prompts(texts)``, where there is one, adds those that the model
    wants before a prompt (training never does).
    """

    name = "pandas"

    def __init__(self, factory: Callable[[], object], eos_id: int, pad_id: int | None = None,
                 special_ids: Sequence[int] = ()):
        self.factory, self.eos_id, self.pad_id, self.special_ids = factory, eos_id, pad_id, tuple(special_ids)

    def encode(self, text, max_length=None):
        from ..session import ship_package
        ship_package()
        return self._ids(text, "encode", max_length)

    def encode_prompt(self, text):
        from ..session import ship_package
        ship_package()
        return self._ids(text, "encode_prompts", None)

    def _ids(self, text, method: str, limit: int | None):
        factory = self.factory

        @F.pandas_udf("array<int>")
        def _enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tok = factory()  # once per task
            encode = getattr(tok, method, tok.encode)
            for s in batches:
                yield pd.Series([list(ids[:limit]) for ids in encode([x if x is not None else "" for x in s])])

        return _enc(text)

    def encode_pair(self, text, prompt, max_length):
        from ..session import ship_package
        ship_package()
        factory, limit = self.factory, int(max_length)

        @F.pandas_udf("ids array<int>, masked int")
        def _pair(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            tok = factory()  # once per task
            for texts, prompts in batches:
                ids = tok.encode([x if x is not None else "" for x in texts])
                some = [p for p in prompts if p]
                sizes = iter(tok.encode(some)) if some else iter(())
                yield pd.DataFrame({"ids": [list(x[:limit]) for x in ids],
                                    "masked": [min(len(next(sizes)), limit) if p else 0 for p in prompts]})

        return _pair(text, prompt)

    def decode(self, ids):
        from ..session import ship_package
        ship_package()
        factory = self.factory

        @F.pandas_udf("string")
        def _dec(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tok = factory()  # once per task
            for s in batches:
                yield pd.Series(tok.decode([list(x) for x in s]))

        return _dec(ids)


TOKENIZERS = {"codepoint": CodepointTokenizer, "utf8": Utf8Tokenizer}


def get_tokenizer(tok: Tokenizer | str | None) -> Tokenizer:
    if tok is None:
        return CodepointTokenizer()
    if isinstance(tok, Tokenizer):
        return tok
    return TOKENIZERS[tok]()


def mask_prefix(ids: Column, n_masked: Column) -> Column:
    """Labels: the first ``n_masked`` ids become ``IGNORE_INDEX``."""
    return F.transform(ids, lambda x, i: F.when(i < n_masked, F.lit(IGNORE_INDEX)).otherwise(x))


def pad(arr: Column, width: Column, value: Column | int, side: str = "right") -> Column:
    """Pad ``arr`` to ``width`` with ``value`` on the given side."""
    value = F.lit(value) if isinstance(value, int) else value
    fill = F.array_repeat(value, F.greatest(width - F.size(arr), F.lit(0)))
    return F.concat(arr, fill) if side == "right" else F.concat(fill, arr)


def attention_mask(n: Column, width: Column, side: str = "right") -> Column:
    ones = F.array_repeat(F.lit(1), n)
    zeros = F.array_repeat(F.lit(0), F.greatest(width - n, F.lit(0)))
    return F.concat(ones, zeros) if side == "right" else F.concat(zeros, ones)


def new_tokens(output_ids: Column, n_input: Column) -> Column:
    """Generated ids after the (padded) prompt: ``output[n_input:]``, where
    ``n_input`` is the padded input length (``size(input_ids)``)."""
    n_in = n_input
    return F.slice(output_ids, n_in + 1, F.greatest(F.size(output_ids) - n_in, F.lit(0)))


def ids_text(ids: Column) -> Column:
    """Comma-joined ids, a stable scalar form for comparisons and sinks."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
