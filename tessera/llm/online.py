"""Bounded-space online packing: a fixed number of open windows per partition.

Documents arrive in the order of their partition and are tokenised and placed at
once. A document of a window's size or more first fills windows of its own; what is
left of it goes into the open window with the smallest sufficient gap. Where none
fits, a new window opens while fewer than ``OPEN`` are; beyond that the fullest
window is emitted. Cuts are free, so the fullest takes the head of the piece that
did not fit and leaves without padding, and the rest of the piece goes on.

A partition holds ``OPEN`` windows whatever it reads. At its end the pieces of the
open windows, with their ids, go to a merge: ``FAN`` partitions' leftovers are one
group, packed again in the same way (longest first), until one group is left. That
group's last windows are joined and cut; the last sequence of all is cut into
powers of two. A group is at most ``FAN * OPEN`` windows, at every level.

Each level is a table in the shared folder, so ids given by a task stay as they are
when executors are lost.

Defined cases: null text counts as empty (the end id alone); rows that repeat an id
are documents of their own; a null ``doc_id`` is kept; an empty table gives an empty
result; other columns are ignored. Which documents share a window depends on the
partitions that Spark reads, the ids and their number do not.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import pick, slices, written
from .packing import gathered

SIZE = 1024
OPEN = 32       # open windows of a partition
FAN = 32        # partitions whose leftovers are merged together
TEXT_BYTES = 8 << 20  # texts tokenised together: the words of more texts repeat more often
END_ID = 0

# White space beside a blank or a line feed: there the tokenizer's words are not sure to
# begin at it.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNSURE = rf"{_WHITE}[ \n]|\n{_WHITE}"
_VISIBLE = re.compile(r"\S+")
_LETTERS = re.compile("[A-Za-z]+")
_STOPPED = re.compile("[A-Za-z]+[.,]")
_MAPPED = {" ": "\u0120", "\n": "\u010a"}  # as they stand in the tokens of a byte-level tokenizer


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class TextIds:
    """Token ids of whole texts, words remembered up to a bound.

    A byte-level tokenizer with the usual word pattern begins a new word at every
    blank or line feed that follows a visible character, so a text without two white
    spaces side by side there has the ids of its stretches, each with the blank or line
    feed before it, one after the other. ASCII letters and a stop after them are words of
    their own. Other texts, and tokenizers of any other make, are encoded whole."""

    LIMIT = 1_500_000      # stretches
    LIMIT_IDS = 12_000_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks have the cores
        from tokenizers import Tokenizer, pre_tokenizers
        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        self._by_word = (
            made.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space", True) and made.get("truncation") is None and made.get("padding") is None
            and not any(set(" \n") & set(t["content"]) or t["content"].isalpha() or t["lstrip"] or t["rstrip"] or t["single_word"]
                        or t["normalized"] for t in added)
            and not any((made.get("model") or {}).get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
        self._added = [t["content"] for t in added]
        vocab = tokenizer.get_vocab()
        self._begins = {lead: np.zeros(max(vocab.values(), default=0) + 1, bool) for lead in _MAPPED}
        for lead, mapped in _MAPPED.items():
            self._begins[lead][[i for t, i in vocab.items() if t.startswith(mapped)]] = True
        # Words of ASCII letters need no pattern: the same model behind a plain cut.
        plain = Tokenizer.from_file(path)
        plain.pre_tokenizer = pre_tokenizers.Split(_MAPPED[" "], "merged_with_next")
        self._encode_letters = plain.encode_batch_fast
        self._forget()

    def _forget(self) -> None:
        # The first stretch is the end id. Known stretches by whether a blank is before them.
        self._at: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self._flat, self._offsets = np.array([END_ID], "<u4"), np.array([0, 1], np.int64)

    def _add(self, known: dict[str, int], stretches: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self._offsets) - 1
        known.update(zip(stretches, range(first, first + len(stretches))))
        self._offsets = np.concatenate([self._offsets, len(self._flat) + np.cumsum(sizes)])
        self._flat = np.concatenate([self._flat, flat])

    def _learn_each(self, known: dict[str, int], new: list[str], lead: str) -> None:
        ids = [e.ids for e in self._encode([lead + s for s in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(known, new, np.fromiter(itertools.chain.from_iterable(ids), "<u4", int(sizes.sum())), sizes)

    def _learn_runs(self, known: dict[str, int], new: list[str], lead: str, letters: bool = False) -> list[str]:
        """Encode stretches many at a time, as a text: only the first token of each begins
        with its ``lead`` (a blank, or the line feed that the stretch has itself). Returns
        those of runs for which that does not hold."""
        rest = []
        between = _MAPPED[lead] if letters else lead if lead == " " else ""
        runs = [new[i:i + 1000] for i in range(0, len(new), 1000)]
        texts = [between + between.join(r) for r in runs]
        encode = self._encode_letters if letters else self._encode
        for run, text, e in zip(runs, texts, encode(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            begins = np.flatnonzero(self._begins[lead][ids])
            if len(begins) == len(run) and begins[0] == 0 and not any(t in text for t in self._added):
                self._add(known, run, ids, np.diff(begins, append=len(ids)))
            else:
                rest += run
        return rest

    def _learn(self, known: dict[str, int], new: list[str], lead: str) -> None:
        """Encode stretches that are not known."""
        if not lead:
            lines = [s for s in new if s[:1] == "\n" and _VISIBLE.fullmatch(s, 1)]
            there = set(lines)
            self._learn_each(known, self._learn_runs(known, lines, "\n") + [s for s in new if s not in there], "")
            return
        words, stopped, visible, rest = {}, [], [], []
        for s in new:
            if _LETTERS.fullmatch(s):
                words[s] = None
            elif _STOPPED.fullmatch(s):
                stopped.append(s)
                if s[:-1] not in known:
                    words[s[:-1]] = None
            elif _VISIBLE.fullmatch(s):
                visible.append(s)
            else:
                rest.append(s)
        rest += self._learn_runs(known, list(words), lead, letters=True) + self._learn_runs(known, visible, lead)
        self._learn_each(known, rest, lead)
        if stopped:
            stops = {c: self._stop(c) for c in ".,"}
            pairs = np.array([(known[s[:-1]], stops[s[-1]]) for s in stopped], np.int64)
            flat, sizes = gathered(self._flat, self._offsets, pairs.ravel())
            self._add(known, stopped, flat, sizes.reshape(-1, 2).sum(1))

    def _stop(self, stop: str) -> int:
        """The number of a stop without a blank."""
        known = self._at[False]
        if stop not in known:
            self._learn_each(known, [stop], "")
        return known[stop]

    def _numbers(self, stretches: pa.Array, lead: str) -> np.ndarray:
        found, known = stretches.dictionary_encode(), self._at[bool(lead)]
        keys = found.dictionary.to_pylist()
        at = np.fromiter(map(known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [keys[i] for i in missing]
            self._learn(known, new, lead)
            at[missing] = [known[k] for k in new]
        return at[found.indices.to_numpy(zero_copy_only=False)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other, and the
        offsets of the texts."""
        if sum(map(len, self._at)) > self.LIMIT or len(self._flat) > self.LIMIT_IDS:
            self._forget()
        n = len(texts)
        if self._by_word:
            whole = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False)
        else:
            whole = np.ones(n, bool)
        others = [np.array([*e.ids, END_ID], "<u4")
                  for e in self._encode(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)] if whole.any() else []
        flat, sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if not whole.all():
            # A blank before every line feed, which then begins its stretch.
            split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~whole)), "\n", " \n"), " ")
            stretches = split.flatten()
            per_text = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(per_text)
            bare = pc.starts_with(stretches, "\n").to_numpy(zero_copy_only=False).copy()
            bare[ends - per_text] = True
            which = np.empty(len(stretches), np.int64)
            which[bare] = self._numbers(stretches.filter(pa.array(bare)), "")
            which[~bare] = self._numbers(stretches.filter(pa.array(~bare)), " ")
            which = np.insert(which, ends, 0)
            flat, per_stretch = gathered(self._flat, self._offsets, which)
            upto = np.concatenate([[0], np.cumsum(per_stretch)])
            sizes = np.diff(upto[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])])
        if not others:
            return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        all_sizes = np.empty(n, np.int64)
        all_sizes[whole], all_sizes[~whole] = [len(x) for x in others], sizes
        offsets = np.concatenate([[0], np.cumsum(all_sizes)]).astype(np.int64)
        out, cuts = np.empty(offsets[-1], "<u4"), np.concatenate([[0], np.cumsum(sizes)])
        for k, i in enumerate(np.flatnonzero(whole)):
            out[offsets[i]:offsets[i + 1]] = others[k]
        for k, i in enumerate(np.flatnonzero(~whole)):
            out[offsets[i]:offsets[i + 1]] = flat[cuts[k]:cuts[k + 1]]
        return out, offsets


@lru_cache(maxsize=1)
def text_ids(path: str) -> TextIds:
    """One per Python worker: its tasks share the tokenizer and the known words."""
    return TextIds(path)


class Windows:
    """At most ``n_open`` open windows of ``size`` tokens. ``place`` returns where a
    piece goes, as ``(start, length, window, offset)`` with the start in the piece."""

    def __init__(self, size: int = SIZE, n_open: int = OPEN):
        self.size, self.n_open = size, n_open
        self.gaps: list[tuple[int, int]] = []  # (gap, window), smallest gap first
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _put(self, gap: int, window: int, length: int) -> int:
        """Fill ``length`` of a window that is not in the list; its offset."""
        if gap > length:
            bisect.insort(self.gaps, (gap - length, window))
        return self.size - gap

    def place(self, length: int) -> list[tuple[int, int, int, int]]:
        parts, start = [], 0
        while length - start >= self.size:
            parts.append((start, self.size, self._new(), 0))
            start += self.size
        while start < length:
            rest = length - start
            at = bisect.bisect_left(self.gaps, (rest, -1))
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
            elif len(self.gaps) < self.n_open:
                gap, window = self.size, self._new()
            else:  # the fullest leaves, filled up with the head of the piece
                gap, window = self.gaps.pop(0)
                rest = gap
            parts.append((start, rest, window, self._put(gap, window, rest)))
            start += rest
        return parts

    def open(self) -> set[int]:
        return {w for _, w in self.gaps}


def closing(lengths: list[int], size: int) -> list[list[tuple[int, int, int, int]]]:
    """Places for the very last pieces: one after the other in full windows, the rest
    in windows whose lengths are powers of two, so that nothing is padded."""
    total = sum(lengths)
    bounds = list(range(0, total - total % size + 1, size))
    for bit in reversed(range(size.bit_length())):
        if total % size >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    out, at = [], 0
    for n in lengths:
        parts, start = [], 0
        while start < n:
            w = bisect.bisect_right(bounds, at + start) - 1
            take = min(n - start, bounds[w + 1] - at - start)
            parts.append((start, take, w, at + start - bounds[w]))
            start += take
        out.append(parts)
        at += n
    return out


class _Rows:
    """Output rows of one task; a piece in an open window waits for its end."""

    NAMES = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
    TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def __init__(self, id_type: pa.DataType, level: int, part: int):
        self.id_type, self.part = id_type, part
        self.base = (level << 58) | (part << 32)
        self.done: list[tuple] = []
        self.waiting: dict[int, list[tuple]] = {}

    def add(self, doc_id, base_start: int, doc_tokens: int, ids: np.ndarray, parts, still_open: set[int]) -> None:
        for start, length, window, offset in parts:
            piece = ids[start:start + length]
            row = (doc_id, base_start + start, length, zlib.crc32(piece), doc_tokens, self.base + window, offset)
            if window in still_open:
                self.waiting.setdefault(window, []).append((row, piece.tobytes()))
            else:
                self.done.append(row)
                self.done += [r for r, _ in self.waiting.pop(window, ())]

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 9
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], self.id_type), *[pa.array(c, t) for c, t in zip(columns[1:], self.TYPES)]],
            names=["doc_id", *self.NAMES])

    def finished(self) -> pa.RecordBatch:
        rows, self.done = [(*r, None, None) for r in self.done], []
        return self.batch(rows)

    def leftovers(self) -> pa.RecordBatch:
        rows = [(*r[:5], None, None, ids, self.part) for w in sorted(self.waiting) for r, ids in self.waiting[w]]
        self.waiting = {}
        return self.batch(rows)


_SCHEMA = ("doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
           "ids binary, part long")
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_online(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, n_open: int = OPEN,
                fan: int = FAN) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    if size < 1 or n_open < 1 or fan < 2:
        raise ValueError("size and n_open are 1 at least, fan 2")
    ship_package(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = _SCHEMA.format(rows.schema["doc_id"].dataType.simpleString())

    def online(batches):
        known, windows, out = text_ids(path), Windows(size, n_open), None
        for b in slices(batches, 1, rows=TEXT_BYTES, size=TEXT_BYTES):
            if out is None:
                out = _Rows(b.schema.field(0).type, 0, TaskContext.get().partitionId())
            flat, offsets = known.texts(b.column(1))
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                ids = flat[offsets[i]:offsets[i + 1]]
                parts = windows.place(len(ids))
                out.add(doc_id, 0, len(ids), ids, parts, windows.open() if len(parts) > 1 or parts[0][1] < size else set())
            yield out.finished()
        if out is not None:
            yield out.leftovers()

    level, table = 0, written(rows.mapInArrow(online, schema), "online-0")
    done = [table.filter("sequence_id is not null")]
    while True:
        left = table.filter("sequence_id is null")
        last = left.agg(F.max("part")).first()[0]
        if last is None:
            break
        level += 1
        left = left.withColumn("part", F.floor(F.col("part") / fan).cast("long"))
        table = written(left.groupBy("part").applyInArrow(_merge(size, n_open, level, last < fan), schema), f"online-{level}")
        done.append(table.filter("sequence_id is not null"))
        if last < fan:
            break
    final = done[0]
    for more in done[1:]:
        final = final.unionByName(more)
    return final.select(*COLUMNS)


def _merge(size: int, n_open: int, level: int, final: bool):
    def merge(left: pa.Table) -> pa.Table:
        left = left.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        part = left.column("part")[0].as_py()
        rows, windows = left.to_pylist(), Windows(size, n_open)
        out = _Rows(left.schema.field("doc_id").type, level, part)

        def ids_of(r):
            return np.frombuffer(r["ids"], "<u4")
        for r in rows:
            parts = windows.place(r["length"])
            out.add(r["doc_id"], r["start"], r["doc_tokens"], ids_of(r), parts, windows.open())
        if not final:
            return pa.Table.from_batches([out.finished(), out.leftovers()])
        batches = [out.finished()]
        rest = out.leftovers().to_pylist()
        ends = _Rows(out.id_type, level, part)
        ends.base += windows.made
        for r, parts in zip(rest, closing([r["length"] for r in rest], size)):
            ends.add(r["doc_id"], r["start"], r["doc_tokens"], ids_of(r), parts, set())
        return pa.Table.from_batches([*batches, ends.finished()])
    return merge
