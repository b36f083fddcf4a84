"""Best-fit packing of tokenised documents by exact-complement hashing.

Which lengths share a sequence depends on nothing but how many pieces there are
of each length, and a piece is at most ``SEQUENCE`` tokens long. So the plan is
made from a histogram of ``SEQUENCE`` counters, whatever the number of documents:

* piece lengths are taken from the longest to the shortest, and the gap a piece
  leaves is looked up among the sums of one, two and three available lengths; a
  combination that fills the gap exactly is consumed as often as the
  availability counts allow, in one step;
* lengths without any exact complement go to best fit: into the open sequence
  with the smallest sufficient gap, again many at a time.

The plan is a list of slots (length, first rank, number, first sequence,
offset). Pieces get their rank among those of the same length by counting per
(length, salt), so a length that a third of all pieces share is numbered by many
tasks, and look up their slot by binary search. Tokens are made once; the piece
table (no text) is written to the shared folder before anything is counted.

Defined cases: null text counts as empty (one piece of one token, the end id);
rows that repeat an id are documents of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import merged, pick, slices, written

SEQUENCE = 4096
END_ID = 1
PIECES_PER_SALT = 50_000
TEXT_ROWS, TEXT_BYTES = 10_000, 8 << 20  # texts tokenised together: the words of more texts repeat more often


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of ``flat`` one after the other, and their sizes."""
    sizes = offsets[which + 1] - offsets[which]
    first = np.cumsum(sizes) - sizes
    return flat[np.repeat(offsets[which] - first, sizes) + np.arange(sizes.sum())], sizes


# Printable ASCII and white space without the apostrophe, which begins words of its own;
# the words that the tokenizer cuts such a text into; one word of it.
_PLAIN = re.compile(r"[\t-\r -&(-~]*")
_WORDS = re.compile(r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_WORD = re.compile(r"[a-z]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_STOPS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


# The normaliser, the cut and the model's options of the tokenizers that
# the short cuts below are right for.
_MAKE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "truncation": None, "padding": None,
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
          "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def by_stretch(path: str) -> bool:
    """Whether a tokenizer file is of the make whose texts can be encoded stretch by stretch."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model = {k: v for k, v in made.get("model", {}).items() if k not in ("vocab", "merges")}
    return all(made.get(k) == v for k, v in _MAKE.items()) and model == _MODEL and not any(
        set(t["content"]) & set(" \t\n\r") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made.get("added_tokens") or [])


class ChunkIds:
    """Token ids of the stretches between blanks and line feeds, remembered up to a bound.

    The tokenizer cuts at white space before it merges and drops it, and neither
    its normaliser nor its special tokens reach across a blank or line feed, so a text's
    ids are those of its stretches one after the other. It also lowers letters and
    cuts between letters and punctuation: an ASCII word shares its ids with its
    other spellings, and the punctuation after a word has ids of its own.
    Texts of tokenizers of any other make (``by_stretch``) are encoded whole.

    The ids are one array with an offset per stretch, so the texts of a batch are
    put together without a loop over their words. The parts of stretches are stretches
    too: a word that is known is not merged again for its next spelling."""

    LIMIT = 1_000_000      # stretches
    LIMIT_IDS = 8_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self._encode, self._merge = tokenizer.encode_batch_fast, tokenizer.model.tokenize
        self._by_stretch = by_stretch(path)
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        vocab = tokenizer.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        # The first stretch is the end id.
        self._at: dict[str, int] = {}
        self._flat, self._offsets = np.array([END_ID], "<u4"), np.array([0, 1], np.int64)

    def parts(self, chunk: str) -> list[str]:
        """The keys whose ids make up the chunk's: the tokenizer's own words where
        the chunk is plain ASCII, else the chunk or its word and the punctuation after it."""
        if _PLAIN.fullmatch(chunk):
            return [chunk] if self._added.search(chunk) else _WORDS.findall(chunk.lower()) or [chunk]
        body = chunk.rstrip(_STOPS)
        if not body.isalpha() or self._added.search(chunk):
            return [chunk]
        after = chunk[len(body):]
        if max(body) < "\u0130":  # up to here every capital has one small letter
            body = body.lower()
        return [body, after] if after else [body]

    def keyed(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct keys of all chunks, the numbers of each chunk's keys one
        after the other, and how many each has. ASCII words go many at a time."""
        text = pa.array(chunks, pa.string())
        plain = pc.match_substring_regex(text, "^[A-Za-z]+[.,]?$")
        is_plain = plain.to_numpy(zero_copy_only=False)
        words = text.filter(plain)
        bodies = pc.ascii_lower(pc.utf8_rtrim(words, ".,")).dictionary_encode()
        keys = bodies.dictionary.to_numpy(zero_copy_only=False).tolist() + [".", ","]
        number = dict(zip(keys, range(len(keys))))
        rest = [self.parts(chunks[i]) for i in np.flatnonzero(~is_plain)]
        for k in itertools.chain.from_iterable(rest):
            number.setdefault(k, len(number))
        of_each = np.ones(len(chunks), np.int64)
        stop, comma = (pc.ends_with(words, x).to_numpy(zero_copy_only=False) for x in ".,")
        of_each[is_plain] += stop | comma
        of_each[~is_plain] = np.fromiter(map(len, rest), np.int64, len(rest))
        first = np.cumsum(of_each) - of_each
        which = np.empty(int(of_each.sum()), np.int64)
        which[first[is_plain]] = bodies.indices.to_numpy(zero_copy_only=False)
        at = first[is_plain] + 1
        which[at[stop]], which[at[comma]] = number["."], number[","]
        others = np.ones(len(which), bool)
        others[first[is_plain]] = False
        others[at[stop | comma]] = False
        which[others] = [number[k] for k in itertools.chain.from_iterable(rest)]
        return list(number), which, of_each

    def ids_of(self, keys) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The keys in a new order, their ids one after the other, and the offsets.
        ASCII words are merged by the model alone, as nothing is left to cut.
        Other words of letters go through the tokenizer many at a time, as a text:
        each is one word for it, so its ids reach up to the next word end."""
        ready, words, rest = [], [], []
        for k in keys:
            if _WORD.fullmatch(k) and not self._added.search(k):
                ready.append(k)
            else:
                (words if k.isalpha() else rest).append(k)
        merged_ids = [[t.id for t in self._merge(k)] for k in ready]
        order = list(ready)
        flats = [np.fromiter(itertools.chain.from_iterable(merged_ids), "<u4")]
        sizes = [np.fromiter(map(len, merged_ids), np.int64, len(ready))]
        runs = [words[i:i + 500] for i in range(0, len(words), 500)]
        for run, e in zip(runs, self._encode([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self._ends[ids])
            if len(ends) == len(run) and ends[-1] == len(ids) - 1:
                order += run
                flats.append(ids)
                sizes.append(np.diff(ends, prepend=-1))
            else:
                rest += run
        for e in self._encode(rest, add_special_tokens=False):
            flats.append(np.array(e.ids, "<u4"))
            sizes.append([len(flats[-1])])
        return order + rest, np.concatenate(flats), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def _add(self, new: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self._offsets) - 1
        self._at.update(zip(new, range(first, first + len(new))))
        self._offsets = np.concatenate([self._offsets, len(self._flat) + np.cumsum(sizes)])
        self._flat = np.concatenate([self._flat, flat])

    def learn(self, new: list[str]) -> None:
        """Add the ids of distinct chunks that are not known yet, in one call: first
        those of the keys not known yet, then those of the chunks of several keys."""
        if not new:
            return
        keys, which, of_each = self.keyed(new)
        order, flat, offsets = self.ids_of([k for k in keys if k not in self._at])
        self._add(order, flat, np.diff(offsets))
        rest = np.fromiter((c not in self._at for c in new), bool, len(new))
        if not rest.any():
            return
        place = np.fromiter(map(self._at.__getitem__, keys), np.int64, len(keys))
        ids, sizes = gathered(self._flat, self._offsets, place[which[np.repeat(rest, of_each)]])
        of_each = of_each[rest]
        sizes = np.add.reduceat(sizes, np.cumsum(of_each) - of_each)
        self._add([new[i] for i in np.flatnonzero(rest)], ids, sizes)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, one after the other, and
        the offsets of the texts."""
        if not self._by_stretch:
            found = [np.array([*e.ids, END_ID], "<u4") for e in self._encode(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, "<u4"), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        if len(self._at) > self.LIMIT or len(self._flat) > self.LIMIT_IDS:
            self._forget()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self._at.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        new = [distinct[i] for i in missing]
        self.learn(new)
        at[missing] = [self._at[c] for c in new]
        ends = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        which = np.insert(at[chunks.indices.to_numpy(zero_copy_only=False)], ends, 0)
        ids, sizes = gathered(self._flat, self._offsets, which)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.concatenate([[0], upto[ends + np.arange(1, len(ends) + 1)]])


@lru_cache(maxsize=1)
def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker: its tasks share the tokenizer and the known words."""
    return ChunkIds(path)


_PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids with the
    end id, cut only where a document is longer than a sequence."""
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches):
        known = chunk_ids(tokenizer)
        for b in slices(batches, 1, TEXT_ROWS, TEXT_BYTES):
            at, piece, start, length, crc = [], [], [], [], []
            flat, offsets = known.texts(b.column(1))
            for i in range(b.num_rows):
                ids = flat[offsets[i]:offsets[i + 1]]
                for k, lo in enumerate(range(0, len(ids), size)):
                    part = ids[lo:lo + size]
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, _PIECES.format(rows.schema["doc_id"].dataType.simpleString()))


class Availability:
    """How many pieces of each length are left, with the lookups of sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()

    def _fits(self, parts) -> int:
        """How many times the parts can be consumed together."""
        return min(int(self.left[x]) // n for x, n in Counter(parts).items())

    def single(self, gap: int):
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int):
        """The pair summing to ``gap`` that can be consumed most often."""
        a = np.arange(1, gap // 2 + 1)
        if not len(a):
            return None
        n = np.minimum(self.left[a], self.left[gap - a])
        if gap % 2 == 0:
            n[-1] = self.left[gap // 2] // 2
        k = int(n.argmax())
        return (int(a[k]), gap - int(a[k])) if n[k] else None

    def triple(self, gap: int):
        """The longest available first part whose rest has a pair."""
        there = np.flatnonzero(self.left[:max(gap - 1, 0)])
        if not len(there):
            return None
        # The longest of three is a third of the gap or more and leaves room for the shortest twice.
        firsts = there[(3 * there >= gap) & (there <= gap - 2 * there[0])]
        for x in firsts[::-1]:
            x = int(x)
            self.left[x] -= 1
            two = self.pair(gap - x)
            self.left[x] += 1
            if two:
                return (x, *two)
        return None

    def complement(self, length: int, size: int):
        """Lengths that fill up a sequence begun with ``length``, and how often."""
        gap = size - length
        self.left[length] -= 1  # the piece itself is taken
        for look in (self.single, self.pair, self.triple):
            parts = look(gap) if gap else ()
            if parts or not gap:
                self.left[length] += 1
                return parts, self._fits((length, *parts))
        self.left[length] += 1
        return None, 0


def plan(counts: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, int]:
    """Slots ``(length, first rank, number, first sequence, offset)`` as an array
    and the number of sequences; ``counts[l]`` is the number of pieces of length l."""
    have = Availability(np.asarray(counts, np.int64))
    total = have.left.copy()
    slots, sequences = [], 0

    def place(length, n, sequence, offset):
        slots.append((length, int(total[length] - have.left[length]), n, sequence, offset))
        have.left[length] -= n

    for length in range(size, 0, -1):
        while have.left[length]:
            parts, n = have.complement(length, size)
            if not n:
                break
            offset = 0
            for x in (length, *parts):
                place(x, n, sequences, offset)
                offset += x
            sequences += n
    # Best fit of what is left; runs of equal sequences are kept by their gap.
    open_runs: dict[int, list[list[int]]] = {}  # gap -> [first sequence, number]
    gaps = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        while have.left[length]:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = length + int(fitting[0])
                first, number = open_runs[gap].pop()
                n = min(number, int(have.left[length]))
                if n < number:
                    open_runs[gap].append([first + n, number - n])
                gaps[gap] = bool(open_runs[gap])
                place(length, n, first, size - gap)
                rest = gap - length
            else:
                n, rest = int(have.left[length]), size - length
                first, sequences = sequences, sequences + n
                place(length, n, first, 0)
            if rest:
                open_runs.setdefault(rest, []).append([first, n])
                gaps[rest] = True
    return np.array(slots, np.int64).reshape(-1, 5), sequences


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    pieces = written(token_pieces(docs, tokenizer or default_tokenizer(), size), "pieces")
    hist = pieces.groupBy("length").count().collect()  # at most ``size`` rows
    counts = np.zeros(size + 1, np.int64)
    for r in hist:
        counts[r["length"]] = r["count"]
    slots, _ = plan(counts, size)
    order = np.lexsort((slots[:, 1], slots[:, 0]))
    slots = slots[order]
    n_salts = int(counts.max() // PIECES_PER_SALT) + 64
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n_salts)))
    # At most size * n_salts rows, so one task can number them.
    per_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per_salt = per_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(local) - 1).join(merged(per_salt), ["length", "salt"]) \
        .withColumn("rank", F.col("base") + F.col("r"))
    # Slots sorted by (length, rank): one key per slot for the binary search.
    span = int(counts.max()) + 1
    keys = slots[:, 0] * span + slots[:, 1]

    def seat(batches):
        for b in batches:
            length = b.column(3).to_numpy(zero_copy_only=False)
            rank = b.column(5).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, length * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(5)] + [pa.array(slots[k, 3] + rank - slots[k, 1]), pa.array(slots[k, 4])],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    schema = _PIECES.format(pieces.schema["doc_id"].dataType.simpleString()) + ", sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(seat, schema)
