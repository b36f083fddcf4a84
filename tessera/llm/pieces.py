"""SentencePiece encoding and decoding: a max-plus parallel scan.

``tokenize`` gives the ids of a BPE model, ``encode`` those of a model that chooses
pieces by the sum of their scores (unigram). Both run the same scan with other weights.

Documents are cut into chunks of ``CHUNK`` characters, dealt to all tasks. A chunk
becomes a transfer matrix in the (max, +) semiring from the states at its first
border to those at its last. Matrices combine associatively: first in groups of
``GROUP`` chunks, then the groups of a document in order, then back into the groups,
which gives every chunk the states at its two ends. With these, each chunk is
backtraced on its own; a piece belongs to the chunk it starts in.

*Weights of a BPE model.* Its scores are merge ranks, of which no sum tells which
pieces win. But a row of pieces is the model's encoding of their text if and only if
that holds for every two neighbours: a first wrong merge would join symbols of two
neighbours, and only those two decide when it comes. So a state is the piece that
reaches over a border or ends there, and stepping from a piece to the next weighs 0
where the merges of both leave them apart, else minus infinity; exactly one way
through a document weighs 0. Neighbours are tried with the library once and
remembered. No merge crosses a boundary between characters that stand side by side in
no piece: from the first such boundary of a chunk to its last the merges are the
library's, and only the stretches at the borders are scanned. A run without any
such boundary (the same letter repeated) is scanned whole, chunk by chunk.

*Weights of scores.* (Blanks are written as U+2581 and the text begins with one; a
character without piece is spelled in byte pieces.) A piece may reach over a chunk's
end by up to L - 1 characters (L: the longest piece), so a chunk is an L x L matrix:
entry [i][j] is the best score of entering the chunk after its first i characters and
leaving it j characters beyond its end. No piece of the vocabulary holds a blank mark
after another character (checked when the model is loaded; else the shortcut is
off), so a segmentation always has a boundary before a blank, and the stretches
between are remembered. Scores are added in double precision; where they are whole
numbers the scan gives the same best sum as one pass over the text. Between
segmentations of equal sum the choice is fixed by the chunking.

Only documents of several chunks take part in the scan; a document of one chunk
is the case whose two states are known.

Decoding turns the ids of a chunk back into its characters. A BPE model's library
writes a literal U+2581 like a blank, so it comes back as a blank; ``encode`` spells
it in bytes, so it comes back as itself.

Defined cases: null text counts as empty; an empty text is one chunk, without ids for a
BPE model, else with the piece of the leading blank; rows that repeat an id are
documents of their own (``doc`` numbers them); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
import operator
import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged, pick, slices, written

CHUNK = 16384
GROUP = 64
BLANK = "▁"
LITERAL = "\ud800"  # stands for U+2581 itself; no text holds a lone surrogate


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


# The stretches between sure boundaries: a blank after another character begins one.
_STRETCHES = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Pieces:
    """The vocabulary as a prefix table, with the words segmented so far."""

    LIMIT = 500_000

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.text = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p], self.scores[p], self.text[i] = i, sp.get_score(i), p
        self.shown = {i: p.replace(BLANK, " ") for i, p in self.text.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        ascii_bytes = {i: chr(b) for i, b in self.byte_of.items() if b < 128}
        self.strings = pa.array([self.shown.get(i, ascii_bytes.get(i)) for i in range(sp.get_piece_size())], pa.string())
        self.longest = max(map(len, self.ids))
        self.behind, self.ahead = 0, self.longest - 1  # characters around a chunk that it reads
        self.unknown = min(self.scores.values()) - 10.0
        self.prefixes = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        # The score of every piece; a prefix that is none leads on but never wins,
        # and a single character that is none is a step in byte pieces.
        self.step = {p: self.scores.get(p, -np.inf if len(p) > 1 else self.unknown) for p in self.prefixes}
        self.words_apart = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self._known: dict[str, tuple[float, tuple[int, ...]]] = {}

    def marked(self, text: str) -> str:
        return BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK)

    def spelled(self, c: str) -> list[int]:
        return [self.bytes[x] for x in (BLANK if c == LITERAL else c).encode("utf-8")]

    def steps(self, t: str, i: int):
        """(end, score) of the pieces that start at i; a character without a
        piece of its own is a step in byte pieces."""
        j, single = i + 1, False
        while j <= len(t) and t[i:j] in self.prefixes:
            if (s := self.scores.get(t[i:j])) is not None:
                yield j, s
                single = single or j == i + 1
            j += 1
        if not single:
            yield i + 1, self.unknown

    def forward(self, t: str, start: int, stop: int):
        """Best sums from ``start`` to every position up to ``len(t)`` by pieces
        that start before ``stop``, and where the last piece began."""
        best = np.full(len(t) + 1, -np.inf)
        back = np.zeros(len(t) + 1, np.int64)
        at = best.tolist()
        at[start] = 0.0
        came = back.tolist()
        minus = -np.inf
        for i in range(start, stop):
            here = at[i]
            if here == minus:
                continue
            for j, s in self.steps(t, i):
                if here + s > at[j]:
                    at[j], came[j] = here + s, i
        return at, came

    def traced(self, t: str, came: list, start: int, end: int) -> list[int]:
        out = []
        while end > start:
            i = came[end]
            p = self.ids.get(t[i:end])
            out.append([p] if p is not None else self.spelled(t[i]))
            end = i
        return [x for part in reversed(out) for x in part]

    def word(self, w: str) -> tuple[float, tuple[int, ...]]:
        got = self._known.get(w)
        if got is None:
            got = self._best(w)
            if len(w) <= 64:
                if len(self._known) >= self.LIMIT:
                    self._known.clear()
                self._known[w] = got
        return got

    def _best(self, w: str) -> tuple[float, tuple[int, ...]]:
        """Best sum and ids of a whole word: ``forward`` and ``traced`` in one loop."""
        n, step, ids, unknown = len(w), self.step.get, self.ids.get, self.unknown
        at, came = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i in range(n):
            here = at[i]
            for j in range(i + 1, n + 1):
                s = step(w[i:j])
                if s is None:
                    if j > i + 1:
                        break
                    s = unknown
                if here + s > at[j]:
                    at[j], came[j] = here + s, i
        out, end = [], n
        while end:
            out.append(ids(w[came[end]:end]))
            end = came[end]
        return at[n], tuple(self.traced(w, came, 0, n) if None in out else reversed(out))

    def cuts(self, t: str, lo: int, hi: int) -> list[int]:
        """Sure boundaries in [lo, hi]: before a blank that follows another character."""
        if not self.words_apart:
            return []
        out, i = [], max(lo, 1)
        while (i := t.find(BLANK, i)) != -1 and i <= hi:
            if t[i - 1] != BLANK:
                out.append(i)
            i += 1
        return out

    def path(self, t: str, start: int, end: int) -> list[int]:
        """Ids of the best way from ``start`` to ``end``."""
        t = t[start:end]
        known, out = self._known, []
        for w in _STRETCHES.findall(t) if self.words_apart else [t]:
            out += (known.get(w) or self.word(w))[1]
        return out

    def plain(self, t: str) -> str:
        return t.replace(BLANK, " ").replace(LITERAL, BLANK)

    def whole(self, texts: list[str]) -> pa.Array:
        """The ids of marked texts of one chunk."""
        return pa.array([self.path(t, 0, len(t)) for t in texts], pa.list_(pa.int32()))

    def through(self, t: str, behind: int, stop: int, first: bool, last: bool, a: int, z: int):
        """Where the chunk's pieces begin and end between states ``a`` and ``z``, and their ids."""
        return a, stop + z, self.path(t, a, stop + z)

    def matrix(self, t: str, behind: int, stop: int, first: bool, last: bool) -> np.ndarray:
        """The chunk ``t[:stop]`` with its look-ahead as a max-plus matrix."""
        size = self.longest
        m = np.full((size, size), -np.inf)
        marks = self.cuts(t, size, stop - 1)
        head_end = marks[0] if marks else None
        if head_end is not None:
            middle = sum(self.word(t[a:b])[0] for a, b in zip(marks, marks[1:]))
            tail, _ = self.forward(t[marks[-1]:], 0, stop - marks[-1])
            tail = tail[stop - marks[-1]:]
        for i in range(min(size, stop + 1)):
            if head_end is not None:
                at, _ = self.forward(t[:head_end], i, head_end)
                ways = [at[head_end] + middle + x for x in tail]
            else:
                ways = self.forward(t, i, stop)[0][stop:]
            ways = ways[:1] if last else ways[:size]
            m[i, :len(ways)] = ways
        return m

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """The characters of each list of ids; lists without byte pieces above ASCII go in Arrow."""
        flat, offsets = ids.flatten(), ids.offsets.to_numpy()
        of_id = self.strings.take(flat)
        offsets = offsets - offsets[0]
        spelled = np.diff(np.concatenate([[0], np.cumsum(of_id.is_null().to_numpy(zero_copy_only=False))])[offsets]) > 0
        # The pieces lie one after the other in memory: a text is where its first begins up to where its last ends.
        _, at, data = of_id.buffers()
        at = np.frombuffer(at, np.int32, len(of_id) + 1) if len(of_id) else np.zeros(1, np.int32)
        texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(at[offsets]), data or pa.py_buffer(b""))
        if spelled.any():
            texts = texts.to_pylist()
            for k in np.flatnonzero(spelled):
                texts[k] = self.decode(flat[offsets[k]:offsets[k + 1]].to_pylist())
            return pa.array(texts, pa.string())
        return texts

    def decode(self, ids) -> str:
        try:
            return "".join([self.shown[i] for i in ids])
        except KeyError:  # some characters are spelled in bytes
            out, pending = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8"))
                pending.clear()
            out.append(self.shown[i])
        out.append(pending.decode("utf-8"))
        return "".join(out)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def chunks_of(marked: str, behind: int, ahead: int, size: int):
    """(number, number of chunks, chunk with the characters around it, how many of them
    stand before it, its own length)."""
    n = max(1, -(-len(marked) // size))
    for k in range(n):
        lo = max(k * size - behind, 0)
        yield k, n, marked[lo:(k + 1) * size + (ahead if k + 1 < n else 0)], k * size - lo, min(size, len(marked) - k * size)


def states(matrices: list[np.ndarray], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states at both ends of each of the matrices on the best way."""
    forward, v = [], np.full(len(matrices[0]), -np.inf)
    v[entry] = 0.0
    for m in matrices:
        forward.append(v)
        v = (v[:, None] + m).max(axis=0)
    out, end = [], exit_
    for v, m in zip(reversed(forward), reversed(matrices)):
        start = int((v + m[:, end]).argmax())
        out.append((start, end))
        end = start
    return out[::-1]


_RESULT = ("doc_id {}, chunk int, n_chunks int, start long, ids array<int>, text string")


def _scan(docs: DataFrame, load, model: str, size: int) -> DataFrame:
    """``load(model)`` gives the weights; see ``encode`` for the columns."""
    weights = load(model)
    if size < 2 * weights.longest:
        raise ValueError(f"chunks need at least {2 * weights.longest} characters")
    behind, ahead = weights.behind, weights.ahead
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    result = _RESULT.format(id_type)
    names = ["doc_id", "chunk", "n_chunks", "start", "ids", "text"]

    def one_chunk(batches):
        p = load(model)
        for b in slices(batches, 1):
            n, texts = b.num_rows, [p.marked(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int64()),
                 p.whole(texts), pa.array([p.plain(t) for t in texts], pa.string())], names=names)

    def cut(batches):
        p = load(model)
        for b in slices(batches, 2):
            for k, (doc, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for part in itertools.batched(chunks_of(p.marked(text), behind, ahead, size), 64):
                    n = len(part)
                    number, of, t, before, stop = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array([k] * n)), pa.array([doc] * n, pa.int64()), pa.array(number, pa.int32()),
                         pa.array(of, pa.int32()), pa.array([x.encode("utf-8", "surrogatepass") for x in t], pa.binary()),
                         pa.array(before, pa.int32()), pa.array(stop, pa.int32())],
                        names=["doc_id", "doc", "chunk", "n_chunks", "t", "behind", "stop"])

    short = rows.filter(F.length("text") < size).mapInArrow(one_chunk, result)
    long_rows = rows.filter(F.length("text") >= size).withColumn("doc", F.monotonically_increasing_id())
    chunks = written(long_rows.select("doc_id", "doc", "text").mapInArrow(
        cut, f"doc_id {id_type}, doc long, chunk int, n_chunks int, t binary, behind int, stop int")
        .repartition("doc", "chunk"), "chunks")  # the chunks of one text go to all tasks

    def restored(t: bytes) -> str:
        return t.decode("utf-8", "surrogatepass")

    def transfer(batches):
        p = load(model)
        for b in slices(batches, 3):
            _, chunk, of, t, before, stop = (b.column(i).to_pylist() for i in range(6))
            found = [p.matrix(restored(x), v, s, c == 0, c + 1 == n) for x, v, s, c, n in zip(t, before, stop, chunk, of)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c // GROUP for c in chunk], pa.int32()),
                 pa.array([m.tobytes() for m in found], pa.binary()), pa.array([len(m) for m in found], pa.int32())],
                names=["doc", "chunk", "grp", "m", "height"])

    def table(m: bytes, height: int) -> np.ndarray:
        return np.frombuffer(m).reshape(height, -1)

    def rows_of(batches, n):
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(n)))

    def emit(rows, names, types, n=1000):
        rows = iter(rows)
        while part := list(itertools.islice(rows, n)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    def join_group(batches):
        def go():
            for (doc, grp), run in itertools.groupby(rows_of(batches, 5), key=lambda r: r[:2]):
                m = None
                for _, _, _, *x in run:
                    m = table(*x) if m is None else combined(m, table(*x))
                yield doc, grp, m.tobytes(), len(m)
        yield from emit(go(), ["doc", "grp", "m", "height"], [pa.int64(), pa.int32(), pa.binary(), pa.int32()])

    def group_ends(batches):
        def go():
            for doc, run in itertools.groupby(rows_of(batches, 4), key=lambda r: r[0]):
                run = list(run)  # one matrix per GROUP * CHUNK characters of one document
                for (_, grp, *_), (a, z) in zip(run, states([table(*m) for _, _, *m in run], 0, 0)):
                    yield doc, grp, a, z
        yield from emit(go(), ["doc", "grp", "a", "z"], [pa.int64(), pa.int32(), pa.int32(), pa.int32()])

    def chunk_ends(batches):
        def go():
            for (doc, _), run in itertools.groupby(rows_of(batches, 7), key=lambda r: r[:2]):
                run = list(run)  # at most GROUP matrices
                for r, (a, z) in zip(run, states([table(*r[3:5]) for r in run], run[0][5], run[0][6])):
                    yield doc, r[2], a, z
        yield from emit(go(), ["doc", "chunk", "a", "z"], [pa.int64(), pa.int32(), pa.int32(), pa.int32()])

    def trace(batches):
        p = load(model)
        for b in slices(batches, 3):
            start, ids, text = [], [], []
            for chunk, of, t, before, stop, a, z in zip(*(b.column(i).to_pylist() for i in range(1, 8))):
                t = restored(t)
                lo, hi, found = p.through(t, before, stop, chunk == 0, chunk + 1 == of, a, z)
                start.append(chunk * size - before + lo)
                ids.append(np.array(found, np.int32))
                text.append(p.plain(t[lo:hi]))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(start, pa.int64()),
                 pa.ListArray.from_arrays(offsets, np.concatenate([*ids, np.empty(0, np.int32)])), pa.array(text, pa.string())],
                names=names)

    matrices = written(chunks.select("doc", "chunk", "n_chunks", "t", "behind", "stop").mapInArrow(
        transfer, "doc long, chunk int, grp int, m binary, height int"), "matrices")
    groups = written(matrices.select("doc", "grp", "chunk", "m", "height").repartition("doc", "grp").sortWithinPartitions(
        "doc", "grp", "chunk").mapInArrow(
        join_group, "doc long, grp int, m binary, height int"), "group-matrices")
    ends = groups.repartition("doc").sortWithinPartitions("doc", "grp").mapInArrow(
        group_ends, "doc long, grp int, a int, z int")
    inner = matrices.join(merged(ends), ["doc", "grp"]).select("doc", "grp", "chunk", "m", "height", "a", "z") \
        .repartition("doc", "grp").sortWithinPartitions("doc", "grp", "chunk").mapInArrow(
            chunk_ends, "doc long, chunk int, a int, z int")
    traced = chunks.join(merged(inner), ["doc", "chunk"]) \
        .select("doc_id", "chunk", "n_chunks", "t", "behind", "stop", "a", "z").mapInArrow(trace, result)
    return short.unionByName(traced)


def encode(docs: DataFrame, model: str | None = None, size: int = CHUNK) -> DataFrame:
    """``doc_id, chunk, n_chunks, start, ids, text`` per chunk, by the sum of scores:
    ``start`` is the chunk's first character in the marked text (which begins with a
    blank), ``text`` the characters that its pieces cover."""
    return _scan(docs, pieces, model or default_model(), size)


class Merges:
    """A BPE model's pieces, which of them the merges leave side by side, and the
    library's encoder without the leading blank. Texts have blanks for U+2581."""

    LIMIT = 1_000_000

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rule, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != trained.BPE:
            raise ValueError("not a BPE model; encode() is for models that choose by the sum of scores")
        if rule.name != "identity" or rule.remove_extra_whitespaces or not rule.escape_whitespaces \
                or trained.treat_whitespace_as_suffix:
            raise ValueError("the model rewrites texts before it cuts them")
        if not trained.byte_fallback or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
            raise ValueError("the model needs byte pieces, and pieces that come from merges alone")
        self.lead = " " if rule.add_dummy_prefix else ""
        rule.add_dummy_prefix = False
        self._encode = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()).encode
        self.of = {p.piece.replace(BLANK, " "): i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.longest = max(map(len, self.of))
        self.behind, self.ahead = self.longest, self.longest - 1  # characters around a chunk that it reads
        self.pairs = {p[i:i + 2] for p in self.of for i in range(len(p) - 1)}
        self.prefixes = {p[:k] for p in self.of for k in range(2, len(p) + 1)}
        self._sound: dict[str, bool] = {}
        self._apart: dict[tuple[str, str], bool] = {}

    def marked(self, text: str) -> str:
        return self.lead + text if text else ""

    def plain(self, t: str) -> str:
        return t

    def whole(self, texts: list[str]) -> pa.Array:
        """The ids of texts of one chunk, one text after the other in one array."""
        found = [np.array(self._encode(t), np.int32) for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), np.concatenate([*found, np.empty(0, np.int32)]))

    def symbol(self, q: str) -> list[int]:
        """The id of a piece, or the byte pieces of a character."""
        found = self.of.get(q)
        return self._encode(q) if found is None else [found]

    def sound(self, q: str) -> bool:
        """Whether the merges make one piece of ``q``; a character always stands."""
        if len(q) == 1:
            return True
        got = self._sound.get(q)
        if got is None:
            got = self._sound[q] = self._encode(q) == [self.of[q]]
        return got

    def apart(self, p: str | None, q: str) -> bool:
        """Whether the step from ``p`` to ``q`` weighs 0; ``p`` is None at a boundary
        that no piece spans."""
        if p is None or p[-1] + q[0] not in self.pairs:
            return self.sound(q)
        got = self._apart.get((p, q))
        if got is None:
            if len(self._apart) >= self.LIMIT:
                self._apart.clear()
            got = self._apart[p, q] = self._encode(p + q) == self.symbol(p) + self.symbol(q)
        return got

    def steps(self, u: str, i: int):
        """Ends of the pieces that start at ``i``; a character without piece is one."""
        j = i + 1
        yield j
        while (j := j + 1) <= len(u) and (q := u[i:j]) in self.prefixes:
            if q in self.of:
                yield j

    def over(self, u: str, at: int) -> list[tuple[int, int]]:
        """The states of a border: pieces that begin before it and end there or behind."""
        return [(s, e) for s in range(max(at - self.longest, 0), at) for e in self.steps(u, s)
                if e >= at and self.sound(u[s:e])]

    def sure(self, u: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last boundary in [lo, hi) that no piece spans; a text's begin is one."""
        def spanned(i):
            return i > 0 and u[i - 1:i + 1] in self.pairs
        first = next((i for i in range(lo, hi) if not spanned(i)), None)
        return None if first is None else (first, next(i for i in range(hi - 1, first - 1, -1) if not spanned(i)))

    def reached(self, u: str, begins: list[tuple], stop: int) -> dict[int, dict]:
        """Pieces (by end, then start) on ways of weight 0 from the pieces ``begins``, by
        pieces that start before ``stop``: the bits of the begins they are reached from,
        and where the piece before starts (one alone for each begin)."""
        at: dict[int, dict] = {}
        for k, (s, e) in enumerate(begins):
            at.setdefault(e, {}).setdefault(s, [0, None])[0] |= 1 << k
        for e in range(min(at), stop):
            here = at.get(e)
            if here is None:
                continue
            for end in self.steps(u, e):
                q = u[e:end]
                for s, (bits, _) in here.items():
                    if self.apart(None if s is None else u[s:e], q):
                        at.setdefault(end, {}).setdefault(e, [0, s])[0] |= bits
        return at

    def matrix(self, t: str, behind: int, stop: int, first: bool, last: bool) -> np.ndarray:
        """The chunk ``t[behind:behind + stop]`` as a max-plus matrix of 0 and minus
        infinity; a document's begin and end are one state each."""
        u, end = t.replace(BLANK, " "), behind + stop
        begins = [(None, behind)] if first else self.over(u, behind)
        exits = [None] if last else self.over(u, end)

        def bits(at, where, start=None):
            found = at.get(where, {})
            if start is not None:
                return found[start][0] if start in found else 0
            return reduce(operator.or_, (b for b, _ in found.values()), 0)

        inner = self.sure(u, behind, end)
        at = self.reached(u, begins, inner[0] if inner else end)
        if inner is None:
            ways = [bits(at, end) if x is None else bits(at, x[1], x[0]) for x in exits]
        else:
            head, tail = bits(at, inner[0]), {} if last else self.reached(u, [(None, inner[1])], end)
            ways = [head if x is None or bits(tail, x[1], x[0]) else 0 for x in exits]
        return np.array([[0.0 if w >> k & 1 else -np.inf for w in ways] for k in range(len(begins))])

    def traced(self, u: str, begin: tuple, stop: int, end: int, start: int | None = None) -> list[int]:
        """Ids after the piece ``begin`` up to ``end``, the last piece starting at ``start``."""
        at = self.reached(u, [begin], stop)
        s, e = next(iter(at[end])) if start is None else start, end
        out = []
        while (s, e) != begin:
            out.append(self.symbol(u[s:e]))
            s, e = at[e][s][1], s
        return [x for ids in reversed(out) for x in ids]

    def through(self, t: str, behind: int, stop: int, first: bool, last: bool, a: int, z: int):
        """Where the chunk's pieces begin and end between states ``a`` and ``z``, and their ids."""
        u, end = t.replace(BLANK, " "), behind + stop
        begin = (None, behind) if first else self.over(u, behind)[a]
        start, to = (None, end) if last else self.over(u, end)[z]
        inner = self.sure(u, behind, end)
        if inner is None:
            return begin[1], to, self.traced(u, begin, end, to, start)
        ids = self.traced(u, begin, inner[0], inner[0])
        if last:
            return begin[1], to, ids + self._encode(u[inner[0]:end])
        return begin[1], to, ids + self._encode(u[inner[0]:inner[1]]) + self.traced(u, (None, inner[1]), end, to, start)


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


def tokenize(docs: DataFrame, model: str | None = None, size: int = CHUNK) -> DataFrame:
    """The ids of a BPE model, in the columns of ``encode``; ``start`` counts the leading
    blank that the model gives every text."""
    return _scan(docs, merges, model or default_model(), size)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds ``decoded``, the characters of each chunk's ids, to rows of ``encode`` or ``tokenize``."""
    model = model or default_model()

    def back(batches):
        p = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, p.decode_all(b.column(b.schema.get_field_index("ids")))],
                                             names=[*b.schema.names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(back, schema + ", decoded string")
