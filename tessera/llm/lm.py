"""Language-model scores by a weighted backoff automaton.

The model is a smoothed bigram model over the words of the training documents.
As an automaton: the root has an arc for every known word; every word seen in
training is a state with arcs for the words that followed it; a word without an
arc takes the state's failure arc to the root, which has a weight of its own.

    root arc    (c(w) - d) / N; the unknown word gets the discounted d * V / N
    state arc   (c(hw) + MU * p(w)) / (c(h) + MU)
    failure arc  MU / (c(h) + MU)

so the arcs of a state with its failure arc sum to one. d is n1 / (n1 + 2 * n2)
from the counts of words seen once and twice. A text is read once from left to
right; the state after a word is the word (the text's begin is the state of the
end token), and the arc weights add up.

No task holds the model. Documents are gathered in blocks of about
``BLOCK_TOKENS`` tokens with a vocabulary of their own. Each block sends its
distinct words and bigrams with their training counts once, cut into buckets by
hash; a bucket adds up the blocks' counts and answers every block with the
totals, in the order asked. A block then builds just the part of the automaton
its texts walk through. What moves grows with the distinct n-grams of the
blocks, and a frequent word is one entry per block.

Words are told apart by 64-bit hashes, bigrams inside a bucket by 48 bits.

Defined cases: null text counts as empty (one end token); a null ``doc_id`` has
the crc32 of empty text, which is 0, and is held out; rows that repeat an id are
documents of their own; without any training document every probability is that
of the unknown word; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import arrow_limits, crc32_text, merged, pick, written

BLOCK_TOKENS = 400_000
BLOCKS_PER_BATCH = 16       # rows of the block tables that a task holds together
BUCKET_GRAMS = 1_000_000   # tokens of the corpus per bucket
MU = 4.0
BASE_ADD = 0.1

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = xxhash.xxh3_64_intdigest(b"")  # no word is empty


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks_of(docs: DataFrame) -> DataFrame:
    """``block, doc_ids, train, n_tokens, vocab, tokens``: documents as numbers of
    a block's own vocabulary (number 0 is the end token)."""
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (crc32_text(F.col("doc_id")) % 10 != 0).alias("train"),
        F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def gather(batches):
        vocab, tokens, ids, train, sizes = {b"": 0}, [], [], [], []

        def emit():
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab))
            flat = np.concatenate(tokens)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(id_arrow)), pa.array([train], pa.list_(pa.bool_())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([hashes.tobytes()], pa.binary()),
                 pa.array([flat.tobytes()], pa.binary())],
                names=["doc_ids", "train", "n_tokens", "vocab", "tokens"])

        total = 0
        for b in batches:
            id_arrow = b.column(0).type
            for doc_id, is_train, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                numbers = [vocab.setdefault(w, len(vocab)) for w in t.translate(_LOWER).split()]
                numbers.append(0)
                tokens.append(np.array(numbers, np.uint32))
                ids.append(doc_id)
                train.append(is_train)
                sizes.append(len(numbers))
                total += len(numbers)
                if total >= BLOCK_TOKENS:
                    yield emit()
                    vocab, tokens, ids, train, sizes, total = {b"": 0}, [], [], [], [], 0
        if ids:
            yield emit()

    schema = f"doc_ids array<{id_type}>, train array<boolean>, n_tokens array<long>, vocab binary, tokens binary"
    with arrow_limits(docs.sparkSession, 500):
        return written(rows.mapInArrow(gather, schema).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


class BlockGrams:
    """The distinct words and bigrams of a block in a fixed order, by bucket."""

    def __init__(self, vocab: bytes, tokens: bytes, sizes, train, n_buckets: int):
        self.words = np.frombuffer(vocab, np.uint64)
        self.tokens = np.frombuffer(tokens, np.uint32).astype(np.int64)
        self.sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.history = np.empty_like(self.tokens)
        self.history[1:] = self.tokens[:-1]
        self.history[self.ends - self.sizes] = 0
        self.train = np.repeat(np.asarray(train, bool), self.sizes)
        v = len(self.words)
        pairs, self.pair_at = np.unique(self.history * v + self.tokens, return_inverse=True)
        self.pair_history = pairs // v
        bigrams = _mix(self.words[self.pair_history] * np.uint64(0x9E3779B97F4A7C15) + self.words[pairs % v])
        self.word_counts = np.bincount(self.tokens[self.train], minlength=v)
        self.pair_counts = np.bincount(self.pair_at[self.train], minlength=len(pairs))
        self.word_order, self.word_cuts = self._dealt(self.words, n_buckets)
        self.pair_order, self.pair_cuts = self._dealt(bigrams, n_buckets)
        self.bigrams = bigrams & np.uint64((1 << 48) - 1)

    @staticmethod
    def _dealt(keys, n_buckets):
        bucket = ((_mix(keys + np.uint64(1)) >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))

    def requests(self):
        """``(bucket, words, their counts, bigrams, their counts)`` as bytes."""
        for k in range(len(self.word_cuts) - 1):
            w = self.word_order[self.word_cuts[k]:self.word_cuts[k + 1]]
            p = self.pair_order[self.pair_cuts[k]:self.pair_cuts[k + 1]]
            if len(w) or len(p):
                yield (k, self.words[w].tobytes(), self.word_counts[w].astype(np.uint32).tobytes(),
                       self.bigrams[p].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                       self.pair_counts[p].astype(np.uint32).tobytes())

    def totals(self, answers: dict):
        """Totals of words and bigrams in the block's order from all buckets' answers."""
        words, pairs = np.zeros(len(self.words), np.int64), np.zeros(len(self.bigrams), np.int64)
        for k in range(len(self.word_cuts) - 1):
            w = self.word_order[self.word_cuts[k]:self.word_cuts[k + 1]]
            p = self.pair_order[self.pair_cuts[k]:self.pair_cuts[k + 1]]
            if len(w) or len(p):
                a, b = answers[k]
                words[w], pairs[p] = _unpacked(a, len(w)), _unpacked(b, len(p))
        return words, pairs


def _packed(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    top = int(x.max()) if len(x) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return x.astype(kind).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _added(parts: list[np.ndarray], counts: list[np.ndarray]):
    """Totals per key over all parts; returns (keys' totals, answers per part)."""
    if not parts:
        return np.zeros(0, np.int64), []
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts).astype(np.float64), minlength=len(keys)).astype(np.int64)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return total, np.split(total[at], cuts)


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: add up all blocks' counts, answer each block, and count words."""
    blocks = table.column("block").to_pylist()
    words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    word_n = [np.frombuffer(x, np.uint32) for x in table.column("word_n").to_pylist()]
    pairs = []
    for x in table.column("pairs").to_pylist():
        wide = np.zeros((len(x) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
        pairs.append(wide.reshape(-1).view(np.uint64))
    pair_n = [np.frombuffer(x, np.uint32) for x in table.column("pair_n").to_pylist()]
    total, word_answers = _added(words, word_n)
    _, pair_answers = _added(pairs, pair_n)
    stats = [int((total > 0).sum()), int(total.sum()), int((total == 1).sum()), int((total == 2).sum())]
    first = [1] + [0] * (len(blocks) - 1)
    return pa.table({
        "block": pa.array(blocks, pa.int64()), "bucket": table.column("bucket"),
        "words": pa.array([_packed(x) for x in word_answers], pa.binary()),
        "pairs": pa.array([_packed(x) for x in pair_answers], pa.binary()),
        **{name: pa.array([x * f for f in first], pa.int64()) for name, x in zip(("v", "n", "n1", "n2"), stats)}})


class Automaton:
    """The part of the backoff automaton that a block's bigrams touch: log10
    weights of the root's arcs, the states' failure arcs and the states' arcs."""

    def __init__(self, words, pairs, pair_history, pair_words, v, n, n1, n2, mu: float = MU):
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        known = np.maximum(words - d, 0) / max(n, 1)
        self.p = np.where(words > 0, known, (d * v / n) if n else 1.0)
        self.root = np.log10(self.p)
        self.failure = np.log10(mu / (words + mu))
        with np.errstate(divide="ignore"):
            arcs = np.log10((pairs + mu * self.p[pair_words]) / (words[pair_history] + mu))
        # A pair that training does not have takes the failure arc and the root's arc.
        self.arcs = np.where(pairs > 0, arcs, self.failure[pair_history] + self.root[pair_words])

    def walk(self, pair_at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sums of the arc weights along texts given as arcs taken, text by text."""
        return np.add.reduceat(self.arcs[pair_at], starts)


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    ship_package(docs.sparkSession)
    blocks = blocks_of(docs)
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    total = blocks.agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_buckets = int(total // BUCKET_GRAMS) + 1

    def ask(batches):
        for b in batches:
            for block, vocab, tokens, sizes, train in zip(*(b.column(i).to_pylist() for i in range(5))):
                found = list(BlockGrams(vocab, tokens, sizes, train, n_buckets).requests())
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(found), pa.int64()), pa.array(columns[0], pa.int32()),
                     *[pa.array(c, pa.binary()) for c in columns[1:]]],
                    names=["block", "bucket", "words", "word_n", "pairs", "pair_n"])

    wanted = blocks.select("block", "vocab", "tokens", "n_tokens", "train")
    asked = wanted.mapInArrow(
        ask, "block long, bucket int, words binary, word_n binary, pairs binary, pair_n binary")
    with arrow_limits(docs.sparkSession, BLOCKS_PER_BATCH):
        answers = written(asked.groupBy("bucket").applyInArrow(
            _answer, "block long, bucket int, words binary, pairs binary, v long, n long, n1 long, n2 long"), "lm-answers")
    v, n, n1, n2 = (x or 0 for x in answers.agg(F.sum("v"), F.sum("n"), F.sum("n1"), F.sum("n2")).first())

    def score(batches):
        for b in batches:
            for vocab, tokens, sizes, train, ids, got in zip(*(b.column(i).to_pylist() for i in range(6))):
                grams = BlockGrams(vocab, tokens, sizes, train, n_buckets)
                words, pairs = grams.totals({a["bucket"]: (a["words"], a["pairs"]) for a in got})
                pair_words = np.zeros(len(pairs), np.int64)
                pair_words[grams.pair_at] = grams.tokens
                model = Automaton(words, pairs, grams.pair_history, pair_words, v, n, n1, n2)
                starts = grams.ends - grams.sizes
                base = np.log10((words + BASE_ADD) / (n + BASE_ADD * (v + 1)))
                m = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, b.column(4).type.value_type), pa.array([not x for x in train], pa.bool_()),
                     pa.array(grams.sizes), pa.array(np.add.reduceat((words[grams.tokens] > 0).astype(np.int64), starts)),
                     pa.array([n] * m, pa.int64()), pa.array(np.add.reduceat(base[grams.tokens], starts)),
                     pa.array(model.walk(grams.pair_at, starts))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # A block's answers are as many bytes as its distinct n-grams: bounded by the block.
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "words", "pairs")).alias("got"))
    joined = blocks.join(merged(per_block), "block").select("vocab", "tokens", "n_tokens", "train", "doc_ids", "got")
    with arrow_limits(docs.sparkSession, BLOCKS_PER_BATCH):
        return written(joined.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, "
                                                "train_tokens long, base_score double, score double"), "lm-scores")
