"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its byte n-grams (4 and 5, with begin and end marks), each
hashed to an embedding; a stretch of text is the mean of its words' embeddings,
and a softmax over two classes reads it. Embeddings and softmax are trained
jointly in numpy. Unseen and misspelt words share n-grams with seen ones.

A document is judged by its most toxic window of ``WINDOW`` words, so a long
text does not drown a short passage. Training knows labels of documents only: in
every epoch each document is represented by the window that the present model
finds most toxic (multiple-instance learning).

The classifier is fitted on the driver on a bounded sample, the labelled rows
with the smallest hash of their id, at most ``PER_CLASS`` documents and
``CLASS_BYTES`` bytes of each class, whole texts; everything else reads all rows. The softmax over a mean is linear in the
n-grams, so for scoring an n-gram is one number, a table of fixed size that
travels with the tasks.

Defined cases: null text counts as empty; a text without words gets the score of
the bias alone (towards clean); of several labels for one id the larger counts,
null labels count as none; a null ``doc_id`` has the crc32 of empty text (0), so
it is held out; without labels of both classes every score is 0; rows that
repeat an id are scored one by one, and the fit takes the smallest of their texts; an empty table gives an empty result; other
columns are ignored unless carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, pick, slices

BUCKETS = 1 << 17
DIM = 8
GRAMS = (4, 5)
WINDOW = 4
PER_CLASS = 2000
CLASS_BYTES = 12 << 20  # of the sample's texts of a class
EPOCHS = 20
RATE = 0.3
DECAY = 1e-4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Bags:
    """Texts as word numbers over a common vocabulary with its n-grams' buckets, the
    words' n-grams one after the other. Whatever is as long as the texts or the n-grams
    is held in 32 bits and worked on in slices, so the fit's memory is a few times the
    sample's."""

    SLICE = 1 << 16  # words or n-grams at a time

    def __init__(self, texts: list[bytes]):
        vocab: dict[bytes, int] = {}
        numbers = [np.array([vocab.setdefault(w, len(vocab)) for w in t.split()], np.int32) for t in texts]
        self.sizes = np.array([len(x) for x in numbers], np.int64)
        self.words = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
        self.n_words = len(vocab)
        words = list(vocab)
        del numbers, vocab
        made = [self._grams(words[i:i + self.SLICE]) for i in range(0, len(words), self.SLICE)]
        self.grams = np.concatenate([g for g, _ in made]) if made else np.zeros(0, np.int32)
        self.n_grams = np.concatenate([n for _, n in made]) if made else np.zeros(0, np.int64)
        self.cuts = np.cumsum(self.n_grams) - self.n_grams

    @staticmethod
    def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the words' n-grams, word after word, and their numbers."""
        joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) + 2 for w in words])
        grams, owners = [], []
        for n in GRAMS:
            if len(joined) < n:
                continue
            code = np.full(len(joined) - n + 1, np.uint64(n))
            for i in range(n):
                code = code * np.uint64(1099511628211) + joined[i:len(joined) - n + 1 + i]
            inside = owner[:len(code)] == owner[n - 1:]
            grams.append((_mix(code[inside]) & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(owner[:len(code)][inside])
        if not grams:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        owners = np.concatenate(owners)
        return np.concatenate(grams)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def flat_grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the given words, word after word, and which word has each."""
        n = self.n_grams[words]
        first = np.cumsum(n) - n
        return self.grams[np.repeat(self.cuts[words] - first, n) + np.arange(n.sum())], np.repeat(np.arange(len(words)), n)

    def word_values(self, gram_values: np.ndarray) -> np.ndarray:
        """Mean of the n-grams' values for each word of the vocabulary."""
        out = np.zeros(self.n_words)
        for lo in range(0, self.n_words, self.SLICE):
            words = np.arange(lo, min(lo + self.SLICE, self.n_words))
            buckets, owner = self.flat_grams(words)
            out[words] = np.bincount(owner, weights=gram_values[buckets], minlength=len(words)) / np.maximum(self.n_grams[words], 1)
        return out

    def _slices(self):
        """Runs of texts with about ``SLICE`` words: first and last text, their words'
        place, begin and end of all their windows and the texts' first windows."""
        ends = np.cumsum(self.sizes)
        lo = 0
        while lo < len(self.sizes):
            base = ends[lo] - self.sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + self.SLICE, side="right")))
            sizes = self.sizes[lo:hi]
            per = np.maximum(1, sizes - WINDOW + 1)
            first = np.cumsum(per) - per
            text = np.repeat(np.arange(len(sizes)), per)
            upto = np.cumsum(sizes)
            begin = (upto - sizes)[text] + np.arange(len(text)) - first[text]
            yield lo, hi, base, begin, np.minimum(begin + WINDOW, upto[text]), first, text
            lo = hi

    def _means(self, values: np.ndarray, lo: int, hi: int, base: int, begin, end) -> np.ndarray:
        """The windows' means; ``values`` are the words'."""
        here = self.words[base:base + int(self.sizes[lo:hi].sum())]
        run = np.concatenate([[0.0], np.cumsum(values[here])])
        return (run[end] - run[begin]) / np.maximum(end - begin, 1)

    def best_means(self, gram_values: np.ndarray) -> np.ndarray:
        """For each text the highest window mean."""
        values = self.word_values(gram_values)
        return np.concatenate([np.maximum.reduceat(self._means(values, lo, hi, base, begin, end), first)
                               for lo, hi, base, begin, end, first, _ in self._slices()])

    def best_windows(self, gram_values: np.ndarray):
        """For each text begin and end of the first window with the highest mean."""
        values, begins, ends = self.word_values(gram_values), [], []
        for lo, hi, base, begin, end, first, text in self._slices():
            means = self._means(values, lo, hi, base, begin, end)
            top = np.flatnonzero(means == np.maximum.reduceat(means, first)[text])
            at = top[np.searchsorted(text[top], np.arange(hi - lo))]
            begins.append(begin[at] + base)
            ends.append(end[at] + base)
        return np.concatenate(begins), np.concatenate(ends)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7):
    """Fit embeddings and softmax by Adagrad on full batches; returns the
    n-grams' values (their share in the difference of the two logits) and the bias."""
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    soft = rng.uniform(-1, 1, (DIM, 2)) / DIM
    bias = np.zeros(2)
    g_emb, g_soft, g_bias = np.full(emb.shape, 1e-8), np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    y = np.eye(2)[labels]
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    for _ in range(epochs):
        begin, end = bags.best_windows(emb @ (soft[:, 1] - soft[:, 0]))
        n = np.maximum(end - begin, 1)
        inside = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange((end - begin).sum())
        words, text = bags.words[inside], np.repeat(np.arange(len(n)), end - begin)
        used = np.unique(words)
        at = np.searchsorted(used, words)
        # Words in use and their n-grams.
        lens = bags.n_grams[used]
        flat, own = bags.flat_grams(used)
        word_vec = np.stack([np.bincount(own, weights=emb[flat, k], minlength=len(used)) for k in range(DIM)], 1)
        word_vec /= np.maximum(lens, 1)[:, None]
        doc_vec = np.stack([np.bincount(text, weights=word_vec[at, k], minlength=len(n)) for k in range(DIM)], 1) / n[:, None]
        logits = doc_vec @ soft + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - y) * share[:, None]
        d_soft = doc_vec.T @ err
        d_doc = (err @ soft.T) / n[:, None]
        d_word = np.stack([np.bincount(at, weights=d_doc[text, k], minlength=len(used)) for k in range(DIM)], 1)
        d_word /= np.maximum(lens, 1)[:, None]
        d_emb = np.stack([np.bincount(flat, weights=d_word[own, k], minlength=BUCKETS) for k in range(DIM)], 1)
        d_emb += DECAY * share.mean() * emb * (d_emb != 0)
        for value, grad, seen in ((emb, d_emb, g_emb), (soft, d_soft, g_soft), (bias, err.sum(0), g_bias)):
            seen += grad * grad
            value -= RATE * grad / np.sqrt(seen)
    return emb @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def scores_of(texts: list[bytes], gram_values: np.ndarray, bias: float) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    best = Bags(texts).best_means(gram_values)
    return 1.0 / (1.0 + np.exp(-np.clip(best + bias, -60, 60)))


def prepared(text):
    """What both training and scoring read: the lower-cased text in UTF-8."""
    return F.lower(F.coalesce(text, F.lit(""))).cast("binary")


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most: int = CLASS_BYTES):
    """At most ``per_class`` labelled training texts of each class, by the hash of their
    ids, and of those the first that are ``most`` bytes in all; none is cut, one that is
    longer alone is passed over. Read by one job."""
    known = pick(labels, "doc_id", "toxic").filter("toxic is not null and doc_id is not null") \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")) \
        .filter(F.col("toxic").isin(0, 1) & (crc32_text(F.col("doc_id")) % 5 != 0))
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class ids
    rows = pick(docs, "doc_id", "text").join(chosen, "doc_id").select("doc_id", "toxic", prepared(F.col("text")).alias("t"))
    # One text an id, so at most 2 * per_class rows reach the window.
    rows = rows.filter(F.length("t") <= most).groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("upto", F.sum(F.length("t")).over(so_far)).filter(F.col("upto") <= most) \
        .select("doc_id", "toxic", "t").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    return found.column("t").to_pylist(), found.column("toxic").to_numpy().astype(np.int64)


def toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document and the ``carry`` columns."""
    texts, y = sample(docs, labels)
    if len(set(y.tolist())) == 2:
        values, bias = train(texts, y)
        values = values.astype(np.float32).astype(np.float64)
    else:
        values, bias = np.zeros(BUCKETS), -60.0
    extra = [c for c in dict.fromkeys(carry) if c != "doc_id"]
    rows = pick(docs, "doc_id", "text", *[c for c in extra if c != "text"])
    held = [f"v_{c}" for c in extra]
    rows = rows.select("doc_id", (crc32_text(F.col("doc_id")) % 5 == 0).alias("held_out"),
                       *[F.col(c).alias(f"v_{c}") for c in extra], prepared(F.col("text")).alias("t"))
    table, last = values.astype(np.float32), len(rows.columns) - 1

    def judge(batches):
        wide = table.astype(np.float64)
        for b in slices(batches, last):
            s = scores_of(b.column(last).to_pylist(), wide, bias)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(last)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[*b.schema.names[:last], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(judge, schema + ", score double, predicted int").select(
        "doc_id", "held_out", "score", "predicted", *[F.col(h).alias(h.removeprefix("v_")) for h in held])
