"""Spelling variants by a bidirectional FM-index and search schemes.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. With one error, one half of the word is free of it: the search matches
that half exactly and extends across the other half allowing one error.

The index of a set of words is made of two FM-indexes, one over the words and one
over the reversed words, each word between delimiters. Extending a match by a symbol
on the left or on the right is one step in the index of that direction: an interval
of suffix ranks maps to another by counting the symbol in the Burrows-Wheeler
transform, here one binary search for each bound over the (symbol, rank) pairs. A
match begins at a delimiter, on the side of its exact half, and ends with the other
delimiter, whose rank is the word's number. All words of a task are searched
together, an array of intervals per step.

Insertions and replacements are searched from the shorter or equal word; each link is
reported for both of its words.

The vocabulary is spread by the exact half: a word goes to the key (length of the
searching word, the half) of either half, and to those of the words one shorter that
it may lengthen. Keys are hashed to buckets of about ``BUCKET`` entries, and a bucket
is one index. Where more than ``BUCKET`` entries share a key, the key grows: the zone
of the error is halved again and either half of it joins the exact part, until keys
are small or the zone is one code point, which at most two alphabets of words share.
So no index holds an unbounded group and no pairs of a group are listed: only links
leave a bucket.

Defined cases: null and empty texts have no words; a null ``doc_id`` counts as empty
text in the digest; rows that repeat count as often as they stand; an empty table
gives an empty result; other columns are ignored; runs of any length are words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import merged, pick, written

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5          # a form is this many times as frequent
BUCKET = 20_000    # entries of one index, on average; a larger key is split
WIDE = 64          # intervals up to this width are read, wider ones probed symbol by symbol


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of whole texts and how often they occur."""
    upper, lower = ("".join(map(chr, range(a, a + 26))) for a in (65, 97))
    rows = pick(docs, "doc_id", "text")
    runs = rows.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), upper, lower),
                                       F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .filter(F.col("n") >= LEAST_COUNT)


class FMIndex:
    """Backward search over delimited words: ``$w0$w1$...$``, words sorted.

    Suffixes that begin with a delimiter rank first and in the words' order, so the
    rank of the delimiter before a word is the word's number."""

    def __init__(self, words: list[np.ndarray], order: np.ndarray):
        """``words``: arrays of symbols from 1; ``order``: their numbers when sorted."""
        self.order = order
        n = len(words)
        sizes = np.array([len(words[i]) for i in order], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])  # places of the delimiters
        text = np.zeros(int(begins[-1]) + 1, np.int64)
        letters = np.ones(len(text), bool)
        letters[begins] = False
        text[letters] = np.concatenate([words[i] for i in order]) if n else []
        self.n_words, self.size = n, len(text)
        self.n_symbols = int(text.max()) if n else 0
        # Prefix doubling; delimiters differ from each other, so a word's length is enough.
        rank = text + n
        rank[begins] = np.arange(n + 1)
        step = 1
        while True:
            after = np.zeros_like(rank)
            after[:-step] = rank[step:] + 1
            both = rank * (int(after.max()) + 1) + after
            by = np.argsort(both, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(both[by]) != 0)])
            rank = np.empty_like(new)
            rank[by] = new
            if new[-1] == len(text) - 1:
                break
            step *= 2
        self.bwt = text[by - 1]
        self.bwt[0] = -1  # before the first delimiter there is nothing
        rows = np.flatnonzero(self.bwt >= 0)
        self.pairs = np.sort(self.bwt[rows] * (self.size + 1) + rows)

    def start(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all delimiters, ``n`` times."""
        return np.zeros(n, np.int64), np.full(n, self.n_words + 1, np.int64)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """The intervals of the matches with ``symbol`` before them."""
        base = symbol * (self.size + 1)
        more = symbol > 0
        return np.searchsorted(self.pairs, base + lo) + more, np.searchsorted(self.pairs, base + hi) + more

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which letters stand before some match of each interval: the intervals'
        numbers and the letters."""
        width = hi - lo
        few = np.flatnonzero(width <= WIDE)
        sizes = width[few]
        owner = np.repeat(few, sizes)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + lo[owner]
        found = np.unique(owner * (self.n_symbols + 1) + np.maximum(self.bwt[rows], 0))
        who, what = found // (self.n_symbols + 1), found % (self.n_symbols + 1)
        many = np.flatnonzero(width > WIDE)
        who = np.concatenate([who, np.repeat(many, self.n_symbols)])
        what = np.concatenate([what, np.tile(np.arange(1, self.n_symbols + 1), len(many))])
        return who[what > 0], what[what > 0]

    def one_error(self, queries: list[np.ndarray], exact: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that differ from a query by one letter more or one replaced within
        ``[exact, upto)`` of it; symbols are read in the order of extension, from the
        delimiter on. Returns numbers of queries and of words."""
        lengths = np.array([len(q) for q in queries], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.concatenate([*queries, [0]]) if len(queries) else np.zeros(1, np.int64)
        who = np.arange(len(queries))
        at = np.zeros(len(queries), np.int64)       # letters of the query that are used
        wrong = np.zeros(len(queries), bool)
        lo, hi = self.start(len(queries))
        found = []
        while len(who):
            nxt = np.where(at < lengths[who], flat[np.minimum(starts[who] + at, len(flat) - 1)], 0)
            # Errors: still none, and inside the zone (an insertion also at its end).
            can = np.flatnonzero(~wrong & (at >= exact[who]) & (at <= upto[who]))
            state, letter = self.symbols(lo[can], hi[can])
            state = can[state]
            e_lo, e_hi = self.extend(letter, lo[state], hi[state])
            inside, other = at[state] < upto[who[state]], letter != nxt[state]
            replaced = inside & other
            inserted = other | ~inside
            # The next letter of the query, or the delimiter once an error is there.
            go = np.flatnonzero((at < lengths[who]) & (wrong | (at < upto[who])) & (nxt > 0))
            g_lo, g_hi = self.extend(nxt[go], lo[go], hi[go])
            end = np.flatnonzero((at == lengths[who]) & wrong)
            d_lo, d_hi = self.extend(np.zeros(len(end), np.int64), lo[end], hi[end])
            hit = d_lo < d_hi
            found.append((who[end[hit]], d_lo[hit]))
            r, i = np.flatnonzero(replaced), np.flatnonzero(inserted)
            who, at, wrong, lo, hi = (np.concatenate(x) for x in (
                (who[go], who[state[r]], who[state[i]]),
                (at[go] + 1, at[state[r]] + 1, at[state[i]]),
                (wrong[go], np.ones(len(r), bool), np.ones(len(i), bool)),
                (g_lo, e_lo[r], e_lo[i]), (g_hi, e_hi[r], e_hi[i])))
            live = lo < hi
            who, at, wrong, lo, hi = who[live], at[live], wrong[live], lo[live], hi[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), self.order[np.concatenate([x for _, x in found])]


class BidirectionalIndex:
    """Right extensions in the index of the reversed words, left extensions in that of
    the words; a letter of a query that no word has is a symbol of its own."""

    def __init__(self, words: list[str]):
        self.words = words
        codes = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words]
        alphabet = np.unique(np.concatenate(codes))
        self.coded = [np.searchsorted(alphabet, c) + 1 for c in codes]
        straight = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        turned = [w[::-1] for w in words]
        back = np.array(sorted(range(len(words)), key=turned.__getitem__), np.int64)
        self.left = FMIndex(self.coded, straight)
        self.right = FMIndex([c[::-1] for c in self.coded], back)

    def near(self, query: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words ``query`` (numbers) whose first ``before`` and last ``after`` code
        points are exact: the near words that are as long or one longer. The search
        begins on the side of the longer exact part."""
        size = np.array([len(self.coded[q]) for q in query], np.int64)
        out = []
        for index, pick_, exact, upto in ((self.right, before >= after, before, size - after),
                                          (self.left, before < after, after, size - before)):
            of = np.flatnonzero(pick_)
            turn = 1 if index is self.right else -1
            who, word = index.one_error([self.coded[q][::turn] for q in query[of]], exact[of], upto[of])
            out.append((query[of[who]], word))
        return tuple(np.concatenate(x) for x in zip(*out))


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of each entry: what a searching word of ``size`` and the entry share."""
    tail = F.expr("right(word, after)")
    return rows.withColumn("key", F.concat_ws(":", "size", "before", "after",
                                              F.concat(F.expr("left(word, before)"), F.lit(":"), tail)))


def entries(words: DataFrame, bucket: int) -> list[DataFrame]:
    """``word, size, before, after, key``: a word under the keys it shares with near
    words, each key at most ``bucket`` entries or a zone of one code point."""
    n = F.length("word")
    rows = words.select("word", F.explode(F.array(n, n - 1)).alias("size")).filter("size >= 1")
    half = F.expr("size div 2")
    rows = rows.select("word", "size", F.explode(F.array(
        F.struct(half.alias("before"), F.lit(0).alias("after")),
        F.struct(F.lit(0).alias("before"), (F.col("size") - half).alias("after")))).alias("z")) \
        .select("word", "size", F.col("z.before").cast("int").alias("before"), F.col("z.after").cast("int").alias("after"))
    done, level = [], 0
    while True:
        rows = written(_keyed(rows), f"halves-{level}")
        large = rows.filter("size - before - after > 1").groupBy("key").count().filter(F.col("count") > bucket).select("key")
        large = written(large, f"large-halves-{level}")
        if large.isEmpty():
            return [*done, rows]
        done.append(rows.join(merged(large), "key", "left_anti"))
        half = F.expr("(size - before - after) div 2")
        rows = rows.join(merged(large), "key", "left_semi").select("word", "size", F.explode(F.array(
            F.struct((F.col("before") + half).alias("before"), F.col("after").alias("after")),
            F.struct(F.col("before").alias("before"), (F.col("size") - F.col("before") - half).alias("after")))).alias("z")) \
            .select("word", "size", F.col("z.before").cast("int").alias("before"), F.col("z.after").cast("int").alias("after"))
        level += 1


def _links(table: pa.Table) -> pa.Table:
    """The links of one bucket, each with both of its words."""
    names = table.column("word").unique().to_pylist()
    number = {w: i for i, w in enumerate(names)}
    index = BidirectionalIndex(names)
    word = np.array([number[w] for w in table.column("word").to_pylist()], np.int64)
    size, before, after = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "before", "after"))
    asks = np.array([len(names[w]) for w in word], np.int64) == size
    a, b = index.near(word[asks], before[asks], after[asks])
    longer = np.array([len(names[y]) > len(names[x]) for x, y in zip(a, b)], bool)
    # A replacement is found from both sides, an insertion only from the shorter word.
    pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b[longer], a[longer]], 1)]), axis=0)
    named = pa.array(names, pa.string())
    return pa.table({"word": named.take(pa.array(pairs[:, 0])), "near": named.take(pa.array(pairs[:, 1]))})


def links(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``word, near``: all pairs of near words, both ways, possibly repeated."""
    parts = entries(words, bucket)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    n_buckets = 1 + rows.count() // bucket
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n_buckets)))
    return rows.select("bucket", "word", "size", "before", "after").groupBy("bucket").applyInArrow(_links, "word string, near string")


def spelling_variants(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` per word of the vocabulary."""
    ship_package(docs.sparkSession)
    words = written(vocabulary(docs), "vocabulary")
    found = written(links(words, bucket), "spelling-links")
    known = merged(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    # A word has at most two alphabets per code point of near words, so none is hot.
    grouped = found.join(known, "near").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    top = -F.col("best.less")
    good = top >= RATIO * F.col("n")
    rows = words.join(merged(grouped), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("best.near")).alias("form"), F.when(good, top).alias("form_n"))
    rows = written(rows, "spelling-forms")
    roots = _roots(rows)
    return rows.join(merged(roots), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(rows: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form, by pointer doubling: counts grow
    at every step, so chains are short and have an end."""
    jump, level = written(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = merged(jump.select(F.col("word").alias("root"), F.col("root").alias("further")))
        level += 1
        nxt = written(jump.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{level}")
        jump = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            return jump
