"""Near duplicates: SuperMinHash signatures, banding, verification on full
shingle sets, union-find grouping.

1. One pass over the texts makes each document's set of word shingles (64-bit
   hashes), its SuperMinHash signature and the keys of its bands. SuperMinHash
   gives element e at step j the value j + r for one slot, where the slots of an
   element's steps form a random permutation; a document stops as soon as all
   its slots hold values below the step, so long texts take one or two steps.
2. Documents with equal sets become one class (by a 128-bit digest of the full
   set); from here on only class representatives count.
3. Rows (band key, document) meet in buckets by an aggregation and a join, both
   of which split a hot key. Every member is paired with the center of its
   bucket (the member with most company over all its buckets), each pair once.
4. Pairs are verified on the full sets, rebuilt from the texts, and the links
   are grouped: union-find inside each partition, then rounds of large-star and
   small-star over the trees that are left.
5. Two members of a bucket can be linked although neither is linked with its
   center. The members of buckets that still hold several groups are therefore
   joined by an exact prefix filter on their full sets. Shingles are put in one
   order for all: those of a single group first, then the others, rarest first. Two
   linked sets of x and y shingles share at least a = 0.8 / 1.8 * (x + y), so their
   first common shingle stands among the first x - a + 1 of one and y - a + 1 of the
   other. Only rows (shingle, document) at such places are met, and only shingles
   that stand so early in two groups, in one of them for a partner of its size or
   longer. A passage that many unlike texts share stands behind their own shingles
   and makes no rows at all. A shingle's rows meet in blocks: its largest group is
   not met with itself. Pairs of different groups whose places and signatures allow
   a link are verified like the others.

With 28 bands of 5 rows a pair at exactly 0.8 shares no bucket with probability
1.5e-5 (at 0.85: 2e-7); the signature comparison of step 5 admits pairs down to
an estimate 4 standard deviations under 0.8 (missed with probability 3e-5).

Defined cases: null and empty texts have no shingles and are linked with
nothing; texts shorter than a shingle are one shingle; a null ``doc_id`` sorts
last; rows that repeat an id are rows of their own (``kept`` is true on one row
of each group); an empty table gives an empty result; other columns are ignored
unless carried.
"""

from __future__ import annotations

import itertools
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, merged, pick, slices, written

SHINGLE = 4         # words of a shingle, unless the caller asks for another width
BANDS, ROWS = 28, 5
SLOTS = BANDS * ROWS
PERCENT = 80        # links have 100 * intersection >= PERCENT * union
BLOCK = 512         # documents of a shingle that are compared with each other at once

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                   0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit word hashes, remembered up to a bounded number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes, words: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    w = text.translate(_LOWER).split()  # bytes.split() parts at space and \\t \\n \\v \\f \\r
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    n = max(len(h) - k + 1, 1)
    acc = np.full(n, np.uint64(min(len(h), k)), np.uint64)
    for i in range(min(k, len(h))):
        acc = mixed(acc * _ODD[i % len(_ODD)] + h[i:i + n])
    return np.unique(acc)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_sets x slots, uint64: step << 32 | rank) of sets given as
    concatenated element hashes; ``owner`` is each element's set number. Every
    set needs an element; at most 255 slots."""
    sig = np.full(n_sets * slots, np.iinfo(np.uint64).max, np.uint64)
    base = owner.astype(np.int64) * slots
    perm = rows = None
    for j in range(slots):
        x = mixed(elements + np.uint64((j + 1) * int(_ODD[0]) % 2**64))
        pick_at = j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = pick_at
        else:
            slot = perm[rows, pick_at].astype(np.int64)
            perm[rows, pick_at] = perm[:, j]
        np.minimum.at(sig, base + slot, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        # A set whose slots are all filled has its signature: later steps give larger values.
        open_sets = (sig.reshape(n_sets, slots) == np.iinfo(np.uint64).max).any(axis=1)
        left = open_sets[owner]
        if not left.any():
            break
        if perm is None:
            elements, owner, base, pick_at = elements[left], owner[left], base[left], pick_at[left]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
            rows = np.arange(len(elements))
            perm[rows, pick_at] = 0
        elif left.sum() < 0.7 * len(left):
            elements, owner, base, perm = elements[left], owner[left], base[left], perm[left]
            rows = np.arange(len(elements))
    return sig.reshape(n_sets, slots)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets x BANDS) int64 keys; the band's number is part of the key."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * _ODD[1] + parts[:, :, r])
    return key.view(np.int64)


def _chunks(sets: list[np.ndarray], limit: int = 150_000):
    """Runs of consecutive sets with at most ``limit`` elements (or one set)."""
    at, total = 0, 0
    for i, s in enumerate(sets):
        if i > at and total + len(s) > limit:
            yield at, i
            at, total = i, 0
        total += len(s)
    if at < len(sets):
        yield at, len(sets)


_SIGNED = "n_shingles long, set_hash binary, sig binary, bands array<long>, ztext binary"


def _sign(batches, width):
    words = WordHashes()
    for b in batches:
        texts = [t or b"" for t in b.column(b.num_columns - 1).to_pylist()]
        sets = [shingle_set(t, words, width) for t in texts]
        sigs, keys = [None] * len(sets), [None] * len(sets)
        full = [i for i, s in enumerate(sets) if len(s)]
        for lo, hi in _chunks([sets[i] for i in full]):
            part = [sets[i] for i in full[lo:hi]]
            owner = np.repeat(np.arange(len(part)), [len(s) for s in part])
            sig = super_minhash(np.concatenate(part), owner, len(part))
            bands = band_keys(sig)
            for i, s, k in zip(full[lo:hi], sig, bands):
                sigs[i], keys[i] = (s & np.uint64(0xFF)).astype(np.uint8).tobytes(), k
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        empty = np.empty(0, np.int64)
        offsets = np.zeros(len(sets) + 1, np.int32)
        np.cumsum([0 if k is None else BANDS for k in keys], out=offsets[1:])
        flat = np.concatenate([empty, *[k for k in keys if k is not None]])
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in range(b.num_columns - 1)] + [
                pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                pa.array([zlib.compress(t, 1) for t in texts], pa.binary())],
            names=[*b.schema.names[:-1], "n_shingles", "set_hash", "sig", "bands", "ztext"])


def _verify(batches, width):
    """Rows (a, b, za, zb) -> pairs that are links on their full sets."""
    words = WordHashes()

    @lru_cache(maxsize=64)
    def sets(z: bytes) -> np.ndarray:
        return shingle_set(zlib.decompress(z), words, width)

    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        linked = []
        for za, zb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = sets(za), sets(zb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        mask = pa.array(linked, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def _elements(batches, width):
    """Rows (uid, grp, n, ztext) -> a row for each shingle, at most 100,000 or one
    text's at once."""
    words = WordHashes()
    for batch in batches:
        sets = [shingle_set(zlib.decompress(z), words, width) for z in batch.column(3).to_pylist()]
        for lo, hi in _chunks(sets, 100_000):
            times = [len(s) for s in sets[lo:hi]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(i).slice(lo, hi - lo).to_numpy(), times)) for i in range(3)]
                + [pa.array(np.concatenate(sets[lo:hi]).view(np.int64))], names=["uid", "grp", "n", "el"])


def _likely_pairs(batches):
    """Rows sorted by (shingle, left block, right block, uid): members of a pair of
    blocks; yields pairs of different groups for which the places of the shingle allow
    that it is the first of enough in common, and whose signatures are close."""
    # 8-bit slots agree by chance once in 256 times; 4 standard deviations under 0.8.
    need = int(SLOTS * (0.8 - 4 * (0.8 * 0.2 / SLOTS) ** 0.5))

    def rows():
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(9)))

    def told():
        return pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    out_a, out_b = [], []
    for (_, left, right), run in itertools.groupby(rows(), key=lambda r: r[:3]):
        run = list(run)  # at most two blocks
        uid, group, size, place, block = (np.array([r[i] for r in run]) for i in (3, 4, 5, 6, 8))
        sig = np.frombuffer(b"".join(r[7] for r in run), np.uint8).reshape(len(run), SLOTS)
        last = size - place  # shingles from this one on
        for i in range(len(run)):
            later = np.arange(i + 1, len(run))
            both = PERCENT * (size[later] + size[i])
            later = later[(group[later] != group[i])
                          & ((block[later] != block[i]) if left != right else True)
                          & ((100 + PERCENT) * np.minimum(last[later], last[i]) >= both)]
            if len(later):
                near = later[(sig[later] == sig[i]).sum(axis=1) >= need]
                out_a += np.minimum(uid[near], uid[i]).tolist()
                out_b += np.maximum(uid[near], uid[i]).tolist()
        if len(out_a) > 10_000:
            yield told()
            out_a, out_b = [], []
    yield told()


def _forest(batches):
    """Union-find over the edges of one partition: each node with its root."""
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for lo in range(0, len(nodes), 50_000):
        part = nodes[lo:lo + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())],
                                         names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of ``edges (a, b)`` but the roots themselves:
    the root is the smallest node of the component."""
    tree = written(edges.select("a", "b").mapInArrow(_forest, "u long, v long"), "forest")
    before = None
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(merged(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(least), "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").filter("u <> v").distinct()
        tree = written(small, "stars")
        now = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return tree.select("u", F.col("v").alias("root"))
        before = now


def near_groups(docs: DataFrame, carry: tuple[str, ...] = (), width: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``, and
    ``class_id`` (smallest document with the same set), plus the ``carry`` columns.
    Shingles are ``width`` words."""
    with arrow_limits(docs.sparkSession):  # all steps that run Python are written here
        return _near_groups(docs, carry, width)


def _near_groups(docs: DataFrame, carry: tuple[str, ...], width: int) -> DataFrame:
    extra = [c for c in dict.fromkeys(carry) if c not in ("doc_id", "text")]
    src = pick(docs, "doc_id", "text", *extra)
    src = src.select("doc_id", *[F.col(c).alias(f"v_{c}") for c in extra],
                     F.col("text").isNull().alias("no_text"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", " + _SIGNED
    signed = written(src.mapInArrow(lambda batches: _sign(batches, width), schema).withColumn("uid", F.monotonically_increasing_id()), "signed")

    # Classes of equal sets.
    classes = signed.filter("n_shingles > 0").groupBy("n_shingles", "set_hash").agg(F.min("uid").alias("rep"))
    members = written(
        signed.filter("n_shingles > 0").select("uid", "n_shingles", "set_hash", "sig", "bands")
        .join(merged(classes), ["n_shingles", "set_hash"])
        .select("uid", "rep", F.when(F.col("uid") == F.col("rep"), F.col("n_shingles")).alias("n"),
                F.when(F.col("uid") == F.col("rep"), F.col("sig")).alias("sig"),
                F.when(F.col("uid") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    reps = members.filter("uid = rep")

    # Buckets of two and more; every member with the bucket's center, the member that
    # meets most others over all its buckets. In a group of edited copies that is
    # the text they were made from, which is nearer to each than they are to each other.
    rows = reps.select("uid", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = written(rows.join(merged(shared), "band"), "met")
    degrees = met.groupBy("uid").agg(F.sum("k").alias("degree"))
    ranked = met.join(merged(degrees), "uid")
    centers = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("uid")).alias("neg"))).alias("c")) \
        .select("band", (-F.col("c.neg")).alias("center"))
    buckets = written(met.join(merged(centers), "band"), "buckets")
    stars = buckets.filter("uid <> center").select("uid", "center").distinct()
    texts = signed.select("uid", "ztext").join(merged(buckets.select("uid").distinct()), "uid", "left_semi")
    texts = written(texts, "bucket-texts")
    links = written(_linked(stars.select(F.col("center").alias("a"), F.col("uid").alias("b")), texts, width), "rays")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = components(links)

    # Members of buckets that still hold several groups: an exact prefix filter on their sets.
    grouped = buckets.join(merged(roots.withColumnRenamed("u", "uid")), "uid", "left").select(
        "band", "uid", "n", F.coalesce("root", "uid").alias("grp"))
    several = grouped.groupBy("band").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo <> hi")
    open_rows = grouped.join(merged(several.select("band")), "band").select("uid", "grp", "n").distinct()
    elements = written(open_rows.join(merged(texts), "uid").select("uid", "grp", "n", "ztext").mapInArrow(
        lambda batches: _elements(batches, width), "uid long, grp long, n long, el long"), "elements")
    common = elements.groupBy("el").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count(F.lit(1)).alias("times")) \
        .filter("lo <> hi").select("el", "times")
    from_last = Window.partitionBy("uid").orderBy(F.col("times").desc(), F.col("el").desc())
    first = written(
        elements.join(merged(common), "el").withColumn("place", F.col("n") - F.row_number().over(from_last))
        .filter(100 * (F.col("n") - F.col("place")) >= PERCENT * F.col("n")).select("uid", "grp", "n", "el", "place"), "first-elements")
    # The smaller of a pair has the shingle so early that a partner of its own size can be linked.
    early = (100 + PERCENT) * (F.col("n") - F.col("place")) >= 2 * PERCENT * F.col("n")
    posts = first.groupBy("el", "grp").agg(F.count(F.lit(1)).alias("c"), F.max(early).alias("early")).groupBy("el").agg(
        F.max(F.struct("c", "grp")).alias("top"), F.sum("c").alias("k"), F.max("early").alias("early"))
    posts = posts.filter("early and k > top.c").select(
        "el", F.col("top.grp").alias("main"), F.ceil((F.col("k") - F.col("top.c")) / BLOCK).cast("int").alias("p"),
        F.ceil(F.col("top.c") / BLOCK).cast("int").alias("q"))
    met_rows = first.join(merged(posts), "el").join(merged(reps.select("uid", "sig")), "uid")
    # Blocks 0 to p - 1 hold the smaller groups and meet all, p to p + q - 1 the largest group.
    main = F.col("grp") == F.col("main")
    met_rows = met_rows.withColumn("blk", F.when(main, F.col("p") + F.pmod(F.xxhash64("uid"), F.col("q")))
                                   .otherwise(F.pmod(F.xxhash64("uid"), F.col("p"))).cast("int"))
    paired = met_rows.withColumn("other", F.explode(F.sequence(
        F.lit(0), F.when(main, F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1)))).select(
        "el", F.least("blk", "other").alias("lb"), F.greatest("blk", "other").alias("rb"), "uid", "grp", "n", "place", "sig", "blk")
    likely = paired.repartition("el", "lb", "rb").sortWithinPartitions("el", "lb", "rb", "uid") \
        .mapInArrow(_likely_pairs, "a long, b long").distinct()
    likely = written(likely, "likely")
    more = written(_linked(likely, texts, width), "more-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    # Class, component and the document that stays, for every row.
    ids = members.select("uid", "rep").join(
        merged(roots.select(F.col("u").alias("rep"), "root")), "rep", "left").select(
        "uid", "rep", F.coalesce("root", "rep").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    named = signed.select("uid", "doc_id").join(merged(ids), "uid")
    tops = named.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    class_tops = named.groupBy("rep").agg(F.min(order).alias("class_first"))
    told = ids.join(merged(tops), "root").join(merged(class_tops), "rep").select("uid", "first", "class_first", "size")
    full = signed.select("uid", "doc_id", "n_shingles", *[F.col(f"v_{c}") for c in extra],
                         *(["no_text", "ztext"] if "text" in carry else [])).join(merged(told), "uid", "left")
    alone = F.col("first").isNull()
    return full.select(
        "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | (F.col("first.uid") == F.col("uid"))).alias("kept"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_first.doc_id")).alias("class_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        *[F.col(f"v_{c}").alias(c) for c in extra], *([F.col("no_text"), F.col("ztext")] if "text" in carry else []))


def _linked(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets. Texts join twice over one
    shuffle; a hot ``a`` is split by AQE."""
    left = texts.select(F.col("uid").alias("a"), F.col("ztext").alias("za"))
    right = texts.select(F.col("uid").alias("b"), F.col("ztext").alias("zb"))
    return pairs.join(merged(right), "b").join(merged(left), "a").select("a", "b", "za", "zb").mapInArrow(
        lambda batches: _verify(batches, width), "a long, b long")


def unzipped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``near_groups(..., carry=("text", ...))`` with their texts again."""
    rest = [c for c in columns if c != "text"]
    fields = {f.name: f.dataType for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].simpleString()}" for c in rest) + ", text string"

    def unzip(batches):
        for b in slices(batches, len(rest) + 1):
            texts = [None if none else zlib.decompress(z).decode("utf-8")
                     for none, z in zip(b.column(len(rest)).to_pylist(), b.column(len(rest) + 1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(len(rest))] + [pa.array(texts, pa.string())], names=[*rest, "text"])

    return rows.select(*rest, "no_text", "ztext").mapInArrow(unzip, schema).select(*columns)
