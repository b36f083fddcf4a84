"""Document fingerprints: invertible Bloom lookup sketches of a text's passages.

A text becomes the set of the digests of its passages: lines and sentences, cut
every ``STRIDE`` bytes where they are longer. A sketch has cells of (count, xor
of digests, xor of check values); a digest sits in one cell of each of three
parts. Two sketches of a size subtract cell by cell, which removes all common
passages, and peeling recovers the digests of the others: a cell with count +1
or -1 and a fitting check holds one digest, which is taken out of its other
cells. Likeness is common / all distinct passages, from the numbers recovered.

``fingerprint`` is the number of passages and, in base64, a sketch sized by it: half
as many cells again, on a ladder of doubling sizes, and twice as many until all its
digests can be peeled from it alone. So a stored fingerprint can be made again in any
larger size, and the likeness of two comes from them alone (``alike``): equal sizes
subtract as they are, else the smaller is made again in the size of the larger; a
difference that can't be peeled is tried again twice as large, and a fingerprint that
can't be inverted is reported.

The edited text of the query needs each document's successor by ``doc_id``. Ids
are cut into ranges at approximate percentiles; the first document of each range
goes along with the range before it, so texts are shuffled once and each range
is read in order, a document and its successor at a time.

Defined cases: null text counts as empty; an empty text has no passage, and two
empty texts are alike (1.0); rows are ordered by id (null last), then text, so
repeated rows follow each other; a single document is its own successor; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import pick, slices

STRIDE = 64
CELLS = 18       # of the smallest sketch; divisible by three
RANGES_PER_PARTITION = 4

_CUT = re.compile(rb"(?<=[.!?]) |\n")
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("key", "<u8")])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def passages(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit digests of the passages."""
    found = set()
    for part in _CUT.split(text):
        if len(part) <= STRIDE:
            if part:
                found.add(xxhash.xxh3_64_intdigest(part))
        else:
            found.update(xxhash.xxh3_64_intdigest(part[i:i + STRIDE]) for i in range(0, len(part), STRIDE))
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    third = cells // 3
    return [(_mix(keys + s) % np.uint64(third)).astype(np.int64) + i * third for i, s in enumerate(_SEEDS[:3])]


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ _SEEDS[3]) >> np.uint64(32)).astype(np.uint32)


def sketches(sets: list[np.ndarray], cells: int) -> np.ndarray:
    """(sets x cells) array of sketches."""
    out = np.zeros(len(sets) * cells, _CELL)
    if sets and sum(map(len, sets)):
        keys = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * cells
        checks = _check(keys)
        for at in _places(keys, cells):
            np.add.at(out["count"], owner + at, 1)
            np.bitwise_xor.at(out["key"], owner + at, keys)
            np.bitwise_xor.at(out["check"], owner + at, checks)
    return out.reshape(len(sets), cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    out["count"] = a["count"] - b["count"]
    out["key"] = a["key"] ^ b["key"]
    out["check"] = a["check"] ^ b["check"]
    return out


def peel(diff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Peel many differences at once. Returns per row how many digests only the
    first side has, how many only the second has, whether everything peeled, and
    the list of (rows, digests, signs) recovered."""
    rows, cells = diff.shape
    flat = diff.reshape(-1).copy()
    more, less = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    recovered = []
    todo = np.flatnonzero(np.abs(flat["count"]) == 1)
    while len(todo):
        pure = todo[(np.abs(flat["count"][todo]) == 1) & (_check(flat["key"][todo]) == flat["check"][todo])]
        if not len(pure):
            break
        row, key, sign = pure // cells, flat["key"][pure], flat["count"][pure]
        # One digest may be alone in two cells of its row: take it out once.
        order = np.lexsort((key, row))
        row, key, sign = row[order], key[order], sign[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
        row, key, sign = row[new], key[new], sign[new]
        recovered.append((row, key, sign))
        np.add.at(more, row[sign > 0], 1)
        np.add.at(less, row[sign < 0], 1)
        checks, touched = _check(key), []
        for at in _places(key, cells):
            at = row * cells + at
            np.add.at(flat["count"], at, -sign)
            np.bitwise_xor.at(flat["key"], at, key)
            np.bitwise_xor.at(flat["check"], at, checks)
            touched.append(at)
        todo = np.unique(np.concatenate(touched))
    rest = flat.reshape(rows, cells)
    clean = ~((rest["count"] != 0) | (rest["key"] != 0) | (rest["check"] != 0)).any(axis=1)
    return more, less, clean, recovered


def ladder(n: int) -> int:
    """Cells for a sketch that ``n`` digests can be peeled from: half as many again, on a
    ladder of doubling sizes, so that texts of like length have sketches of one size."""
    cells = CELLS
    while 2 * cells < 3 * n:
        cells *= 2
    return cells


def _by_size(sizes: list[int]):
    """The numbers of the sketches of each size."""
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(np.asarray(sizes)[order])) + 1):
        if len(group):
            yield int(sizes[group[0]]), group


def invertible(sets: list[np.ndarray]) -> list[np.ndarray]:
    """A sketch of each set, from which all its digests can be peeled: where they can't
    be, the sketch is made again twice as large."""
    out: list = [None] * len(sets)
    sizes = [ladder(len(s)) for s in sets]
    todo = list(range(len(sets)))
    while todo:
        again = []
        for cells, group in _by_size([sizes[i] for i in todo]):
            which = [todo[g] for g in group]
            made = sketches([sets[i] for i in which], cells)
            more, less, clean, _ = peel(made)
            for i, sketch, good in zip(which, made, clean & (less == 0) & (more == [len(sets[i]) for i in which])):
                if good:
                    out[i] = sketch
                else:
                    sizes[i] *= 2
                    again.append(i)
        todo = again
    return out


def inverted(made: list[np.ndarray]) -> list:
    """The digests that each sketch holds, or None where they can't be peeled."""
    out: list = [None] * len(made)
    for cells, group in _by_size([len(m) for m in made]):
        _, less, clean, found = peel(np.stack([made[i] for i in group]))
        rows = np.concatenate([r for r, _, _ in found]) if found else np.zeros(0, np.int64)
        keys = np.concatenate([k for _, k, _ in found]) if found else np.zeros(0, np.uint64)
        order = np.argsort(rows, kind="stable")
        parts = np.split(keys[order], np.searchsorted(rows[order], np.arange(1, len(group))))
        for j, i in enumerate(group):
            if clean[j] and not less[j]:
                out[i] = parts[j]
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], a_sets: list | None = None, b_sets: list | None = None) -> np.ndarray:
    """Likeness of the sketches a[i] and b[i]: they are subtracted and the difference is
    peeled. A smaller sketch is first inverted and made again in the size of the other;
    where a difference can't be peeled both are, twice as large. NaN where a sketch can't
    be inverted. The digests, where they are known from inverting already, may be given."""
    a_sets = inverted(a) if a_sets is None else a_sets
    b_sets = inverted(b) if b_sets is None else b_sets
    out = np.full(len(a), np.nan)
    todo = np.array([i for i in range(len(a)) if a_sets[i] is not None and b_sets[i] is not None], np.int64)
    sizes = {int(i): max(len(a[i]), len(b[i])) for i in todo}

    def of_size(made, sets, which, cells):
        rows = np.zeros((len(which), cells), _CELL)
        other = []
        for j, i in enumerate(which):
            if len(made[i]) == cells:
                rows[j] = made[i]
            else:
                other.append(j)
        if other:
            rows[other] = sketches([sets[which[j]] for j in other], cells)
        return rows

    while len(todo):
        again = []
        for cells, group in _by_size([sizes[int(i)] for i in todo]):
            which = todo[group]
            more, less, clean, _ = peel(subtract(of_size(a, a_sets, which, cells), of_size(b, b_sets, which, cells)))
            every = np.array([len(a_sets[i]) for i in which]) + less
            out[which[clean]] = np.where(every == 0, 1.0, (every - less - more) / np.maximum(every, 1))[clean]
            for i in which[~clean]:
                sizes[int(i)] = cells * 2
                again.append(i)
        todo = np.array(again, np.int64)
    return out


def fingerprint(sketch: np.ndarray, n: int) -> str:
    return f"{n}:" + base64.b64encode(sketch.tobytes()).decode("ascii")


def alike(first: str, second: str) -> float | None:
    """Likeness of two stored fingerprints, from nothing but them; None if one is broken."""
    both = []
    for text in (first, second):
        n, _, data = text.partition(":")
        sketch = np.frombuffer(base64.b64decode(data), _CELL)
        found = inverted([sketch])[0] if len(sketch) and len(sketch) % 3 == 0 else None
        if found is None or str(len(found)) != n:
            return None
        both.append((sketch, found))
    (a, x), (b, y) = both
    return float(likeness([a], [b], [x], [y])[0])


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids, texts: list[str], successors: list[str], first_set, id_type) -> tuple:
    """The result rows of consecutive documents; returns the last successor's set too."""
    edited = []
    for t, s in zip(texts, successors):
        q = len(t) // 4
        edited.append((t[:len(t) - q] + s[:q]).encode("utf-8"))
    sets = [first_set if first_set is not None else passages(texts[0].encode("utf-8"))]
    # Each document's successor is mostly the next document of the list.
    next_sets = [passages(s.encode("utf-8")) for s in successors]
    for i in range(1, len(texts)):
        sets.append(next_sets[i - 1] if successors[i - 1] == texts[i] else passages(texts[i].encode("utf-8")))
    edited_sets = [passages(e) for e in edited]
    # Sketches from which the sets were peeled: the sets are what inverting them gives.
    own, changed = invertible(sets), invertible(edited_sets)
    following = [own[i + 1] if i + 1 < len(own) and next_sets[i] is sets[i + 1] else None for i in range(len(own))]
    odd = [i for i, f in enumerate(following) if f is None]
    for i, made in zip(odd, invertible([next_sets[i] for i in odd])):
        following[i] = made
    batch = pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
         pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
         pa.array([fingerprint(x, len(s)) for x, s in zip(own, sets)]),
         pa.array([fingerprint(x, len(s)) for x, s in zip(changed, edited_sets)]),
         pa.array(likeness(own, changed, sets, edited_sets)), pa.array(likeness(own, following, sets, next_sets))],
        names=["doc_id", *[x.split()[0] for x in RESULT.split(", ")]])
    return batch, next_sets[-1]


def ranges(docs: DataFrame) -> DataFrame:
    """``rng, extra, key, doc_id, text``: documents in id ranges, each range
    followed (``extra``) by the first document of the next one."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("key"))
    n = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), side="left").astype(np.int32))

    ranged = rows.withColumn("rng", range_of("key"))
    # One id per range: bounded by the number of ranges.
    firsts = {r["rng"]: r["k"] for r in ranged.groupBy("rng").agg(F.min("key").alias("k")).collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}  # the first one follows the last range
    heads = rows.filter(F.col("key").isin(list(before))).groupBy("key").agg(F.min("text").alias("text"))
    if before:
        pairs = F.create_map(*[x for k, r in before.items() for x in (F.lit(k), F.lit(r))])
        heads = heads.withColumn("rng", pairs[F.col("key")])
    else:
        heads = heads.withColumn("rng", F.lit(0))
    heads = heads.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", "key",
                         F.col("rng").cast("int").alias("rng"), F.lit(True).alias("extra"))
    both = ranged.select("doc_id", "text", "key", "rng", F.lit(False).alias("extra")).unionByName(heads)
    return both.repartition("rng").sortWithinPartitions("rng", "extra", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``RESULT`` for every document and its edited text."""
    ship_package(docs.sparkSession)
    rows = ranges(docs)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def compare(batches):
        last = None      # a document waiting for its successor
        known = None     # and its passages
        for b in slices(batches, 1):
            arrow = b.column(0).type
            ids, texts, extra = (b.column(i).to_pylist() for i in range(3))
            if last is not None:
                ids, texts, extra = [last[0], *ids], [last[1], *texts], [last[2], *extra]
            mine = [i for i in range(len(ids) - 1) if not extra[i]]
            for lo in range(0, len(mine), 1000):
                part = mine[lo:lo + 1000]
                use = known if part[0] == 0 and lo == 0 and last is not None else None
                out, after = _compared([ids[i] for i in part], [texts[i] for i in part], [texts[i + 1] for i in part],
                                       use, arrow)
                yield out
            known = after if mine and mine[-1] == len(ids) - 2 else None
            last = (ids[-1], texts[-1], extra[-1])
        # What waits at the end of a partition is the extra document of its last range.

    return rows.select("doc_id", "text", "extra").mapInArrow(compare, f"doc_id {id_type}, " + RESULT)
