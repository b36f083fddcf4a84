"""Vector code compression over per-dimension value dictionaries.

A vector's components become integers, ``floor(1024 * x)``, and its four equal parts
are each replaced by the number of the nearest entry of the part's codebook (256
entries). Codebooks come from integer Lloyd rounds, so every figure is exact.

Vectors are stored once as blocks of rows. In a block every dimension has a
dictionary of its distinct integers and two bytes a row that point into it. Each
round tabulates, for every distinct integer of a dimension, the squared differences
to that component of all entries; the distances of a part are then gathers of rows of
these tables, added over the part's dimensions. No difference is computed twice for
equal integers of a block.

A round reads the blocks and reduces them to sums: every task emits one row for each
part and entry, whatever it has read; one aggregation adds them up, and the driver
receives the new codebooks, at most ``PARTS * ENTRIES`` rows. The last assignment is
written with the labels, from which the sums by label are made; labels are joined by
a broadcast while there are at most ``BROADCAST_LABELS``, else by shuffle.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component
are dropped; with fewer than 256 kept vectors the codebooks have as many entries; equal
``vec_id``s are ordered by their integers, a null ``vec_id`` is kept and comes last;
null labels are one label; without kept vectors the result is empty. Vectors of
different lengths, of none, or of one that four does not divide, and components whose
squared distances do not fit 63 bits, are a ``ValueError`` that says so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import merged, pick, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096             # rows of a block; its codes are two bytes
BROADCAST_LABELS = 100_000


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, label``: the rows whose vectors are whole, as integers."""
    rows = pick(vectors, "vec_id", "embedding", "label")
    whole = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(whole).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"), "label")


def to_blocks(batch: pa.RecordBatch, dims: int):
    """Blocks of a batch ``vec_id, v, label``: per dimension the distinct integers and
    each row's place among them, dimension after dimension."""
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(batch.num_rows, dims)
    for lo in range(0, batch.num_rows, BLOCK):
        part = matrix[lo:lo + BLOCK]
        values, sizes, codes = [], [], []
        for d in range(dims):
            distinct, at = np.unique(part[:, d], return_inverse=True)
            values.append(distinct)
            sizes.append(len(distinct))
            codes.append(at.astype("<u2"))
        yield lo, len(part), np.concatenate(values), np.array(sizes, np.int32), np.concatenate(codes)


class Block:
    """A stored block; ``nearest`` finds each row's entry and its distance in a part."""

    def __init__(self, n: int, values: np.ndarray, sizes: np.ndarray, codes: bytes):
        ends = np.cumsum(sizes)
        self.n, self.dims = n, len(sizes)
        self.values = [values[e - s:e] for s, e in zip(sizes, ends)]
        self.codes = np.frombuffer(codes, "<u2").reshape(self.dims, n)

    def nearest(self, first: int, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the dimensions from ``first``: the numbers of the nearest entries (ties
        to the lower number) and the squared distances."""
        most = 0
        for d in range(entries.shape[1]):
            v, e = self.values[first + d], entries[:, d]
            most += max(int(v[-1]) - int(e.min()), int(e.max()) - int(v[0])) ** 2
        if most >= 1 << 63:
            raise ValueError("squared distances of these vectors do not fit 63 bits")
        kind = np.int32 if most < 1 << 31 else np.int64
        total = np.zeros((self.n, len(entries)), kind)
        for d in range(entries.shape[1]):
            table = (self.values[first + d][:, None] - entries[:, d]).astype(kind) ** 2
            total += table[self.codes[first + d]]
        at = total.argmin(1)
        return at, total[np.arange(self.n), at].astype(np.int64)

    def sums(self, first: int, width: int, at: np.ndarray, n_entries: int) -> np.ndarray:
        """Sums of the rows of each entry in every dimension of a part."""
        out = np.empty((n_entries, width), np.int64)
        order = np.argsort(at, kind="stable")
        used, cuts = np.unique(at[order], return_index=True)
        for d in range(width):
            column = self.values[first + d][self.codes[first + d][order]]
            out[:, d] = 0
            out[used, d] = np.add.reduceat(column, cuts)
        return out


_BLOCK = "n int, vec_id array<{}>, label array<{}>, values array<bigint>, sizes array<int>, codes binary"


def _read_blocks(batch: pa.RecordBatch):
    for i in range(batch.num_rows):
        yield i, Block(batch.column(0)[i].as_py(), batch.column(3)[i].values.to_numpy(), batch.column(4)[i].values.to_numpy(),
                       batch.column(5)[i].as_py())


def stored_blocks(kept: DataFrame, dims: int) -> DataFrame:
    types = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]

    def build(batches):
        for b in batches:
            for lo, n, values, sizes, codes in to_blocks(b, dims):
                one = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(c).slice(lo, n)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), *one, pa.array([values], pa.list_(pa.int64())),
                     pa.array([sizes], pa.list_(pa.int32())), pa.array([codes.tobytes()], pa.binary())],
                    names=["n", "vec_id", "label", "values", "sizes", "codes"])
    return written(kept.mapInArrow(build, _BLOCK.format(*types)), "vector-blocks")


def refined(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every part goes to its nearest entry, every used entry to the floor
    of its parts' mean."""
    k, width = books[0].shape

    def partial(batches):
        n, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, width), np.int64)
        for b in batches:
            for _, block in _read_blocks(b):
                for p, book in enumerate(books):
                    at, _ = block.nearest(p * width, book)
                    n[p] += np.bincount(at, minlength=k)
                    sums[p] += block.sums(p * width, width, at, k)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
             *[pa.array(sums[part, entry, d]) for d in range(width)]],
            names=["part", "entry", "n", *[f"s{d}" for d in range(width)]])

    schema = "part int, entry int, n long, " + ", ".join(f"s{d} long" for d in range(width))
    totals = blocks.mapInArrow(partial, schema).groupBy("part", "entry").agg(
        F.sum("n"), *[F.sum(f"s{d}") for d in range(width)]).collect()  # at most PARTS * ENTRIES rows
    out = [book.copy() for book in books]
    for part, entry, n, *sums in totals:
        out[part][entry] = [s // n for s in sums]
    return out


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per kept vector."""
    spark = vectors.sparkSession
    ship_package(spark)
    kept = kept_vectors(vectors)
    types = [kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    lengths = kept.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if lengths[0] is None:
        return spark.createDataFrame([], f"vec_id {types[0]}, code string, error long, label_error long, codebooks_sha256 string")
    if lengths[0] != lengths[1] or lengths[0] == 0 or lengths[0] % PARTS:
        raise ValueError(f"vectors have {lengths[0]} to {lengths[1]} components; one length that {PARTS} divides is needed")
    dims = lengths[0]
    width = dims // PARTS
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    start = np.array([r["v"] for r in seeds], np.int64)
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(PARTS)]
    blocks = stored_blocks(kept, dims)
    for _ in range(rounds):
        books = refined(blocks, books)
    digest = hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
    hexed = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def assign(batches):
        for b in batches:
            for i, block in _read_blocks(b):
                found = [block.nearest(p * width, book) for p, book in enumerate(books)]
                code = hexed[found[0][0]]
                for at, _ in found[1:]:
                    code = np.char.add(code, hexed[at])
                yield pa.RecordBatch.from_arrays(
                    [b.column(1)[i].values, b.column(2)[i].values, pa.array(code.tolist(), pa.string()),
                     pa.array(np.sum([e for _, e in found], axis=0))],
                    names=["vec_id", "label", "code", "error"])

    coded = written(blocks.mapInArrow(assign, f"vec_id {types[0]}, label {types[1]}, code string, error long"), "vector-codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else merged(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
