"""JSON arrays of any size, cut into their elements by many tasks.

The file is scanned as the stretches between commas, so it splits at any size. Whether
a comma parts two elements depends on what came before it: inside a string or not, and
how deep. A split is therefore a transfer function over that state: the parity of its
quotes, and its change of depth for either state at its begin. Composed in file order
these give the state at every split's begin (first scan); the second scan starts from
it, ends an element at every comma of depth one outside strings, and writes the
elements. What lies across the border of two splits is put together afterwards, at
most two stretches a split, so no text is moved but that.

Every element is parsed by itself into a VARIANT; the file's brackets are checked on
its first and last stretch. All elements valid and the brackets there means that the
array is valid; else the file is one error and gives no records.

An escape never reaches across a comma in valid JSON, so it is no part of the state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..batches import arrow_limits
from ..functions import variant as V
from ..functions.text import is_nonblank, ustrip
from ..session import checkpoint_root, ship_package
from .ordinals import BROADCAST_ROWS, maybe_broadcast
from .rows import BAD_JSON, BAD_UTF8, NOT_LIST, NOT_OBJECT, LayoutError, numbered, parse_record, prefix_sums, raw_text, stored, sums_in_file, with_record

CUT_ROWS, CUT_BYTES = 10_000, 4 << 20  # of stretches that a task takes up at once, and about so many of elements that it gives
ATTEMPTS = 3     # scans before a layout that keeps changing is an error
LOOK_INTO = 100  # files without an array that are parsed whole to say what they are

_KIND = np.zeros(256, np.int8)
_KIND[[ord(c) for c in '"\\']] = 2, 3
_KIND[[ord(c) for c in "[{"]] = 1
_KIND[[ord(c) for c in "]}"]] = -1


def structure(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the quotes and brackets of stretches that lie one after the other, with
    ``ends`` their ends: the places, which are quotes, and the brackets' change of depth.
    Escaped characters are left out; a backslash escapes within its stretch only."""
    kind = _KIND[data]
    at = np.flatnonzero(kind)
    slash = at[kind[at] == 3]
    if len(slash):
        first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        lengths = np.diff(np.append(first, len(slash)))
        # A run of backslashes restarts at the begin of a stretch.
        after = slash[first] + lengths
        begin = np.concatenate([[0], ends])[np.searchsorted(ends, after - 1, side="right")]
        odd = (after - np.maximum(slash[first], begin)) % 2 == 1
        escaped = after[odd & (after < len(data))]
        escaped = escaped[~np.isin(escaped, ends)]
        keep = (kind[at] != 3) & ~np.isin(at, escaped)
        at = at[keep]
    return at, kind[at] == 2, np.where(kind[at] == 2, 0, kind[at]).astype(np.int64)


def _runs(batch: pa.RecordBatch):
    """The stretches of a batch, split by split: ``(key, first row, last row + 1)``."""
    fid, block = (batch.column(i).to_numpy() for i in (0, 1))
    cuts = np.flatnonzero((np.diff(fid) != 0) | (np.diff(block) != 0)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield (int(fid[lo]), int(block[lo])), int(lo), int(hi)


def _bytes(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the rows ``[lo, hi)`` and their ends."""
    part = column.slice(lo, hi - lo)
    offsets = np.frombuffer(part.buffers()[1], np.int64 if pa.types.is_large_binary(part.type) else np.int32)
    offsets = offsets[part.offset:part.offset + len(part) + 1].astype(np.int64)
    data = part.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets[1:] - offsets[0]


def _stretches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", ",").text(path).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("fid"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mid"), "value")


def _transfer(batches):
    """One row a split: rows, bytes, quote parity, depth changes from outside and inside."""
    state: dict = {}
    for b in batches:
        for key, lo, hi in _runs(b):
            data, ends = _bytes(b.column(2), lo, hi)
            _, quote, change = structure(data, ends)
            s = state.setdefault(key, [0, 0, 0, 0, 0, True])
            inside = (s[2] + np.cumsum(quote) - quote) & 1
            s[0] += hi - lo
            s[1] += len(data)
            s[2] = (s[2] + int(quote.sum())) & 1
            s[3] += int(change[inside == 0].sum())
            s[4] += int(change[inside == 1].sum())
            s[5] = s[5] and bool(pc.all(b.column(3).slice(lo, hi - lo)).as_py())
    rows = [(*k, *s) for k, s in state.items()]
    columns = list(zip(*rows)) or [()] * 8
    yield pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int64()) for c in columns[:7]], pa.array(columns[7], pa.bool_())],
        names=["fid", "block", "n", "size", "parity", "outside", "inside", "utf8"])


def _cut(batches):
    """Elements and border stretches of every split: ``k`` counts the element ends before
    a stretch, ``last`` marks the one after the last end, ``n`` the split's rows there."""
    key, text, k, depth, inside, n, out = None, [], 0, 0, 0, 0, []

    def batch():
        columns = list(zip(*out)) or [()] * 6
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()))],
            names=["fid", "block", "k", "last", "n", "text"])
        out.clear()
        return made

    for b in batches:
        for at, lo, hi in _runs(b):
            if at != key:
                if key is not None:
                    out.append((*key, k, True, n, b",".join(text) if text else None))
                key, text, k, n = at, [], 0, 0
                depth, inside = (int(b.column(i)[lo].as_py() or 0) for i in (3, 4))
            data, ends = _bytes(b.column(2), lo, hi)
            places, quote, change = structure(data, ends)
            within = (inside + np.cumsum(quote) - quote) & 1
            level = depth + np.concatenate([[0], np.cumsum(np.where(within == 0, change, 0))])
            odd = (inside + np.concatenate([[0], np.cumsum(quote)])) & 1
            upto = np.searchsorted(places, ends)
            values = b.column(2).slice(lo, hi - lo).to_pylist()
            begin = 0
            # A comma stands after every stretch, but for the file's last, which ends no element.
            for stop in np.flatnonzero((level[upto] == 1) & (odd[upto] == 0)).tolist():
                text += values[begin:stop + 1]
                out.append((*key, k, False, n + stop + 1, b",".join(text)))
                text, begin, k = [], stop + 1, k + 1
            text += values[begin:]
            depth, inside, n = int(level[-1]), int(odd[-1]), n + hi - lo
            if len(out) > 2000 or sum(len(x[5] or b"") for x in out) > CUT_BYTES:
                yield batch()
    if key is not None:
        out.append((*key, k, True, n, b",".join(text) if text else None))
    yield batch()


def _states(spark: SparkSession, path: str, files: DataFrame, n_files: int) -> tuple[DataFrame, int]:
    """First scan: the state at the begin of every split, in file order."""
    rows = _stretches(spark, path).select(
        "fid", "block", F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("utf8"))
    found = rows.mapInArrow(_transfer, "fid long, block long, n long, size long, parity long, outside long, inside long, utf8 boolean")
    with arrow_limits(spark, CUT_ROWS, CUT_BYTES):
        found = stored(found.join(maybe_broadcast(files.select("fid", "file"), n_files), "fid"), "array-splits")
    n = found.count()
    odd = sums_in_file(found, ["parity"]).withColumn("odd", F.col("parity_before") % 2)
    moved = odd.withColumn("change", F.when(F.col("odd") == 0, F.col("outside")).otherwise(F.col("inside")))
    return sums_in_file(moved.select("fid", "file", "block", "n", "size", "odd", "change", "utf8"), ["change"]), n


def _raw(text: Column, raw: bool) -> Column:
    return (raw_text(text) if raw else F.lit(None).cast("string")).alias("raw")


def _chosen(rec: Column, select) -> Column:
    if select is None:
        return F.lit(False)
    return F.coalesce(V.is_object(rec) & select(rec), F.lit(False))


def _elements(spark: SparkSession, path: str, states: DataFrame, n: int, select, raw: bool) -> DataFrame:
    """Second scan: whole elements parsed, border stretches as text, all written."""
    start = states.select("fid", "block", F.col("change_before").alias("depth"), "odd")
    rows = _stretches(spark, path)
    if n <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(start), ["fid", "block"], "left")  # keeps the order of the scan
    else:
        rows = rows.join(start, ["fid", "block"], "left").repartition("fid", "block").sortWithinPartitions("fid", "block", "mid")
    cut = rows.select("fid", "block", F.col("value").cast("binary").alias("value"), "depth", "odd").mapInArrow(
        _cut, "fid long, block long, k long, last boolean, n long, text binary")
    cut = cut.withColumn("text", F.col("text").cast("string")).withColumn("border", (F.col("k") == 0) | F.col("last"))
    parsed = with_record(cut, F.col("text"), ~F.col("border"))
    parsed = parsed.withColumn("chosen", ~F.col("border") & _chosen(F.col("rec"), select))
    with arrow_limits(spark, CUT_ROWS, CUT_BYTES):
        return stored(parsed.select("fid", "block", "k", "n", "border", F.when(F.col("border"), F.col("text")).alias("text"), "rec",
                                    _raw(F.col("text"), raw), numbered(F.col("chosen")).alias("_smid")), "array-elements")


def _scanned(spark: SparkSession, path: str, files: DataFrame, n_files: int, select, raw: bool) -> tuple[DataFrame, DataFrame, int]:
    """Both scans, again if they did not see the same splits: the elements and, per
    split, its element ends (``ends_before``) and chosen elements."""
    for _ in range(ATTEMPTS):
        states, n = _states(spark, path, files, n_files)
        rows = _elements(spark, path, states, n, select, raw)
        seen = rows.groupBy("fid", "block").agg(
            F.max("n").alias("seen"), F.max("k").alias("ends"), F.min("_smid").alias("_smid0"), F.count("_smid").alias("inner"),
            (F.max("_smid") - F.min("_smid") + 1 != F.count("_smid")).alias("gap"))
        both = states.drop("odd", "change", "change_before").join(seen, ["fid", "block"], "full_outer")
        splits = stored(sums_in_file(both, ["ends"]), "array-splits")
        if splits.where(~F.col("n").eqNullSafe(F.col("seen")) | F.coalesce("gap", F.lit(False))).isEmpty():
            return rows, splits.drop("seen", "gap"), n
    raise LayoutError(f"the splits of {path} changed in each of {ATTEMPTS} scans")


def _across(rows: DataFrame, splits: DataFrame, totals: DataFrame, n: int, n_files: int, select, raw: bool) -> DataFrame:
    """Elements that touch a split's border, put together from at most two stretches a
    split, with the file's brackets taken off: ``e`` is the element's place in its file."""
    parts = rows.where("border and text is not null").join(maybe_broadcast(splits.select("fid", "block", "ends_before"), n), ["fid", "block"])
    whole = parts.groupBy("fid", (F.col("ends_before") + F.col("k")).alias("e")).agg(
        F.min(F.struct("block", "k")).alias("at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), ",").alias("text"))
    whole = whole.join(maybe_broadcast(totals, n_files), "fid").select(
        "fid", "e", F.col("at.block").alias("block"), (F.col("at.k") == 0).alias("before"), (F.col("e") == 0).alias("first"),
        (F.col("e") == F.col("total")).alias("last"), ustrip(F.col("text")).alias("text"))
    no_head = F.col("first") & ~F.startswith("text", F.lit("["))
    body = F.when(F.col("first"), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    whole = whole.withColumns({"blank_file": F.col("first") & F.col("last") & (F.col("text") == ""), "no_head": no_head, "body": body})
    no_tail = F.col("last") & ~F.endswith("body", F.lit("]"))
    inner = F.when(F.col("last"), F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))
    whole = whole.withColumns({"no_tail": no_tail, "inner": inner})
    empty = F.col("first") & F.col("last") & ~F.col("no_head") & ~F.col("no_tail") & ~is_nonblank(F.col("inner"))
    whole = whole.withColumn("empty", F.col("blank_file") | empty).withColumn("rec", F.when(~F.col("empty"), parse_record(F.col("inner"))))
    bad = ~F.col("empty") & (F.col("no_head") | F.col("no_tail") | F.col("rec").isNull())
    return stored(whole.select("fid", "e", "block", "before", "last", "empty", "no_head", bad.alias("bad"), "rec",
                               _raw(F.col("inner"), raw), _chosen(F.col("rec"), select).alias("chosen")), "array-borders")


def _file_errors(spark: SparkSession, rows: DataFrame, across: DataFrame, totals: DataFrame) -> DataFrame:
    """Per file its error, if any, and its number of records."""
    inner = rows.where("not border").groupBy("fid").agg(F.count_if(F.col("rec").isNull()).alias("inner_bad"))
    ends = across.groupBy("fid").agg(F.max("bad").alias("bad"), F.max("last").alias("closed"), F.max("empty").alias("empty"),
                                     F.max(F.col("no_head") & ~F.col("empty")).alias("no_head"))
    told = totals.join(inner, "fid", "left").join(ends, "fid", "left")
    # A comma at the very end leaves no stretch behind: one byte more than the stretches have.
    more = F.col("length") - F.col("size") - F.col("n") + 1
    loose = more.isin(1, 4) & ~F.col("file").rlike(r"(?i)\\.(gz|bz2|zst|lz4|snappy|deflate)$")
    bad = F.coalesce("bad", F.lit(False)) | ~F.coalesce("closed", F.lit(False)) | (F.coalesce("inner_bad", F.lit(0)) > 0) | loose
    told = stored(told.select("fid", "file", "total", F.coalesce("empty", F.lit(False)).alias("empty"), "no_head", F.when(
        ~F.col("utf8"), F.lit(BAD_UTF8)).when(F.col("n") == 0, F.lit(None)).when(bad, F.lit(BAD_JSON)).alias("error")), "array-files")
    if told.where((F.col("error") == BAD_JSON) & F.col("no_head")).isEmpty():
        return told
    # No array at all: told apart from broken JSON by parsing the whole file.
    names = [r["file"] for r in told.where((F.col("error") == BAD_JSON) & F.col("no_head")).select("file").limit(LOOK_INTO).collect()]
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in names]
    valid = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"),
                                                          parse_record(F.col("value")).isNotNull().alias("valid"))
    return told.join(valid, "file", "left").withColumn("error", F.when(F.col("valid"), F.lit(NOT_LIST)).otherwise(F.col("error"))).drop("valid")


def array_records(spark: SparkSession, path: str, select=None, raw: bool = True):
    """``(ord, line, rec, _error, raw)`` of all elements and, with ``select``, the chosen ones
    with ``idx``; a bad file is one row with ``ord`` -1 and gives no elements."""
    checkpoint_root(spark)
    ship_package(spark)
    files = stored(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), "length")
                   .withColumn("fid", F.xxhash64("file")), "array-files")
    n_files, n_digests = files.agg(F.count(F.lit(1)), F.count_distinct("fid")).first()
    if n_files != n_digests:
        raise ValueError(f"{path}: two files have one digest; read them apart")
    rows, splits, n = _scanned(spark, path, files, n_files, select, raw)
    totals = files.join(splits.groupBy("fid").agg(
        F.sum("ends").alias("total"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("utf8").alias("utf8")), "fid", "left")
    totals = totals.fillna(0, ["total", "n", "size"]).fillna(True, ["utf8"])
    across = _across(rows, splits, totals.select("fid", "total"), n, n_files, select, raw)
    told = _file_errors(spark, rows, across, totals)
    told = told.withColumn("records", F.when(F.col("error").isNotNull() | F.col("empty"), 0).otherwise(F.col("total") + 1))
    base = prefix_sums(told.select("fid", "file", "error", "records"), ["file"], ["records"], n_files)
    good = maybe_broadcast(base.where("error is null").select("fid", "records_before"), n_files)
    # Chosen elements in file order: one before a split's own, its own, one after them.
    picked = across.where("chosen").groupBy("fid", "block").agg(F.count_if("before").alias("head"), F.count_if(~F.col("before")).alias("tail"))
    blocks = splits.join(good, "fid").join(picked, ["fid", "block"], "left").fillna(0, ["head", "tail"])
    blocks = blocks.withColumn("chosen", F.col("head") + F.col("inner") + F.col("tail"))
    blocks = prefix_sums(blocks, ["file", "block"], ["chosen"], n)
    blocks = stored(blocks.select("fid", "block", "ends_before", "records_before", "chosen_before", "head", "inner", "_smid0"), "array-blocks")
    blocks = maybe_broadcast(blocks, n)
    before = F.col("chosen_before")
    own = rows.where("not border").join(blocks, ["fid", "block"]).select(
        (F.col("records_before") + F.col("ends_before") + F.col("k")).alias("ord"), "rec", "raw",
        (before + F.col("head") + F.col("_smid") - F.col("_smid0")).alias("idx"))
    border = across.where("not empty").join(blocks, ["fid", "block"]).select(
        (F.col("records_before") + F.col("e")).alias("ord"), "rec", "raw",
        F.when(F.col("chosen"), F.when(F.col("before"), before).otherwise(before + F.col("head") + F.col("inner"))).alias("idx"))
    both = own.unionByName(border).withColumn("line", F.lit(None).cast("bigint"))
    records = both.select("ord", "line", "rec", F.when(~V.is_object(F.col("rec")), F.lit(NOT_OBJECT)).alias("_error"), "raw")
    records = records.unionByName(base.where("error is not null").select(
        F.lit(-1).cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("line"),
        F.lit(None).cast("variant").alias("rec"), F.col("error").alias("_error"), F.lit(None).cast("string").alias("raw")))
    return records, None if select is None else both.where("idx is not null").select("ord", "idx", "line", "rec")
