"""JSON / JSONL records with strict validation and stable positions.

Three dialects mirror the three single-process readers being replaced:

* ``train``: ``.json`` suffix or a leading ``[`` means one JSON array, else
  JSONL; line numbers count from the first non-blank line; bad JSON is
  reported before any non-object.
* ``infer``: same detection; JSONL lines are parsed and type-checked in order.
* ``api``: always JSONL; line numbers are physical lines.

One scan parses each line into a VARIANT column ``rec`` and writes all lines with the
ids their task gave them; every number (position, line, index after a filter) is an
id's distance from the first of its split plus what the splits before hold. Arrays are
cut into elements by ``arrays``. Nothing is coerced.
Lines split at ``\\n``, ``\\r`` and ``\\r\\n`` (so a raw U+2028 inside a string
survives a round trip); blank lines are skipped.

Output: ``ord`` (0-based position among records), ``line`` (dialect line
number, NULL for arrays), ``rec`` and, with ``on_error="report"``, ``_error``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..functions import variant as V
from ..functions.text import WHITESPACE, is_nonblank
from ..session import checkpoint_root
from .arrays import array_records
from .ordinals import maybe_broadcast
from .rows import BAD_JSON, BAD_UTF8, NOT_LIST, NOT_OBJECT, LayoutError, numbered, prefix_sums, raw_text, stored, with_record

_SAYS = {
    BAD_JSON: "does not parse as one JSON value",
    NOT_OBJECT: "an object is needed here",
    BAD_UTF8: "bytes that no UTF-8 text has",
    NOT_LIST: "a .json file holds one array of objects",
}

DIALECTS = ("train", "infer", "api")


class RecordError(ValueError):
    """A bad input record; ``code``, ``ord`` and ``line`` locate it."""

    def __init__(self, message: str, code: str, ord: int | None = None, line: int | None = None):
        super().__init__(message)
        self.code, self.ord, self.line = code, ord, line


def _empty_message(dialect: str, path: str) -> str:
    return f"{path}: no records ({dialect} reader)"


def _files(spark: SparkSession, path: str, dialect: str) -> list[str]:
    try:
        return sorted(spark.read.text(path).inputFiles())
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"{path}: nothing to read there ({dialect} reader)") from exc
        raise


HEAD_BYTES = 4096  # of a file's head that the driver reads before it asks Spark


def _first_char(spark: SparkSession, file: str) -> str | None:
    """First non-whitespace character of a file, reading only its head."""
    strip = WHITESPACE + "\ufeff"
    jvm = spark.sparkContext._jvm
    # The scan lists its files URL-encoded: only a URI gives the path back.
    hpath = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)) if ":" in file else jvm.org.apache.hadoop.fs.Path(file)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    stream = hpath.getFileSystem(conf).open(hpath)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(hpath)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        head = bytearray()
        while len(head) < HEAD_BYTES:
            b = stream.read()
            if b >= 0:
                head.append(b)
            # Check at character boundaries (an incomplete last character
            # is dropped by the decoder) and at the end of the file.
            if b < 0x80 or b >= 0xC0:
                text = bytes(head).decode("utf-8", errors="ignore").lstrip(strip)
                if text:
                    return text[0]
            if b < 0:
                return None
    finally:
        stream.close()
    lines = spark.read.text(hpath.toString()).select(
        "value", F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    row = lines.where(is_nonblank(F.col("value"))).orderBy("b", "m").limit(1).collect()
    return row[0]["value"].strip(strip)[:1] if row else None


def detect_format(spark: SparkSession, path: str, dialect: str = "train", files: list[str] | None = None) -> str:
    """``"array"`` or ``"jsonl"``: ``.json`` suffix or a leading ``[`` means array."""
    if dialect == "api":
        return "jsonl"
    if path.rstrip("/").lower().endswith(".json"):
        return "array"
    files = _files(spark, path, dialect) if files is None else files
    if not files:
        return "jsonl"
    # The first file that holds anything decides.
    first = next((c for c in (_first_char(spark, f) for f in files) if c is not None), None)
    return "array" if first == "[" else "jsonl"


def _line_table(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mid"),
    ).withColumn("_keep", is_nonblank(F.col("value")))


def _line_rows(spark: SparkSession, path: str, select, raw: bool) -> DataFrame:
    """Every line, blank ones as empty rows, parsed and written by one scan with the ids
    its task gave it. All numbers follow from this table, whatever splits later scans use."""
    keep = F.col("_keep")
    err = (F.when(~F.is_valid_utf8(F.col("value")), F.lit(BAD_UTF8))
           .when(F.col("rec").isNull(), F.lit(BAD_JSON))
           .when(~V.is_object(F.col("rec")), F.lit(NOT_OBJECT)))
    rows = with_record(_line_table(spark, path), F.col("value"), keep).withColumn("_error", F.when(keep, err))
    chosen = keep & F.col("_error").isNull() & F.coalesce(select(F.col("rec")), F.lit(False)) if select is not None else F.lit(False)
    rows = rows.withColumn("_sel", chosen).select(
        "_file", "_block", "_mid", numbered(keep).alias("_kmid"), numbered(F.col("_sel")).alias("_smid"), "rec", "_error",
        (raw_text(F.col("value")) if raw else F.lit(None).cast("string")).alias("raw"))
    return stored(rows, "records")


def _offsets(rows: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """Per split: first ids and the numbers of lines, records and chosen records before
    it; and totals. Reads three narrow columns of the written rows."""
    gaps = [F.max(c) - F.min(c) + 1 != F.count(c) for c in ("_mid", "_kmid", "_smid")]
    blocks = stored(rows.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_mid0"), F.count("_mid").alias("lines"), F.min("_kmid").alias("_kmid0"),
        F.count("_kmid").alias("kept"), F.min("_smid").alias("_smid0"), F.count("_smid").alias("chosen"),
        F.min(F.when(F.col("_kmid").isNotNull(), F.col("_mid"))).alias("_first"),
        F.greatest(*[F.coalesce(g, F.lit(False)) for g in gaps]).alias("broken")), "splits")
    n = blocks.count()
    offsets = prefix_sums(blocks, ["_file", "_block"], ["lines", "kept", "chosen"], n)
    held = F.col("_first").isNotNull()
    told = offsets.agg(
        F.count_if("broken").alias("broken"), F.sum("kept").alias("kept"), F.sum("chosen").alias("chosen"),
        F.min_by(F.col("lines_before") + F.col("_first") - F.col("_mid0") + 1, F.when(held, F.struct("_file", "_block"))).alias("first")).first()
    if told["broken"]:
        raise LayoutError(f"the rows of {path} were not numbered in their order")
    return offsets.drop("lines", "kept", "chosen", "_first", "broken"), {**told.asDict(), "n": n}


def _jsonl(spark: SparkSession, path: str, dialect: str, select=None, raw: bool = True):
    checkpoint_root(spark)
    rows = _line_rows(spark, path, select, raw)
    offsets, told = _offsets(rows, path)
    j = rows.where("_kmid is not null").join(maybe_broadcast(offsets, told["n"]), ["_file", "_block"])
    line = F.col("lines_before") + F.col("_mid") - F.col("_mid0") + 1
    if dialect != "api" and told["first"] is not None:
        line = line - F.lit(told["first"]) + 1
    out = j.withColumns({"ord": F.col("kept_before") + F.col("_kmid") - F.col("_kmid0"), "line": line,
                         "idx": F.col("chosen_before") + F.col("_smid") - F.col("_smid0")})
    records = out.select("ord", "line", "rec", "_error", "raw")
    return records, None if select is None else out.where("idx is not null").select("ord", "idx", "line", "rec")


def check_columns(err: str = "_error", ord_col: str = "ord") -> list:
    """Aggregates that locate the first bad record of each kind, plus the record count."""
    e, o = F.col(err), F.col(ord_col)
    return [
        F.min(F.when(e == BAD_UTF8, o)).alias("_c_utf8"),
        F.min(F.when(e.isin(BAD_JSON, NOT_LIST), o)).alias("_c_json"),
        F.min(F.when(e == NOT_OBJECT, o)).alias("_c_obj"),
        F.count(F.lit(1)).alias("_c_n"),
    ]


def raise_from_stats(stats, df: DataFrame, path: str, dialect: str, fmt: str, err: str = "_error") -> None:
    """Raise the error the single-process reader would have raised first, if any."""
    if stats["_c_utf8"] is not None:
        first = stats["_c_utf8"]
    elif dialect == "train" and fmt == "jsonl":
        # Every line is parsed before any type check: parse errors win.
        first = stats["_c_json"] if stats["_c_json"] is not None else stats["_c_obj"]
    else:
        cands = [x for x in (stats["_c_json"], stats["_c_obj"]) if x is not None]
        first = min(cands) if cands else None
    if first is None:
        if not stats["_c_n"]:
            raise ValueError(_empty_message(dialect, path))
        return
    r = df.where(F.col("ord") == first).where(F.col(err).isNotNull()).select("ord", "line", err).limit(1).collect()[0]
    code, ord_, line = r[err], r["ord"], r["line"]
    place = f"line {line}" if line is not None and not (code == NOT_OBJECT and dialect == "train") else f"record {ord_}"
    if code == NOT_LIST or (fmt == "array" and code in (BAD_JSON, BAD_UTF8)):
        place = "file"
    msg = f"{path}: {place}: {code} ({_SAYS[code]})"
    raise RecordError(msg, code, ord_, line)


def scan_records(spark: SparkSession, path: str, dialect: str = "train", fmt: str = "auto", select=None, raw: bool = True):
    """``(records with _error and raw, resolved format, selected)`` lazily; no validation
    action. ``raw`` is the text of records whose integers a VARIANT may not hold; callers
    that do not write records back leave it out (the column is NULL then).

    With ``select`` (a function ``rec -> boolean Column``), ``selected`` holds the
    valid object records it accepts with ``idx``, their dense position among
    themselves.
    """
    if dialect not in DIALECTS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # last key wins, as in Python
    files = _files(spark, path, dialect)
    if fmt == "auto":
        fmt = detect_format(spark, path, dialect, files)
    if fmt not in ("array", "jsonl"):
        raise ValueError("fmt must be 'auto', 'array' or 'jsonl'")
    if not files:
        raise ValueError(_empty_message(dialect, path))
    if fmt == "array":
        df, sel = array_records(spark, path, select, raw)
    else:
        df, sel = _jsonl(spark, path, dialect, select, raw)
    return df, fmt, sel


def read_records(spark: SparkSession, path: str, dialect: str = "train", on_error: str = "fail",
                 fmt: str = "auto") -> DataFrame:
    """Read JSON-array or JSONL records (see module doc).

    ``on_error="fail"`` runs one aggregate job and raises ``RecordError`` for
    the first bad record, in the order the single-process reader would have
    found it; ``"report"`` returns every record with an ``_error`` column.
    """
    if on_error not in ("fail", "report"):
        raise ValueError("on_error must be 'fail' or 'report'")
    df, fmt, _ = scan_records(spark, path, dialect, fmt, raw=False)
    df = df.drop("raw")
    if on_error == "report":
        return df
    raise_from_stats(df.agg(*check_columns()).collect()[0], df, path, dialect, fmt)
    return df.drop("_error")
