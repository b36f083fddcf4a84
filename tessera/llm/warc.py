"""WARC archives: a writer and a splittable reader.

Writing. Every record is one gzip member; members follow each other in the part
files of a text sink, so any store Spark can write to will do. The sink puts a
separator after each row; a member whose last byte is the separator (the high
byte of the gzip size field, zero below 16 MiB) is written without it, so the
file is exactly the members in a row. A larger member is followed by an empty
one, which ends in that byte.

Reading. A task scans the byte range of its split for the gzip magic (the text
source with the magic as separator does the scan and hands each task the
stretches that start in its range). A stretch is a candidate member: its header
is decoded, it is inflated, and it counts only if the stream ends with a right
checksum and the record headers parse. A stretch that stops early held a magic
by chance inside compressed bytes; the following stretches are added until the
member ends. What begins or ends a split in that state is passed on as a
fragment, and fragments of neighbouring splits of a file are joined up
afterwards (about one per 16 MiB of archive, each no longer than a member).

Payload rule: of pages with equal payloads the smallest ``page_id`` is a
``response``, the others are ``revisit`` records without payload that keep the
HTTP header (so its Content-Length) and name the response. Payloads under
``min_revisit_bytes`` are always responses.

Defined cases: null html is an empty payload; a null url is written as
``about:blank``; a null ``page_id`` sorts last and comes back as null; rows that
repeat the smallest id are all responses; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import itertools
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path
from .common import arrow_limits, merged, pick, written

MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _page_uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(uri: str | None):
    tail = (uri or "").strip("<>").rpartition(":")[2]
    return None if tail in ("", "null") else int(tail)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "about:blank") if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_page_uri(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: {_page_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict | None:
    """Headers and block of one record; None if this is no WARC record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        return None
    block = rest[:int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    http_fields = {k.strip().lower(): v.strip() for k, _, v in
                   (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"fields": fields, "http": http_fields, "payload": body}


def member(data: bytes) -> bytes:
    """A gzip member as the sink takes it: without its last byte, a zero."""
    m = gzip.compress(data, 6, mtime=0)
    if m[-1]:
        m += gzip.compress(b"", 6, mtime=0)
    return m[:-1]


class Candidate:
    """A stretch that may be a gzip member, inflated as its bytes arrive."""

    def __init__(self, stretch: bytes):
        self.parts, self.out = [stretch], []
        head = MAGIC + stretch
        self.state = "bad" if len(head) > 3 and head[3] & 0xE0 else "more"
        self._inflater = zlib.decompressobj(31)
        self._feed(head)

    def _feed(self, data: bytes) -> None:
        if self.state != "more":
            return
        try:
            self.out.append(self._inflater.decompress(data))
        except zlib.error:
            self.state = "bad"
        else:
            self.state = "ok" if self._inflater.eof else "more"

    def extend(self, stretch: bytes) -> None:
        """The magic before ``stretch`` was compressed data: go on through it."""
        self.parts.append(stretch)
        self._feed(MAGIC + stretch)

    def data(self) -> bytes:
        return b"".join(self.out)


def members_of(stretches, at_head: bool):
    """Put the stretches of one split together to members: yields ``("member",
    inflated bytes)``; ``("head", stretch)`` for stretches before the first
    member when the split begins inside a file; ``("tail", stretch)`` for each
    part of a member that the split's end cuts off. Other bytes are skipped."""
    held = None
    for s in stretches:
        if held is not None:
            held.extend(s)
            if held.state == "ok":
                yield "member", held.data()
                at_head, held = False, None
                continue
            if held.state == "more":
                continue
            if at_head:
                yield from (("head", x) for x in held.parts[:-1])
            held = None
        c = Candidate(s)
        if c.state == "ok":
            yield "member", c.data()
            at_head = False
        elif c.state == "more":
            held = c
        elif at_head:
            yield "head", s
    if held is not None:
        yield from (("tail", x) for x in held.parts)


def write_archives(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0) -> str:
    """Write the pages as archives below ``path`` (default: a new folder in the
    shared work folder) and return it."""
    spark = pages.sparkSession
    checkpoint_root(spark)
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    # Equal payloads are those of one SHA-256: payloads that share a SHA-1 alone can be made.
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("same", F.unhex(F.sha2("payload", 256)))
    first = rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).filter("n > 1").drop("n")
    typed = rows.join(merged(first), "same", "left").withColumn(
        "revisit", (F.length("payload") >= min_revisit_bytes) & F.col("first_id").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first_id")))

    def members(batches):
        for b in batches:
            out = []
            for pid, url, payload, sha, first_id, revisit in zip(*(b.column(i).to_pylist() for i in range(6))):
                digest = base64.b32encode(sha).decode("ascii")
                out.append(member(record_bytes(pid, url, payload, digest, first_id, bool(revisit))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    path = path or scratch_path(spark, "warc")
    records = typed.select("page_id", "url", "payload", "sha", "first_id", "revisit").mapInArrow(members, "value binary") \
        .select(F.col("value").cast("string").alias("value"))
    with arrow_limits(spark):
        records.write.option("lineSep", "\0").text(path)
    return path


RECORD = {"page_id": ("long", pa.int64()), "url": ("string", pa.string()), "record_type": ("string", pa.string()),
          "payload_digest": ("string", pa.string()), "refers_to": ("long", pa.int64()),
          "payload_bytes": ("long", pa.int64()), "payload": ("binary", pa.binary())}
PARTS = {"file": ("string", pa.string()), "start": ("long", pa.int64()), "seq": ("long", pa.int64()),
         "kind": ("string", pa.string()), "stretch": ("binary", pa.binary()), **RECORD}


def _schema(fields: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, _) in fields.items())


def _batches(rows, fields: dict, size: int = 200):
    """Arrow batches of at most ``size`` rows from an iterator of tuples."""
    rows = iter(rows)
    while True:
        part = list(itertools.islice(rows, size))
        if not part:
            return
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, (_, t) in enumerate(fields.values())],
                                         names=list(fields))


def _record(raw: bytes, payloads: bool) -> tuple | None:
    rec = parse_record(raw)
    if rec is None or rec["fields"].get("warc-type") not in ("response", "revisit"):
        return None
    f = rec["fields"]
    revisit = f["warc-type"] == "revisit"
    size = int(rec["http"].get("content-length", 0)) if revisit else len(rec["payload"])
    return (_page_of(f.get("warc-record-id")), f.get("warc-target-uri"), f["warc-type"],
            f.get("warc-payload-digest", "").removeprefix("sha1:"), _page_of(f.get("warc-refers-to")), size,
            rec["payload"] if payloads and not revisit else None)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All response and revisit records below ``path``:
    ``page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload``."""
    stretches = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path) \
        .select(F.col("value").cast("binary").alias("stretch"), F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"))

    def scan_rows(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        for (file, start), split in itertools.groupby(rows, key=lambda r: r[1:]):  # a task may hold several splits
            # The text source yields what stands before a file's first magic as one empty row.
            found = members_of((s for s, *_ in split if s), at_head=start > 0)
            for seq, (kind, data) in enumerate(found):
                if kind != "member":
                    yield (file, start, seq, kind, data, *[None] * len(RECORD))
                elif (row := _record(data, payloads)) is not None:
                    yield (file, start, seq, kind, None, *row)

    def stitch_rows(batches):
        """In file order: the tails of a split and the heads of those after it."""
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        for _, run in itertools.groupby(rows, key=lambda r: r[0]):
            for kind, data in members_of((r[4] for r in run), at_head=False):
                if kind == "member" and (row := _record(data, payloads)) is not None:
                    yield row

    with arrow_limits(spark):
        parts = written(stretches.select("stretch", "file", "start").mapInArrow(
            lambda batches: _batches(scan_rows(batches), PARTS), _schema(PARTS)), "warc-members")
    whole = parts.filter("kind = 'member'").select(*RECORD)
    fragments = parts.filter("kind <> 'member'").select("file", "start", "seq", "kind", "stretch") \
        .repartition("file").sortWithinPartitions("file", "start", "seq")
    return whole.unionByName(fragments.mapInArrow(lambda batches: _batches(stitch_rows(batches), RECORD),
                                                  _schema(RECORD)))
