"""The corpus operators applied to the test tables, with DuckDB SQL where SQL
can express the result."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes
from .exact import exact_groups
from .licenses import license_oracle, license_scan
from .lm import lm_scores
from .near import near_groups
from .online import pack_online
from .packing import pack
from .pieces import decode, tokenize
from .pii import KINDS, find_pii, span_text
from .sketch import fingerprints
from .spelling import LEAST_CHARS, LEAST_COUNT, RATIO, spelling_variants
from .toxicity import toxicity
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents")).drop("group_size")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents"))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
                        span_text(F.concat("base", "found")).alias("spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk: numbers and digests of its ids, and whether they decode to its text."""
    rows = decode(tokenize(_table(spark, sf_dir, "documents")))

    def digest(batches):
        for b in batches:
            ids, ends = b.column(0).flatten().to_numpy().astype("<u4"), b.column(0).offsets.to_numpy()
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([zlib.crc32(ids[a:z]) for a, z in zip(ends, ends[1:])], pa.int64()), *b.columns[1:]],
                names=["ids_crc32", *b.schema.names[1:]])

    told = rows.select("ids", "doc_id", "chunk", "n_chunks", "start", F.size("ids").cast("long").alias("n_tokens"),
                       F.length("text").cast("long").alias("n_chars"), (F.col("decoded") == F.col("text")).alias("round_trip"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return told.mapInArrow(digest, f"ids_crc32 long, doc_id {id_type}, chunk int, n_chunks int, start long, "
                                   "n_tokens long, n_chars long, round_trip boolean")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(_table(spark, sf_dir, "pages"))
    return read_archives(spark, path, payloads=False).drop("payload", "url")


def op11_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


_SQUEEZED = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')"

EXACT_SQL = f"""
WITH n AS (SELECT doc_id, {_SQUEEZED} AS norm, length(coalesce(text, '')) AS chars FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
c AS MATERIALIZED (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s)
                   WHERE len(sh) > 0 GROUP BY sh),
e AS MATERIALIZED (SELECT rep, n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS x, b.rep AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
      FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * shared >= 80 * (nx + ny - shared)),
b AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reach) AS (SELECT rep, rep FROM c UNION SELECT r.node, b.y FROM r JOIN b ON r.reach = b.x),
t AS (SELECT node, min(reach) AS top FROM r GROUP BY node),
m AS (SELECT s.doc_id, len(s.sh) AS n, c.rep, t.top FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN t ON t.node = c.rep)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(top, doc_id) AS component_id,
       coalesce(top, doc_id) = doc_id AS kept, coalesce(rep, doc_id) AS class_id FROM m"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hx, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hx, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d"""



def _codes_sql() -> str:
    """The rounds written out: parts against codebook entries by inner products of
    doubles, which are exact for integers of this size."""
    out = f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v,
         row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) AS v
  FROM k, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, v AS w FROM p WHERE r < {ENTRIES}),"""
    near = """
a{i} AS MATERIALIZED (
  SELECT r, p.p, any_value(v) AS v, min(struct_pack(
    d := list_inner_product(v, v) - 2 * list_inner_product(v, w) + list_inner_product(w, w), e := e)) AS best
  FROM p JOIN b{i} b ON p.p = b.p GROUP BY r, p.p),"""
    for i in range(ROUNDS):
        out += near.format(i=i) + f"""
m{i} AS (SELECT p, e, list(floor(s / n) ORDER BY j) AS w
  FROM (SELECT p, best.e AS e, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 100000) t(j) WHERE j <= len(v) GROUP BY ALL)
  GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e),"""
    return out + near.format(i=ROUNDS) + f"""
c AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM k JOIN c ON k.r = c.r, h"""


CODES_SQL = _codes_sql()

_BYTES = ("flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
          "ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END))")
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, " + _BYTES + "), lambda a, b: xor(a >> 8, list_reduce("
        "list_prepend(xor(a, b) & 255, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))), 4294967295)")

SPELLING_SQL = f"""
WITH RECURSIVE u AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
g AS (SELECT doc_id, run, count(*) AS times FROM u GROUP BY ALL),
c AS (SELECT run, times, {_CRC.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM g),
w AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word FROM c)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
d AS MATERIALIZED (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM w, range(1, 100000) t(i) WHERE i <= length(word)),
l AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
s AS (SELECT l.a AS word, count(*) AS n_near, arg_max(w.word, (w.n, l.rank)) AS best, max(w.n) AS top
      FROM (SELECT a, b, -row_number() OVER (ORDER BY b) AS rank FROM l) l JOIN w ON l.b = w.word GROUP BY l.a),
f AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * w.n THEN best END AS form,
         CASE WHEN top >= {RATIO} * w.n THEN top END AS form_n FROM w LEFT JOIN s ON w.word = s.word),
r(word, root, step) AS (
  SELECT word, word, 0 FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n
FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) t ON f.word = t.word"""

QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_exact_dedup, op3_near_dedup, op4_pii, op5_packing, op6_lm_scores, op7_fingerprints,
    op8_toxicity, op9_pieces, op10_warc, op11_online_packing, op12_vector_codes, op13_spelling_variants)}

ORACLES = {"op1_license_scan": license_oracle(), "op2_exact_dedup": EXACT_SQL, "op3_near_dedup": NEAR_SQL,
           "op10_warc": WARC_SQL, "op12_vector_codes": CODES_SQL, "op13_spelling_variants": SPELLING_SQL}
