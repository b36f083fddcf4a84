"""What a query writes, moves and holds at once follows from its input, not from its rows' shape."""

import glob
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessera.plans import queries as Q
from tessera.sinks import json_sink as S
from tessera.sources import records, rows, tables


def _tables(folder):
    """Tables of a size between: texts that compress, ids out of order."""
    words = [f"word{i % 97} text{i % 31}" for i in range(300)]
    n = 300
    pq.write_table(pa.table({"doc_id": [(i * 7) % n for i in range(n)], "text": [" ".join(words[i % 50:]) for i in range(n)],
                             "lang": [("en", "de")[i % 2] for i in range(n)], "source": ["web"] * n,
                             "n_chars": pa.array([1] * n, pa.int64())}), folder / "documents.parquet")
    pq.write_table(pa.table({"conv_id": [1, 1, 0, 0], "turn": [0, 1, 0, 1], "role": ["user", "assistant"] * 2,
                             "text": ["a", "b", "c", "d"]}), folder / "conversations.parquet")
    pq.write_table(pa.table({"doc_id": [3, 1, 2], "quality": [0, 1, 1], "toxic": [0, 0, 1]}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": [5, 4], "text": ["x", "y"]}), folder / "benchmark.parquet")
    return str(folder)


def test_corpus_file_is_compressed_and_in_order(spark, tmp, monkeypatch):
    """many ranges give the same order, and fewer bytes than the lines have."""
    monkeypatch.setattr(tables, "RANGE_BYTES", 500)
    path = Q._write_corpus_file(spark, _tables(tmp), extra_bad=True)
    files = [f for f in glob.glob(f"{path.removeprefix('file:')}/**/*", recursive=True) if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))]
    assert len(files) > 8
    lines = [r.value for r in spark.read.text(path).select("value").collect()]
    assert sum(map(os.path.getsize, files)) < sum(map(len, lines)) / 2
    recs = records.read_records(spark, path, "infer", on_error="report").orderBy("ord").collect()
    ids = [0, 1] + 2 * list(range(300)) + [1, 2, 3]
    got = [json.loads(r.rec.toJson()) for r in recs[:len(ids)]]
    assert [r.get("conv_id", r.get("doc_id")) for r in got] == ids
    assert ["messages" in r for r in got[:2]] == [True] * 2 and all("text" in r for r in got[2:302]) and all("prompt" in r for r in got[302:602])
    assert [r["_error"] for r in recs[len(ids):]] == ["BAD_JSON"] * 2 + ["NOT_OBJECT"] * 3
    assert [r.ord for r in recs] == list(range(len(ids) + 5))


def test_documents_are_moved_once(spark, tmp):
    plan = tables.document_json(spark, _tables(tmp), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("exchange rangepartitioning") == 1 and "json" not in plan[plan.index("Exchange"):].lower()


def test_first_character_of_a_compressed_file(spark, tmp):
    import gzip
    with gzip.open(tmp / "a.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('\n[{"i": 1}]')
    assert records._first_char(spark, str(tmp / "a.jsonl.gz")) == "["


def test_a_line_is_parsed_once(spark, tmp):
    """one place in the plan parses the lines, also below the condition on blank ones."""
    (tmp / "r.jsonl").write_text('{"i": 1}\n\n{"i": 2\n [3] \n', encoding="utf-8")
    df = rows.with_record(spark.read.text(str(tmp / "r.jsonl")), F.col("value"), F.length("value") > 0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(rows._GUARD + '"]') == 1
    assert [r and json.loads(r) for (r,) in df.select(F.to_json("rec")).collect()] == [{"i": 1}, None, None, [3]]


def test_stream_output_and_stored_tables_are_compressed(spark, tmp):
    """Parquet written by the library takes zstd."""
    from tessera.streaming.sft_stream import run_sft_stream
    (tmp / "in").mkdir()
    (tmp / "in" / "a.jsonl").write_text('{"text": "a"}\n', encoding="utf-8")
    run_sft_stream(spark, str(tmp / "in"), str(tmp / "out"), str(tmp / "ckpt")).awaitTermination()
    stored = rows.stored(spark.range(0, 3, 1, 1), "any").inputFiles()[0].removeprefix("file:").replace("///", "/")
    for f in [*glob.glob(str(tmp / "out" / "*.parquet")), stored]:
        assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"


def test_array_sink_takes_few_records_at_once(spark, tmp, monkeypatch):
    """no batch that reaches Python holds more than about a megabyte of long records."""
    seen = str(tmp / "seen")
    os.makedirs(seen)
    plain = S.slices

    def spying(batches, *a):
        def noted():
            for i, b in enumerate(batches):
                with open(f"{seen}/{os.getpid()}-{id(b)}-{i}", "w") as f:
                    f.write(str(b.nbytes))
                yield b
        yield from plain(noted(), *a)
    monkeypatch.setattr(S, "slices", spying)
    df = spark.range(0, 60, 1, 1).select(F.col("id").alias("ord"), F.to_variant_object(F.struct("id", F.repeat(F.lit("x"), 200_000).alias("text"))).alias("rec"))
    S.write_json_array(df, str(tmp / "out"))
    sizes = [int(open(f).read()) for f in glob.glob(f"{seen}/*")]
    assert sizes and max(sizes) < 3 << 20
    back = [x["id"] for f in sorted(glob.glob(str(tmp / "out" / "part-*"))) for x in json.load(open(f))]
    assert back == list(range(60))
