"""J1 end to end from files: checks in input order, index after the split filter."""

import pytest

from conftest import write
from tessera.plans import jobs
from tessera.sources.records import RecordError


def test_load_sft_dataset_paths(spark, tmp):
    p = write(tmp / "d.jsonl", '{"text":"a","split":"x"}\n{"text":"b","split":"y"}\n\n{"bad":1,"split":"y"}\n'
                               '{"prompt":"p","groundtruth":"g","split":"y"}\n')
    with pytest.raises(ValueError, match="index 1"):
        jobs.load_sft_dataset(spark, p, split_field="split", split="y")
    with pytest.raises(ValueError, match="no record has"):
        jobs.load_sft_dataset(spark, p, split_field="split", split="z")
    ok = jobs.load_sft_dataset(spark, p, split_field="split", split="x").collect()
    assert [(r.ord, r.text, r.prompt_text) for r in ok] == [(0, "a", "")]
    rep = jobs.load_sft_dataset(spark, p, split_field="split", split="y", on_error="report").orderBy("ord").collect()
    assert [(r.ord, r._error) for r in rep] == [(1, None), (2, "UNSUPPORTED_ROW"), (3, None)]
    full = jobs.load_sft_dataset(spark, p, response_only_loss=False, split_field="split", split="x").collect()
    assert full[0].text == "a" and "prompt_text" not in full[0].asDict()


def test_bad_record_aborts_first(spark, tmp):
    p = write(tmp / "e.jsonl", '{"text":"a"}\n[1]\n{"nope":1}\n')
    with pytest.raises(RecordError, match="record 1: NOT_OBJECT"):
        jobs.load_sft_dataset(spark, p)
    q = write(tmp / "f.jsonl", "\n \n")
    with pytest.raises(ValueError, match="no records"):
        jobs.load_sft_dataset(spark, q)


def test_training_tensors_from_dataset(spark, tmp):
    p = write(tmp / "g.jsonl", '{"prompt":"ab","groundtruth":"cd"}\n{"text":"xyz"}\n')
    ds = jobs.load_sft_dataset(spark, p)
    t = {r.ord: r for r in jobs.training_tensors(ds, "codepoint", 64, 2).collect()}
    assert t[0].labels[: len("user: ab\nassistant:")] == [-100] * len("user: ab\nassistant:")
    assert t[1].labels[:3] == [ord("x"), ord("y"), ord("z")]
    assert len(t[0].input_ids) == len(t[1].input_ids)


@pytest.mark.parametrize("fmt", ["jsonl", "json"])
def test_split_index_is_partition_invariant(spark, tmp, fmt):
    import json
    recs = [{"text": "t%d" % i + "x" * (i % 40), "split": "a" if i % 3 else "b"} for i in range(2500)]
    if fmt == "jsonl":
        body = "\n".join(json.dumps(r) + ("\n" if i % 11 == 0 else "") for i, r in enumerate(recs)) + "\n"
    else:
        body = json.dumps(recs)
    p = write(tmp / f"s.{fmt}", body)
    want_ords = [i for i, r in enumerate(recs) if r["split"] == "a"]
    want = list(zip(want_ords, range(len(want_ords))))
    for max_bytes in ("8k", "64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
        try:
            got = sorted((r.ord, r.idx) for r in
                         jobs.load_sft_dataset(spark, p, split_field="split", split="a").select("ord", "idx").collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want, max_bytes


def test_training_tensors_partition_invariant(spark, tmp):
    import json
    recs = [{"prompt": "q%d" % i, "groundtruth": "a" * (1 + i % 9), "split": "s" if i % 4 else "o"}
            for i in range(600)]
    p = write(tmp / "t.jsonl", "\n".join(json.dumps(r) for r in recs) + "\n")
    results = []
    for max_bytes in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
        try:
            ds = jobs.load_sft_dataset(spark, p, split_field="split", split="s")
            t = jobs.training_tensors(ds, "codepoint", 32, 3, "left")
            results.append(sorted((r.idx, r.batch_id, tuple(r.input_ids), tuple(r.labels)) for r in t.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert results[0] == results[1]
    assert [r[1] for r in results[0]] == [i // 3 for i in range(len(results[0]))]


def test_dataset_parquet_round_trip(spark, tmp):
    p = write(tmp / "r.jsonl", '{"prompt":"ab","groundtruth":"cd"}\n{"text":"xyz"}\n')
    ds = jobs.load_sft_dataset(spark, p)
    out = str(tmp / "ds.parquet")
    jobs.save_sft_dataset(ds, out)
    back = sorted(tuple(r) for r in spark.read.parquet(out).select("ord", "idx", "text", "prompt_text").collect())
    assert back == sorted(tuple(r) for r in ds.select("ord", "idx", "text", "prompt_text").collect())
    with pytest.raises(Exception):
        jobs.save_sft_dataset(ds, out)


def test_api_resume_skips_answered_rows(spark, tmp):
    import json
    from pyspark.sql import functions as F
    from tessera.plans import stubs
    p = write(tmp / "q.jsonl", "\n".join(json.dumps({"id": i, "prompt": "p" * (i + 2)}) for i in range(12)) + "\n")
    first = jobs.api_inference(spark, p, None, "http://h", "m", transport=stubs.stub_transport)
    done = first.where(F.col("index") < 5)
    log = str(tmp / "calls.log")

    def counting(url, body, headers, timeout):
        with open(log, "a") as fh:
            fh.write("x\n")
        return stubs.stub_transport(url, body, headers, timeout)

    resumed = jobs.api_inference(spark, p, None, "http://h", "m", transport=counting, done=done)
    rows = resumed.collect()
    assert [r["index"] for r in rows] == list(range(12))
    assert [(r.ok, r.response, r.error) for r in rows] == [(r.ok, r.response, r.error) for r in first.collect()]
    with open(log) as fh:
        assert len(fh.readlines()) == 7  # only the rows without a result were called


def test_api_resume_from_results_file(spark, tmp):
    import json
    from pyspark.sql import functions as F
    from tessera.plans import stubs
    p = write(tmp / "q2.jsonl", "\n".join(json.dumps({"id": i, "prompt": "p" * (i + 2)}) for i in range(12)) + "\n")
    out = str(tmp / "first.jsonl")
    first = jobs.api_inference(spark, p, out, "http://h", "m", transport=stubs.stub_transport)
    want = [(r.ok, r.response, r.error) for r in first.collect()]
    done = jobs.read_results(spark, out).where(F.col("index") < 4)
    log = str(tmp / "calls2.log")

    def counting(url, body, headers, timeout):
        with open(log, "a") as fh:
            fh.write("x\n")
        return stubs.stub_transport(url, body, headers, timeout)

    resumed = jobs.api_inference(spark, p, None, "http://h", "m", transport=counting, done=done).collect()
    assert [r["index"] for r in resumed] == list(range(12))
    assert [(r.ok, r.response, r.error) for r in resumed] == want
    with open(log) as fh:
        assert len(fh.readlines()) == 8


@pytest.mark.parametrize("fmt", ["jsonl", "json"])
def test_long_integers_come_through_unchanged(spark, tmp, fmt):
    """Integers beyond 38 digits, nested and negative, through J2 in either format."""
    import json
    import os

    from tessera.plans import stubs
    big = 12345678901234567890123456789012345678901234567890
    recs = [{"id": big, "prompt": "a"}, {"prompt": "b", "m": {"x": [-big, 1, 10**37]}, "output": "old"}, {"id": 3, "prompt": "c"},
            {"prompt": "digits " + "7" * 60 + " } in a text"}, {"prompt": "q", "é\"k": big, "z": None}]
    p = write(tmp / f"in.{fmt}", json.dumps(recs) if fmt == "json" else "\n".join(json.dumps(r, ensure_ascii=False) + " " for r in recs))
    out = str(tmp / f"out.{fmt}")
    jobs.batch_inference(spark, p, out, stubs.echo_model_factory, num_repeats=2, output_field="output", seed=1)
    text = [open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part-")]
    got = [r for t in text for r in (json.loads(t) if fmt == "json" else map(json.loads, t.splitlines()))]
    assert [{k: v for k, v in r.items() if k != "output"} for r in got] == [{k: v for k, v in r.items() if k != "output"} for r in recs]
    assert all(len(r["output"]) == 2 and r["output"][0].startswith("gen:") for r in got)


def test_compatible_loader(spark, tmp):
    p = write(tmp / "old.jsonl", '{"prompt":"ab","groundtruth":"cd"}\n{"text":"xyz"}\n')
    rows = {r.ord: (r.idx, r.text, r.prompt_text) for r in jobs.load_sft_jsonl(spark, p).collect()}
    assert rows == {0: (0, "user: ab\nassistant: cd", "user: ab\nassistant:"), 1: (1, "xyz", "")}
    assert jobs.load_sft_jsonl(spark, p, "chatml").where("ord = 0").first().text.startswith("<|im_start|>user\nab")
