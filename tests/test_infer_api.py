"""Prompt rows, lenient rendering, generation plumbing, API envelope, sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import write
from tessera.functions import chat
from tessera.operators import api as A
from tessera.operators import infer as I
from tessera.plans import jobs, stubs
from tessera.sinks import json_sink as S
from tessera.sources.records import read_records


def _recs(spark, rows):
    data = [(i, json.dumps(r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ord long, js string").select("ord", F.parse_json("js").alias("rec"))


def test_prompt_messages_table(spark):
    rows = [{"prompt": "p"}, {"messages": [{"role": "user", "content": "u"}]}, {"messages": []},
            {"messages": None, "prompt": "p"}, {"prompt": " "}, {"messages": [{"content": "c"}, {"role": "x"}]}]
    got = I.prompt_messages(_recs(spark, rows), system_prompt="s")
    got = got.select("ord", "_error", I.render_prompt(F.col("messages")).alias("t"),
                     F.size("messages").alias("n")).orderBy("ord").collect()
    assert (got[0].t, got[0].n) == ("system: s\nuser: p", 2)
    assert (got[1].t, got[1].n) == ("user: u", 1)
    assert (got[2].t, got[2].n) == ("", 0)
    assert got[3]._error == "MESSAGES_NOT_LIST"
    assert got[4]._error == "EMPTY_PROMPT"
    assert got[5].t == "user: c\nx: "
    no_sys = I.prompt_messages(_recs(spark, [{"prompt": "p"}]), system_prompt="").select(
        I.render_prompt(F.col("messages")).alias("t")).collect()[0]
    assert no_sys.t == "user: p"


def test_lenient_render_prints_python_values(spark):
    rows = [{"messages": [{"role": None, "content": 5}, {"role": "a", "content": True}]}]
    pm = I.prompt_messages(_recs(spark, rows))
    assert pm.select(chat.render_inference(F.col("messages")).alias("t")).collect()[0].t == "None: 5\na: True"


def test_repeat_guard_and_layout(spark):
    df = spark.range(3).withColumnRenamed("id", "ord").withColumn("text", F.lit("x"))
    with pytest.raises(ValueError):
        I.repeat_items(df, 0)
    got = [(r.ord, r.rep, r.work_idx, r.batch_id) for r in I.repeat_items(df, 2, 4).orderBy("work_idx").collect()]
    assert got == [(0, 0, 0, 0), (0, 1, 1, 0), (1, 0, 2, 0), (1, 1, 3, 0), (2, 0, 4, 1), (2, 1, 5, 1)]


def test_generation_config_switch(spark):
    r = spark.range(1).select(I.generation_config(0.0, 0.9, 8).alias("g"),
                              I.generation_config(0.5, 0.9, 8).alias("h")).collect()[0]
    assert (r.g.do_sample, r.g.temperature, r.g.top_p) == (False, None, None)
    assert (r.h.do_sample, r.h.temperature, r.h.top_p) == (True, 0.5, 0.9)


def _envelope(spark, status, body, exc=None):
    df = spark.createDataFrame([(0, status, body, exc, 0.1)], A.RESPONSE_SCHEMA)
    return A.envelope(df).collect()[0]


def test_envelope_cases(spark):
    ok = _envelope(spark, 200, json.dumps({"choices": [{"message": {"content": "hi"}}]}))
    assert (ok.ok, ok.response, ok.error) == (True, "hi", None)
    null = _envelope(spark, 200, json.dumps({"choices": [{"message": {"content": None}}]}))
    assert (null.ok, null.response) == (True, None)
    nochoice = _envelope(spark, 200, "{}")
    assert (nochoice.ok, nochoice.error) == (False, "KeyError('choices')")
    http = _envelope(spark, 500, "x")
    assert (http.ok, http.error) == (False, "HTTP 500: x")
    timeout = _envelope(spark, None, None, "TimeoutError('timed out')")
    assert (timeout.ok, timeout.error) == (False, "TimeoutError('timed out')")


def test_messages_forwarded_unchanged(spark):
    rows = [{"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}], "name": "n"}]}]
    pm = I.prompt_messages(_recs(spark, rows))
    body = pm.select(A.request_body(F.col("messages"), "m").alias("b")).collect()[0].b
    msg = json.loads(body)["messages"][0]
    assert msg == {"content": [{"type": "text", "text": "x"}], "name": "n", "role": "user"}
    assert A.endpoint_url("http://h/v1//") == "http://h/v1/chat/completions"


def test_api_key_resolution(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert A.resolve_api_key(None) == "EMPTY"
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert A.resolve_api_key(None) == "k"
    assert A.resolve_api_key("a") == "a"


def test_invalid_row_aborts_before_any_call(spark, tmp):
    log = str(tmp / "calls")

    def transport(url, body, headers, timeout):
        with open(log, "ab") as fh:  # the calls happen in worker processes
            fh.write(b"x")
        return 200, "{}"

    p = write(tmp / "p.jsonl", '{"prompt":"a"}\n{"id":1}\n')
    with pytest.raises(ValueError):
        jobs.api_inference(spark, p, None, "http://h", "m", transport=transport)
    good = write(tmp / "g.jsonl", '{"prompt":"a"}\n')
    for names in ({"id_field": "index"}, {"id_field": "prompt"}):
        with pytest.raises(ValueError):
            jobs.api_inference(spark, good, None, "http://h", "m", transport=transport, **names)
    assert not os.path.exists(log)
    jobs.api_inference(spark, good, None, "http://h", "m", transport=transport)
    assert os.path.getsize(log) == 1


def test_long_integers_of_copied_fields(spark, tmp):
    """``id`` and ``prompt`` with integers beyond 38 digits stand in the results file as in the input."""
    big = 12345678901234567890123456789012345678901234567890
    user = [{"role": "user", "content": "u"}]
    rows = [{"id": big, "prompt": "a"}, {"id": [-big, "7" * 60, {"k": big + 1}], "prompt": "b"}, {"id": 5, "prompt": "9" * 50},
            {"id": "8" * 45, "prompt": "q", "n": big}, {"messages": user, "prompt": big, "id": None}, {"messages": user, "prompt": {"x": big}}]
    lines = [json.dumps(r) for r in rows] + [f'{{"id":{big},"id":{big}7,"prompt":"twice"}}', f'{{"id":{big},"id":4,"prompt":"twice"}}']
    out = str(tmp / "res.jsonl")
    got = jobs.api_inference(spark, write(tmp / "p.jsonl", "\n".join(lines)), out, "http://h/", "m", transport=stubs.stub_transport)
    assert got.columns == ["index", "ok", "response", "raw_response", "error", "latency_sec", "id", "prompt"]
    back = [json.loads(line) for f in sorted(os.listdir(out)) if f.startswith("part") for line in open(os.path.join(out, f))]
    assert [r["index"] for r in back] == list(range(len(lines))) and all(r["ok"] for r in back)
    for r, want in zip(back, rows):
        assert {k: v for k, v in r.items() if k in ("id", "prompt")} == {k: v for k, v in want.items() if k in ("id", "prompt")}
    assert back[7]["id"] == 4 and float(back[6]["id"]) == float(big * 10 + 7)


def test_two_factories_of_one_function_are_two_models(spark):
    from tessera.operators import infer as I

    def make(answer):
        class Fixed:
            def generate(self, ids, mask, config, seeds):
                return [list(x) + [ord(answer)] for x in ids]
        return Fixed

    items = I.repeat_items(spark.range(6).select(F.col("id").alias("ord"), F.lit("p").alias("text")), 1, 2, 2**31 - 1)
    for answer in "AB":
        gen = I.generate(I.pad_batches(items, "codepoint"), make(answer), {})
        assert {r.output for r in I.decode_outputs(gen, "codepoint").collect()} == {answer}
    seeds = [r.seed for r in items.collect()]
    assert len(set(seeds)) == 6 and all(0 <= s < 2**31 for s in seeds)


def test_api_job_writes_in_order_with_optional_keys(spark, tmp):
    p = write(tmp / "p.jsonl", "\n".join(json.dumps({"id": i, "prompt": "x" * (i + 1)}) for i in range(30)) + "\n")
    out = str(tmp / "res.jsonl")
    jobs.api_inference(spark, p, out, "http://h/", "m", transport=stubs.stub_transport)
    back = [json.loads(line) for f in sorted(os.listdir(out)) if f.startswith("part")
            for line in open(os.path.join(out, f))]
    assert [r["index"] for r in back] == list(range(30))
    assert all(("error" in r) != r["ok"] and ("raw_response" in r) == r["ok"] for r in back)
    with pytest.raises(FileExistsError):
        jobs.api_inference(spark, p, out, "http://h/", "m", transport=stubs.stub_transport)


def test_batch_job_scalar_list_and_formats(spark, tmp):
    p = write(tmp / "p.json", json.dumps([{"id": "a", "prompt": "hello"}, {"id": "b", "output": "old",
                                          "messages": [{"role": "user", "content": "q"}]}]))
    out = str(tmp / "o.jsonl")
    jobs.batch_inference(spark, p, out, stubs.echo_model_factory, "codepoint", num_repeats=1, batch_size=1)
    rows = read_records(spark, out, "infer").orderBy("ord").collect()
    first = json.loads(str(rows[0].rec))
    second = json.loads(str(rows[1].rec))
    assert isinstance(first["output"], str) and first["output"].startswith("gen:")
    assert isinstance(second["output"], str) and second["output"] != "old"
    out2 = str(tmp / "o2.json")
    jobs.batch_inference(spark, p, out2, stubs.echo_model_factory, "codepoint", num_repeats=1, batch_size=2,
                         always_list_output=True)
    back = read_records(spark, out2, "infer").orderBy("ord").collect()
    assert isinstance(json.loads(str(back[0].rec))["output"], list)
    assert S.output_format("x.jsonl") == "jsonl" and S.output_format("x.txt") == "json"
    assert S.output_format("x.jsonl", "json") == "json"


@pytest.mark.parametrize("tasks", [None, 1, 2, 50])
def test_concurrency_is_the_total(spark, tmp, tasks):
    """The most calls in flight at once, from the begin and end of every call."""
    log = str(tmp / "flights")

    def transport(url, body, headers, timeout):
        import time
        began = time.time()
        time.sleep(0.05)
        with open(log, "a") as fh:
            fh.write(f"{began} {time.time()}\n")
        return 200, json.dumps({"choices": [{"message": {"content": "ok"}}]})

    req = spark.range(40).select(F.col("id").alias("ord"), F.lit("{}").alias("body"))
    out = A.call(req, "http://h/chat/completions", None, transport, concurrency=3, tasks=tasks, checkpoint=False)
    rows = out.collect()
    assert sorted(r.ord for r in rows) == list(range(40))
    assert all(r.status == 200 for r in rows)
    spans = [tuple(map(float, x.split())) for x in open(log)]
    assert len(spans) == 40
    assert max(sum(a <= t < z for a, z in spans) for t, _ in spans) <= 3


def test_json_array_sink_with_empty_partitions(spark, tmp):
    df = spark.range(0, 40, 1, 8).where("id < 5 OR id > 35").select(
        F.col("id").alias("ord"), F.to_variant_object(F.struct(F.col("id").alias("i"))).alias("rec"))
    out = str(tmp / "arr")
    S.write_json_array(df, out)
    parts = sorted(f for f in os.listdir(out) if f.startswith("part"))
    for f in parts:
        json.loads(open(os.path.join(out, f)).read())  # every part is one valid array
    back = read_records(spark, out, "train").orderBy("ord").collect()
    assert [json.loads(str(r.rec))["i"] for r in back] == [0, 1, 2, 3, 4, 36, 37, 38, 39]
    assert [r.ord for r in back] == list(range(9))
