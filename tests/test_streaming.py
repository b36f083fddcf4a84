"""The stateless SFT projection runs unchanged on a stream."""

import json

from conftest import write
from tessera.streaming.sft_stream import run_sft_stream


def test_available_now_stream(spark, tmp):
    src = tmp / "in"
    src.mkdir()
    write(src / "a.jsonl", json.dumps({"prompt": "p", "groundtruth": "g"}) + "\n\n" + json.dumps({"x": 1}) + "\n")
    write(src / "b.jsonl", json.dumps({"text": "t"}) + "\n{bad\n")
    out = str(tmp / "out")
    q = run_sft_stream(spark, str(src), out, str(tmp / "ckpt"))
    q.awaitTermination(120)
    rows = [(r.text, r.prompt_text, r._error, r.rec_error) for r in spark.read.parquet(out).collect()]
    assert ("t", "", None, None) in rows
    assert ("user: p\nassistant: g", "user: p\nassistant:", None, None) in rows
    assert (None, None, "UNSUPPORTED_ROW", None) in rows
    assert any(r[3] == "BAD_JSON" for r in rows)
