"""Documents without text or source: the J1 and J4 queries return what their SQL does."""

import json
import os
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import write
from tessera.operators import sft
from tessera.plans import jobs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import duck, rows_of  # noqa: E402

# (text, source): usable, then what no example can be made of; two batches of 8 have nothing else.
DOCS = [("Some text.", "web"), (None, "web"), ("More text\nin lines", "src1"), ("x" * 1500, "web"), ("z", "web"), ("Text", None),
        ("", "web"), ("Kept", "a"), *[(None, "web")] * 16, (" \t", "web"), ("No source", ""), ("", ""), ("No source", " "), ("Last", "b")]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("no-example")
    n = len(DOCS)
    pq.write_table(pa.table({"doc_id": list(range(0, 3 * n, 3)), "text": pa.array([t for t, _ in DOCS], pa.string()),
                             "lang": pa.array(["en"] * (n - 1) + ["de"], pa.string()), "source": pa.array([s for _, s in DOCS], pa.string()),
                             "n_chars": pa.array([len(t or "") for t, _ in DOCS], pa.int64())}), folder / "documents.parquet")
    pq.write_table(pa.table({"conv_id": [1, 1, 0, 0], "turn": [0, 1, 0, 1], "role": ["user", "assistant"] * 2,
                             "text": ["a", "b", "c", "d"]}), folder / "conversations.parquet")
    pq.write_table(pa.table({"doc_id": [3, 0], "quality": [0, 1], "toxic": [0, 0]}), folder / "labels.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["sft_dataset", "sft_dataset_full", "training_tensors", "training_tensors_full"])
def test_documents_without_text_or_source(spark, tables, name):
    df = E.queries()[name](spark, tables)
    res = duck(tables).execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    want = rows_of(cols, res.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want and len(want) == 2 * (len(DOCS) - 1)


def _file(tmp, *records):
    return write(tmp / "r.jsonl", "".join(json.dumps(r) + "\n" for r in records))


def test_keep_leaves_the_other_checks(spark, tmp):
    """Only a record that is no example is kept; what its fields give is not repaired."""
    good, bad = {"prompt": "q", "groundtruth": "a", "s": 1}, {"prompt": " ", "groundtruth": "a", "s": 1}
    odd = [{"messages": [{"role": "user", "content": "x"}], "text": "t", "s": 1}, {"groundtruth": "a", "s": 1}, {"prompt": "q", "s": 1}, {"text": "", "s": 1}]
    p = _file(tmp, good, bad, {"s": 2}, *odd)
    rows = jobs.load_sft_dataset(spark, p, split_field="s", split=1, on_error="keep").orderBy("idx").collect()
    assert [(r.ord, r.idx) for r in rows] == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4), (6, 5)]
    assert [r["_error"] for r in rows] == [None, sft.UNSUPPORTED_ROW, sft.LAST_NOT_ASSISTANT] + [sft.UNSUPPORTED_ROW] * 3
    assert [(r.text, r.prompt_text) for r in rows] == [
        ("user: q\nassistant: a", "user: q\nassistant:"), ("user:  \nassistant: a", "user:  \nassistant:"), (None, None),
        (None, None), (None, "user: q\nassistant:"), ("", "")]
    full = jobs.load_sft_dataset(spark, p, response_only_loss=False, split_field="s", split=1, on_error="keep").orderBy("idx").collect()
    assert [(r.text, r["_error"]) for r in full] == [
        ("user: q\nassistant: a", None), ("user:  \nassistant: a", sft.UNSUPPORTED_ROW), ("t", None),
        (None, sft.UNSUPPORTED_ROW), (None, sft.UNSUPPORTED_ROW), ("", sft.UNSUPPORTED_ROW)]
    with pytest.raises(ValueError, match="UNSUPPORTED_ROW"):
        jobs.load_sft_dataset(spark, p, split_field="s", split=1)
    with pytest.raises(ValueError, match="no record has"):
        jobs.load_sft_dataset(spark, p, split_field="s", split=3, on_error="keep")
    with pytest.raises(ValueError, match="line 2"):
        jobs.load_sft_dataset(spark, write(tmp / "b.jsonl", '{"text": "a"}\n{"text": \n'), on_error="keep")


def test_check_fails_on_examples_alone(spark, tmp):
    """J4 passes over rows that J1 has reported, and over no others."""
    p = _file(tmp, {"text": ""}, {"prompt": "q" * 9, "groundtruth": "a"}, {"text": "ab"})
    ds = jobs.load_sft_dataset(spark, p, on_error="keep")
    rows = jobs.training_tensors(ds, "codepoint", 40, 2).orderBy("idx").collect()
    assert [(r["_error"], r["example_error"]) for r in rows] == [("NO_RESPONSE_TOKENS", sft.UNSUPPORTED_ROW), (None, None), (None, None)]
    assert list(rows[0].labels) == [-100] * len(rows[1].input_ids) and list(rows[2].labels) == [97, 98]
    with pytest.raises(ValueError, match="row 1: NO_RESPONSE_TOKENS"):
        jobs.training_tensors(ds, "codepoint", 8, 2)
