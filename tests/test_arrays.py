"""JSON arrays cut by many tasks: against ``json.loads``, at any splits."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import write
from tessera.sources import arrays, ordinals
from tessera.sources.records import RecordError, read_records

VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text('a,"\\[]{}é\n ', max_size=8)),
    lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text('k,"\\', max_size=3), v, max_size=3)), max_leaves=8)


def scans(text: str, cuts: list[int], size: int = 3):
    """Both scans over splits that begin after the given stretches, in Arrow batches of
    ``size`` rows: the file's elements as texts, put together without Spark."""
    rows = text.encode().split(b",")
    starts = sorted({0, *[c for c in cuts if c < len(rows)]})
    splits = [(k, rows[a:b]) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(rows)]))]

    def batches(states=None):
        for k, part in splits:
            for lo in range(0, len(part), size):
                some = part[lo:lo + size]
                n = len(some)
                last = [[True] * n] if states is None else [[states[k][0]] * n, [states[k][1]] * n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([7] * n, pa.int64()), pa.array([k] * n, pa.int64()), pa.array(some, pa.binary()), *map(pa.array, last)],
                    names=["fid", "block", "value", *[f"s{i}" for i in range(len(last))]])

    told = pa.Table.from_batches(arrays._transfer(batches())).to_pylist()
    states, depth, odd = {}, 0, 0
    for t in sorted(told, key=lambda t: t["block"]):
        states[t["block"]] = (depth, odd)
        depth += t["inside"] if odd else t["outside"]
        odd ^= t["parity"]
    assert sum(t["size"] + t["n"] for t in told) == len(text.encode()) + 1
    out, ends = {}, 0
    for block in range(len(splits)):
        mine = [r for b in arrays._cut(batches(states)) for r in b.to_pylist() if r["block"] == block]
        for r in mine:
            if r["text"] is not None:
                out.setdefault(ends + r["k"], []).append(r["text"])
        ends += max(r["k"] for r in mine)
    return [b",".join(out[e]).decode() for e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=6), st.lists(st.integers(1, 30), max_size=5), st.booleans(), st.integers(1, 4))
def test_elements_are_those_of_the_array(values, cuts, spaced, size):
    text = json.dumps(values, ensure_ascii=False, indent=1 if spaced else None)
    parts = scans(text, cuts, size)
    assert parts[0].startswith("[") and parts[-1].endswith("]")
    parts[0] = parts[0][1:]
    parts[-1] = parts[-1][:-1]
    assert [json.loads(p) for p in parts] == values


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('\\"[]{}x', max_size=9), min_size=1, max_size=6))
def test_structure_leaves_escapes_out(stretches):
    data = "".join(stretches).encode()
    ends = np.cumsum([len(s) for s in stretches])
    at, quote, change = arrays.structure(np.frombuffer(data, np.uint8), ends)
    want, base = [], 0
    for s in stretches:
        skip = False
        for i, c in enumerate(s):
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c != "x":
                want.append((base + i, c == '"', {"[": 1, "{": 1, "]": -1, "}": -1}.get(c, 0)))
        base += len(s)
    assert list(zip(at.tolist(), quote.tolist(), change.tolist())) == want


@pytest.fixture()
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def records(n, seed):
    rng = random.Random(seed)
    words = ['a,b', 'say "hi"', "back\\slash", "[x]", "{y}", "é€😀", "line\nbreak", "\\\"", ",", "z" * 200]
    return [{"i": i, "split": rng.choice("ab"), "t": " ".join(rng.choices(words, k=rng.randrange(6))),
             "m": [{"k,": rng.choice(words)}] * rng.randrange(3)} for i in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_arrays_over_many_splits(spark, tmp, tiny_splits, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(ordinals, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(arrays, "BROADCAST_ROWS", 0)
    folder = tmp / "many"
    folder.mkdir()
    parts = [records(40, 1), [], records(1, 2), records(25, 3)]
    for k, part in enumerate(parts):
        write(folder / f"{k}.json", (" \n" if k % 2 else "\ufeff") + json.dumps(part, ensure_ascii=bool(k), indent=k or None) + "\n ")
    write(folder / "5 blank.json", " \n ")
    want = [r for p in parts for r in p]
    df, sel = arrays.array_records(spark, str(folder), lambda rec: F.try_variant_get(rec, "$.split", "string") == "a")
    got = sorted((r.ord, r.line, json.loads(str(r.rec)), r._error) for r in df.collect())
    assert [(o, l, e) for o, l, _, e in got] == [(i, None, None) for i in range(len(want))]
    assert [r for _, _, r, _ in got] == want
    chosen = sorted((r.idx, r.ord) for r in sel.select("idx", "ord").collect())
    assert chosen == list(enumerate(i for i, r in enumerate(want) if r["split"] == "a"))


BAD = {
    "[1,2": "BAD_JSON", "[1,2,": "BAD_JSON", "[1,]": "BAD_JSON", "[,1]": "BAD_JSON", "[1],": "BAD_JSON", "[1],[2]": "BAD_JSON",
    "[1] x": "BAD_JSON", '[{"a":1]}': "BAD_JSON", "[1 2]": "BAD_JSON", '["a,b]': "BAD_JSON", "[]x": "BAD_JSON", '[{"a":"\\,"}]': "BAD_JSON",
    "[": "BAD_JSON", "]": "BAD_JSON", '{"a":1': "BAD_JSON", '{"a":1,"b":[2,3]}': "NOT_LIST", '"x,y"': "NOT_LIST", "12": "NOT_LIST",
    '[{"a":1},{"b":NaN}]': "BAD_JSON", '[{"a":1}]]': "BAD_JSON", "[[1]": "BAD_JSON",
}


def test_broken_arrays(spark, tmp):
    """Every file by itself, all in one read: one error a file and no records of it."""
    folder = tmp / "bad"
    folder.mkdir()
    for k, text in enumerate(BAD):
        write(folder / f"{k:02d}.json", text)
    write(folder / "90.json", b'[{"a":"\xff"}]')
    write(folder / "91.json", '[{"good":1},[2,{"x":3}]]')
    rows = read_records(spark, str(folder), "train", on_error="report", fmt="array").collect()
    assert sorted(r._error for r in rows if r.ord == -1) == sorted([*BAD.values(), "BAD_UTF8"])
    assert [(r.ord, r._error) for r in rows if r.ord >= 0] == [(0, None), (1, "NOT_OBJECT")] or \
        sorted((r.ord, r._error) for r in rows if r.ord >= 0) == [(0, None), (1, "NOT_OBJECT")]
    for text in ("[1,2,", '{"a":1,"b":[2,3]}', "[1],"):
        with pytest.raises(RecordError) as e:
            read_records(spark, write(tmp / "one.json", text), "train")
        assert e.value.code == BAD[text] and "file" in str(e.value)


def test_changed_splits_are_noticed(spark, tmp, monkeypatch):
    """The second scan sees other splits than the first: read again, and an error at last."""
    p = write(tmp / "s.json", json.dumps(records(60, 4)))
    made, sizes = [0], ["1500", "2500"]
    key, real = "spark.sql.files.maxPartitionBytes", arrays._stretches

    def changing(spark_, path):
        spark_.conf.set(key, sizes[made[0] % 2] if made[0] < limit else "2000")
        made[0] += 1
        return real(spark_, path)
    monkeypatch.setattr(arrays, "_stretches", changing)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        limit = 2
        assert sorted(r.ord for r in read_records(spark, p, "train").collect()) == list(range(60))
        assert made[0] == 4
        made[0], limit = 0, 100
        with pytest.raises(Exception, match="changed in each"):
            read_records(spark, p, "train")
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_an_array_beyond_one_variant(spark, tmp):
    """300 MB on one line: several tasks, one element a VARIANT."""
    text = ("words, and more words. " * 45_000)[:1_000_000]
    p = str(tmp / "large.json")
    with open(p, "w") as fh:
        fh.write("[")
        fh.writelines(("," if i else "") + json.dumps({"i": i, "t": text}) for i in range(300))
        fh.write("]")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32m")
    try:
        df = read_records(spark, p, "train")
        got = df.select("ord", F.variant_get("rec", "$.i", "int").alias("i"), F.length(F.variant_get("rec", "$.t", "string")).alias("n"))
        assert sorted(tuple(r) for r in got.collect()) == [(i, i, 1_000_000) for i in range(300)]
        assert spark.read.option("lineSep", ",").text(p).select(F.spark_partition_id()).distinct().count() >= 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
