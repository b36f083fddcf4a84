"""Reader edge cases: detection, dialect line numbers, errors, round trips."""

import pytest
from pyspark.sql import functions as F

from conftest import write
from tessera.sources.records import RecordError, read_records


def _rows(df):
    return [(r.ord, r.line, None if r.rec is None else str(r.rec), r._error) for r in df.orderBy("ord").collect()]


def test_blank_lines_crlf_no_final_newline(spark, tmp):
    p = write(tmp / "a.jsonl", '\n{"a":1}\r\n\r\n{"b":2}\r{"c":3}')
    got = _rows(read_records(spark, p, "train", on_error="report"))
    assert [(o, l, e) for o, l, _, e in got] == [(0, 1, None), (1, 3, None), (2, 4, None)]
    api = _rows(read_records(spark, p, "api", on_error="report"))
    assert [l for _, l, _, _ in api] == [2, 4, 5]


def test_leading_blanks_then_non_object(spark, tmp):
    p = write(tmp / "b.jsonl", '\n\n[1]\n{"a":1}\n')
    with pytest.raises(RecordError, match="line 1: NOT_OBJECT"):
        read_records(spark, p, "infer", fmt="jsonl")
    with pytest.raises(RecordError, match="line 3: NOT_OBJECT"):
        read_records(spark, p, "api")
    with pytest.raises(RecordError, match="record 0: NOT_OBJECT"):
        read_records(spark, p, "train", fmt="jsonl")


def test_bad_json_line_numbers(spark, tmp):
    p = write(tmp / "c.jsonl", '\n\n{"a":\n{"b":2}\n')
    with pytest.raises(RecordError, match="line 1") as e:
        read_records(spark, p, "train")
    assert e.value.code == "BAD_JSON"


def test_train_parse_errors_win_over_type_errors(spark, tmp):
    p = write(tmp / "d.jsonl", '[1]\n{"a":1}\n{oops\n')
    with pytest.raises(RecordError) as e:
        read_records(spark, p, "train", fmt="jsonl")
    assert e.value.code == "BAD_JSON"
    with pytest.raises(RecordError) as e:
        read_records(spark, p, "infer", fmt="jsonl")
    assert e.value.code == "NOT_OBJECT"


def test_leading_bracket_means_array(spark, tmp):
    p = write(tmp / "e.jsonl", '[{"a":1},\n {"b":2}]\n')
    assert read_records(spark, p, "train").count() == 2
    with pytest.raises(RecordError) as e:
        read_records(spark, p, "api")
    assert e.value.code == "BAD_JSON"
    p1 = write(tmp / "e1.jsonl", '[{"a":1}, {"b":2}]\n')
    with pytest.raises(RecordError) as e:
        read_records(spark, p1, "api")
    assert e.value.code == "NOT_OBJECT"


def test_json_suffix_must_hold_a_list(spark, tmp):
    p = write(tmp / "f.json", '{"a":1}')
    with pytest.raises(RecordError, match="NOT_LIST"):
        read_records(spark, p, "train")
    assert read_records(spark, p, "api").count() == 1


def test_array_non_object_index(spark, tmp):
    p = write(tmp / "g.json", '[1, {}]')
    with pytest.raises(RecordError, match="record 0: NOT_OBJECT"):
        read_records(spark, p, "train")
    with pytest.raises(RecordError, match="record 0: NOT_OBJECT"):
        read_records(spark, p, "infer")


@pytest.mark.parametrize("content", ["[]", "", "   \n  "])
def test_empty_sources(spark, tmp, content):
    p = write(tmp / "h.json", content)
    with pytest.raises(ValueError, match="no records"):
        read_records(spark, p, "train")


def test_missing_file(spark, tmp):
    with pytest.raises(FileNotFoundError):
        read_records(spark, str(tmp / "missing.jsonl"))


def test_u2028_duplicate_keys_bom_utf8(spark, tmp):
    p = write(tmp / "i.jsonl", '﻿{"t":"a b","k":1,"k":2}\n')
    r = read_records(spark, p, "train").collect()
    assert len(r) == 1
    assert '"k":2' in str(r[0].rec)
    p2 = write(tmp / "j.jsonl", b'{"a":"\xff"}\n{"b":1}\n')
    with pytest.raises(RecordError) as e:
        read_records(spark, p2, "train")
    assert e.value.code == "BAD_UTF8"


def test_nan_is_bad_json(spark, tmp):
    p = write(tmp / "k.jsonl", '{"a":NaN}\n')
    with pytest.raises(RecordError):
        read_records(spark, p)


def test_positions_do_not_depend_on_splits(spark, tmp):
    lines = []
    for i in range(3000):
        lines.append('{"i":%d,"pad":"%s"}' % (i, "x" * (i % 50)))
        if i % 7 == 0:
            lines.append("")
    p = write(tmp / "big.jsonl", "\n".join(lines) + "\n")
    want = [(i, i) for i in range(3000)]
    for max_bytes in ("8k", "64k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
        try:
            df = read_records(spark, p, "train")
            got = sorted((r.ord, r.i) for r in df.select("ord", F.variant_get("rec", "$.i", "int").alias("i")).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want, max_bytes


@pytest.mark.parametrize("later", ["1", "3", "8"])
def test_rows_survive_another_split_layout(spark, tmp, later):
    """Built under one parallelism and read under another: no row is lost or renumbered."""
    from tessera.plans.jobs import load_sft_dataset
    n = 20_000
    p = write(tmp / "split.jsonl", "\n".join(
        '{"i":%d,"text":"row %d","split":"%s"}' % (i, i, "ab"[i % 2]) + ("\n" if i % 9 == 0 else "") for i in range(n)) + "\n")
    key = "spark.sql.leafNodeDefaultParallelism"
    spark.conf.set(key, "2")
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        recs = read_records(spark, p, "train")
        data = load_sft_dataset(spark, p, split_field="split", split="b", response_only_loss=False)
        spark.conf.set(key, later)
        got = sorted((r.ord, r.i) for r in recs.select("ord", F.variant_get("rec", "$.i", "int").alias("i")).collect())
        rows = sorted((r.ord, r.idx, r.text) for r in data.collect())
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(i, i) for i in range(n)]
    assert rows == [(i, i // 2, f"row {i}") for i in range(1, n, 2)]


@pytest.mark.parametrize("line", ['{"a":1}{"b":2}', '{"a":1} trailing', '{"a":1},{"b":2}', '{"a":1}]', '{"a":1},"x"', '{"a":1'])
def test_text_after_a_value_is_bad_json(spark, tmp, line):
    p = write(tmp / "glued.jsonl", '{"ok":1}\n' + line + "\n")
    with pytest.raises(RecordError, match="line 2") as e:
        read_records(spark, p, "train")
    assert e.value.code == "BAD_JSON"


@pytest.mark.parametrize("name", ["问题", 'with "quotes"', "it's", """both ' and \"""", "a.b c", "back\\\\slash"])
def test_any_field_name(spark, name):
    import json as _json

    from tessera.functions import variant as V
    df = spark.createDataFrame([(_json.dumps({name: "v", "x": 1}),)], "js string").select(F.parse_json("js").alias("rec"))
    row = df.select(V.as_string(V.field("rec", name)).alias("v"), V.has_key("rec", name + "?").alias("n")).first()
    assert (row.v, row.n) == ("v", False)


def test_numbers_and_lines_over_many_splits(spark, tmp):
    body = "\n".join(('{"i":%d}' % i) + ("\n" if i % 5 == 0 else "") for i in range(2000)) + "\n"
    p = write(tmp / "m.jsonl", "\n\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = read_records(spark, p, "train").select("ord", "line", F.variant_get("rec", "$.i", "int").alias("i"))
        got = sorted((r.ord, r.line, r.i) for r in rows.collect())
        api = sorted((r.ord, r.line) for r in read_records(spark, p, "api").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, line = [], 1
    for i in range(2000):
        want.append((i, line, i))
        line += 2 if i % 5 == 0 else 1
    assert got == want
    assert api == [(o, l + 2) for o, l, _ in want]
    arr = write(tmp / "m.json", "[" + ",".join('{"i":%d}' % i for i in range(50)) + "]")
    assert sorted(r.ord for r in read_records(spark, arr, "train").collect()) == list(range(50))


def test_paths_with_blanks_and_percent_signs(spark, tmp):
    folder = tmp / "a b%20c"
    folder.mkdir()
    write(folder / "0 empty.jsonl", " \n\n")
    write(folder / "1 full.jsonl", '[{"a":1},{"b":2}]')
    assert read_records(spark, str(folder / "1 full.jsonl"), "train").count() == 2
    assert read_records(spark, str(folder), "train").count() == 2


def test_first_char_through_hadoop_fs(spark, tmp):
    from tessera.sources.records import _first_char
    p = write(tmp / "w.jsonl", "\n 　\t[1]")
    # a path without the file: prefix goes through the Hadoop FileSystem reader
    assert _first_char(spark, str(p)) == "["
    assert _first_char(spark, "file:" + str(p)) == "["
    q = write(tmp / "w2.jsonl", "   ")
    assert _first_char(spark, str(q)) is None
    assert _first_char(spark, write(tmp / "w3.jsonl", " 頁")) == "頁"


def test_u2028_survives_sink_round_trip(spark, tmp):
    import json as _json

    from tessera.sinks import json_sink as S
    text = "line\u2028sep\u0085x\r\ny"
    df = spark.createDataFrame([(0, _json.dumps({"t": text}))], "ord long, js string").select(
        "ord", F.parse_json("js").alias("rec"))
    out = str(tmp / "u.jsonl")
    S.write_jsonl(df, out)
    back = read_records(spark, out, "train").collect()
    assert len(back) == 1
    assert _json.loads(str(back[0].rec))["t"] == text


def twelve_files(tmp):
    folder = tmp / "twelve"
    folder.mkdir()
    n, want, line = 0, [], 0
    for k in range(12):
        body = ""
        for i in range(50):
            if (i + k) % 7 == 0:
                body, line = body + "\n", line + 1
            body, line = body + '{"i":%d}\n' % n, line + 1
            want.append((n, line, n))
            n += 1
        write(folder / f"{k:02d}.jsonl", body + "\n" * (k % 3))
        line += k % 3
    return str(folder), want


def _numbers(df):
    return sorted((r.ord, r.line, r.i) for r in df.select("ord", "line", F.variant_get("rec", "$.i", "int").alias("i")).collect())


def test_lines_come_from_one_scan(spark, tmp, monkeypatch):
    """Many files, packed otherwise at every later step: the input is scanned once, and
    positions and lines are those of the files."""
    from tessera.sources import records
    path, want = twelve_files(tmp)
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    scans, real = [], records._line_table

    def counted(*a):
        scans.append(a)
        return real(*a)
    monkeypatch.setattr(records, "_line_table", counted)
    step, real_sums = [0], records.prefix_sums

    def repacked(*a):
        spark.conf.set(keys[0], "2")
        spark.conf.set(keys[1], str(1 << 22))
        step[0] += 1
        return real_sums(*a)
    monkeypatch.setattr(records, "prefix_sums", repacked)
    spark.conf.set(keys[0], "12")
    spark.conf.set(keys[1], "0")
    try:
        df, _ = records._jsonl(spark, path, "api")
        spark.conf.set(keys[0], "1")
        assert _numbers(df) == want
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert len(scans) == 1 and step == [1]
    assert path not in df._jdf.queryExecution().toString()  # later steps read the written rows alone


def test_numbers_beyond_the_broadcast_bound(spark, tmp, monkeypatch):
    """With more splits than a broadcast may hold, sums are spread and joined by shuffle."""
    from tessera.plans import jobs
    from tessera.sources import ordinals
    path, want = twelve_files(tmp)
    monkeypatch.setattr(ordinals, "BROADCAST_ROWS", 3)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert _numbers(read_records(spark, path, "api")) == want
        p = write(tmp / "sel.jsonl", "\n".join('{"text":"t%d","split":"%s"}' % (i, "ab"[i % 3 == 0]) for i in range(90)))
        rows = jobs.load_sft_dataset(spark, p, split_field="split", split="b").collect()
        assert sorted((r.ord, r.idx, r.text) for r in rows) == [(i, i // 3, f"t{i}") for i in range(0, 90, 3)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_index_after_a_filter_needs_no_sort(spark, tmp):
    """J1's index comes from ids and sums over splits: no sort, no range partitions and no
    join on positions in its plan."""
    from test_plans import plan
    from tessera.plans import jobs
    p = write(tmp / "plan.jsonl", "\n".join('{"text":"t%d","split":"%s"}' % (i, "ab"[i % 2]) for i in range(50)))
    told = plan(jobs.load_sft_dataset(spark, p, split_field="split", split="b"))
    assert "rangepartitioning" not in told and "SortMergeJoin" not in told and "BroadcastHashJoin" in told
