"""Decision tables for full-text and response-only projections (edge rows)."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import sft

ROWS = [
    ({"text": "a", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]},
     ("a", None), ("user: u\nassistant: v", "user: u\nassistant:", None)),
    ({"text": "  a "}, ("  a ", None), ("  a ", "", None)),
    ({"text": 5, "prompt": "p", "groundtruth": "g"},
     ("user: p\nassistant: g", None), ("user: p\nassistant: g", "user: p\nassistant:", None)),
    ({"text": "　"}, (None, "UNSUPPORTED_ROW"), (None, None, "UNSUPPORTED_ROW")),
    ({"messages": [], "prompt": "p", "groundtruth": "g"},
     ("user: p\nassistant: g", None), ("user: p\nassistant: g", "user: p\nassistant:", None)),
    ({"messages": None, "prompt": "p", "groundtruth": "g"},
     ("user: p\nassistant: g", None), ("user: p\nassistant: g", "user: p\nassistant:", None)),
    ({"messages": [{"role": "user", "content": "u"}], "prompt": "p", "groundtruth": "g"},
     ("user: u", None), (None, None, "LAST_NOT_ASSISTANT")),
    ({"messages": [{"role": "assistant", "content": "v"}]},
     ("assistant: v", None), (None, None, "NO_PROMPT_MESSAGE")),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"},
                   {"role": "user", "content": "c"}, {"role": "assistant", "content": "d"}]},
     ("user: a\nassistant: b\nuser: c\nassistant: d", None),
     ("user: a\nassistant: b\nuser: c\nassistant: d", "user: a\nassistant: b\nuser: c\nassistant:", None)),
    ({"messages": [{"role": 1, "content": "x"}, {"role": "assistant", "content": "v"}]},
     (None, "MESSAGE_FIELDS"), (None, None, "MESSAGE_FIELDS")),
    ({"messages": ["oops", {"role": "assistant", "content": "v"}]},
     (None, "MESSAGE_FIELDS"), (None, None, "MESSAGE_FIELDS")),
    ({"messages": [{"role": "user", "content": "u"}, "oops"]},
     (None, "MESSAGE_FIELDS"), (None, None, "MESSAGE_FIELDS")),
    ({}, (None, "UNSUPPORTED_ROW"), (None, None, "UNSUPPORTED_ROW")),
    ({"prompt": " ", "groundtruth": "g"}, (None, "UNSUPPORTED_ROW"), (None, None, "UNSUPPORTED_ROW")),
]


@pytest.fixture(scope="module")
def records(spark):
    data = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(ROWS)]
    return spark.createDataFrame(data, "ord long, js string").select("ord", F.parse_json("js").alias("rec"))


def test_full_text(records):
    got = {r.ord: (r.text, r._error) for r in sft.full_text_df(records).collect()}
    for i, (_, want, _) in enumerate(ROWS):
        assert got[i] == want, (i, ROWS[i][0])


def test_response_only(records):
    got = {r.ord: (r.text, r.prompt_text, r._error) for r in sft.response_only_df(records).collect()}
    for i, (_, _, want) in enumerate(ROWS):
        assert got[i] == want, (i, ROWS[i][0])


def test_prefix_repair_with_instruction_template(spark):
    df = spark.createDataFrame([(0, json.dumps({"prompt": "p", "groundtruth": "g"}))], "ord long, js string") \
        .select("ord", F.parse_json("js").alias("rec"))
    r = sft.response_only_df(df, "instruction").collect()[0]
    assert r.prompt_text == "### user\np\n\n### Response:\n"
    assert r.text == r.prompt_text + "g"


def test_chatml_prefix_holds(spark):
    df = spark.createDataFrame([(0, json.dumps({"prompt": "p", "groundtruth": "g"}))], "ord long, js string") \
        .select("ord", F.parse_json("js").alias("rec"))
    r = sft.response_only_df(df, "chatml").collect()[0]
    assert r.prompt_text == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\n"
    assert r.text == "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\ng<|im_end|>\n"


def test_custom_fields(spark):
    df = spark.createDataFrame([(0, json.dumps({"q": "p", "a": "g", "prompt": "x"}))], "ord long, js string") \
        .select("ord", F.parse_json("js").alias("rec"))
    r = sft.response_only_df(df, prompt_field="q", response_field="a").collect()[0]
    assert r.text == "user: p\nassistant: g"


def test_split_filter_types(spark):
    rows = [(0, '{"split":"1"}'), (1, '{"split":1}'), (2, '{"other":"1"}'), (3, '{"split":"train"}')]
    df = spark.createDataFrame(rows, "ord long, js string").select("ord", F.parse_json("js").alias("rec"))
    assert [r.ord for r in sft.split_filter(df, "split", "1").collect()] == [0]
    assert [r.ord for r in sft.split_filter(df, "split", 1).collect()] == [1]
    assert sft.split_filter(df, "", "1").count() == 4
    assert sft.split_filter(df, "split", None).count() == 4


def test_fail_fast_index_counts_kept_rows(spark):
    rows = [(0, '{"text":"a","split":"x"}'), (1, '{"text":"b","split":"y"}'),
            (2, '{"text":"c","split":"y"}'), (3, '{"bad":1,"split":"y"}')]
    df = spark.createDataFrame(rows, "ord long, js string").select("ord", F.parse_json("js").alias("rec"))
    with pytest.raises(ValueError, match="index 2"):
        sft.sft_dataset(df, split_field="split", split="y")
    with pytest.raises(ValueError, match="no record has"):
        sft.sft_dataset(df, split_field="split", split="z")
    rep = sft.sft_dataset(df, on_error="report").orderBy("ord").collect()
    assert [r._error for r in rep] == [None, None, None, "UNSUPPORTED_ROW"]


def test_response_only_turns_table(spark):
    from tessera.functions.chat import PythonTemplate
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "v"),
            (2, 0, "user", "u"), (2, 1, "assistant", "v"), (2, 2, "user", "w"),
            (3, 0, "assistant", "v"),
            (4, 0, "user", None), (4, 1, "assistant", "v"),
            (5, 1, "assistant", "b"), (5, 0, "system", "s")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.text, r.prompt_text, r._error) for r in sft.response_only_turns(turns).collect()}
    assert got[1] == ("user: u\nassistant: v", "user: u\nassistant:", None)
    assert got[2] == (None, None, "LAST_NOT_ASSISTANT")
    assert got[3] == (None, None, "NO_PROMPT_MESSAGE")
    assert got[4] == (None, None, "MESSAGE_FIELDS")
    assert got[5] == ("system: s\nassistant: b", "system: s\nassistant:", None)
    inst = {r.conv_id: r for r in sft.response_only_turns(turns, template="instruction").collect()}
    assert inst[1].prompt_text == "### user\nu\n\n### Response:\n" and inst[1].text == inst[1].prompt_text + "v"

    def factory():
        return lambda msgs, gen: "|".join(m["role"] for m in msgs) + ("|gen" if gen else "")

    py = {r.conv_id: r for r in sft.response_only_turns(turns, template=PythonTemplate(factory)).collect()}
    assert py[1].prompt_text == "user|gen"
    assert py[1].text == "user|genv"


def _pipe_factory():
    return lambda msgs, gen: "|".join(f"{m['role']}={m['content']}" for m in msgs) + ("|>" if gen else "")


def test_python_template_on_records(spark):
    import sys

    from pyspark import cloudpickle

    from tessera.functions.chat import PythonTemplate
    from tessera.operators import infer as I
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    tpl = PythonTemplate(_pipe_factory)
    rows = [(0, json.dumps({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]})),
            (1, json.dumps({"prompt": "p", "groundtruth": "g"}))]
    df = spark.createDataFrame(rows, "ord long, js string").select("ord", F.parse_json("js").alias("rec"))
    full = {r.ord: r.text for r in sft.full_text_df(df, tpl).collect()}
    assert full == {0: "user=u|assistant=v", 1: "user=p|assistant=g"}
    ro = {r.ord: (r.text, r.prompt_text) for r in sft.response_only_df(df, tpl).collect()}
    assert ro[0] == ("user=u|>v", "user=u|>")
    pm = I.prompt_messages(df.where("ord = 0"))
    assert pm.select(I.render_prompt(F.col("messages"), tpl).alias("t")).collect()[0].t == "user=u|assistant=v|>"


def _json_factory():
    return lambda msgs, gen: json.dumps(msgs, sort_keys=True) + ("<gen>" if gen else "")


def test_templates_get_whole_messages(spark, tmp):
    """A tool call with null content, other keys and odd messages reach a user template as
    they stand, in J1 and in J2; built-in templates still refuse them."""
    import sys

    from pyspark import cloudpickle

    from conftest import write
    from tessera.functions.chat import PythonTemplate
    from tessera.operators import infer as I
    from tessera.plans import jobs
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    tpl = PythonTemplate(_json_factory)
    call = {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "f", "arguments": "{\"x\": 1}"}}]}
    msgs = [{"role": "user", "content": "é"}, call, {"role": "tool", "content": "7", "tool_call_id": "c1"},
            {"role": "assistant", "content": "seven", "note": 1.5}]
    p = write(tmp / "tools.jsonl", json.dumps({"messages": msgs}) + "\n" + json.dumps({"prompt": "p", "groundtruth": "g"}) + "\n"
              + json.dumps({"text": "plain"}) + "\n")
    rows = {r.ord: r for r in jobs.load_sft_dataset(spark, p, tpl).collect()}
    assert json.loads(rows[0].prompt_text.removesuffix("<gen>")) == msgs[:-1]
    assert rows[0].text == rows[0].prompt_text + "seven"  # the template's texts don't begin alike
    assert json.loads(rows[1].prompt_text.removesuffix("<gen>")) == [{"role": "user", "content": "p"}]
    assert (rows[2].text, rows[2].prompt_text) == ("plain", "")
    full = {r.ord: r.text for r in jobs.load_sft_dataset(spark, p, tpl, response_only_loss=False).collect()}
    assert json.loads(full[0]) == msgs and full[2] == "plain"
    assert json.loads(full[1]) == [{"role": "user", "content": "p"}, {"role": "assistant", "content": "g"}]
    with pytest.raises(ValueError, match="MESSAGE_FIELDS"):
        jobs.load_sft_dataset(spark, p)
    q = spark.createDataFrame([(0, json.dumps({"messages": msgs[:3]}))], "ord long, js string").select("ord", F.parse_json("js").alias("rec"))
    text = I.prompt_messages(q).select(I.render_prompt(F.col("messages"), tpl).alias("t")).first().t
    assert json.loads(text.removesuffix("<gen>")) == msgs[:3] and text.endswith("<gen>")
