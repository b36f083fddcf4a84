"""Random records against a small independent Python oracle (C1, C2, J4).

The oracle follows the decision tables directly; Spark runs each generated
batch in one job.
"""

import json
import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import collate as C
from tessera.operators import sft

ALPHABET = st.sampled_from(list("ab z") + ["　", " ", "\t", "\n", "é", "😀", "​", " "])
TEXT = st.text(ALPHABET, max_size=6)
SCALAR = st.one_of(TEXT, st.integers(-3, 3), st.booleans(), st.none())
MESSAGE = st.one_of(
    st.fixed_dictionaries({"role": st.one_of(st.sampled_from(["user", "assistant", "system"]), SCALAR),
                           "content": st.one_of(TEXT, SCALAR)}),
    st.fixed_dictionaries({"content": TEXT}),
    TEXT,
)
MESSAGES = st.one_of(st.lists(MESSAGE, max_size=4), SCALAR)
RECORD = st.dictionaries(st.sampled_from(["text", "messages", "prompt", "groundtruth", "other"]),
                         st.one_of(SCALAR, MESSAGES), max_size=4).map(
    lambda d: {k: v for k, v in d.items()})
SETTINGS = settings(max_examples=int(os.environ.get("PROPERTY_EXAMPLES", "10")), deadline=None, suppress_health_check=list(HealthCheck))


def _is_text(v):
    return isinstance(v, str) and bool(v.strip())


def _valid(m):
    return isinstance(m, dict) and isinstance(m.get("role"), str) and isinstance(m.get("content"), str)


def _render(msgs, gen=False):
    lines = [f"{m['role']}: {m['content']}" for m in msgs]
    if gen:
        lines.append("assistant:")
    return "\n".join(lines)


def py_full(rec):
    if _is_text(rec.get("text")):
        return rec["text"], None
    m = rec.get("messages")
    if isinstance(m, list) and m:
        return (_render(m), None) if all(_valid(x) for x in m) else (None, "MESSAGE_FIELDS")
    p, r = rec.get("prompt"), rec.get("groundtruth")
    if _is_text(p) and _is_text(r):
        return _render([{"role": "user", "content": p}, {"role": "assistant", "content": r}]), None
    return None, "UNSUPPORTED_ROW"


def py_response_only(rec):
    m = rec.get("messages")
    if isinstance(m, list) and m:
        last = m[-1]
        if not isinstance(last, dict):
            return None, None, "MESSAGE_FIELDS"
        if last.get("role") != "assistant" or not isinstance(last.get("content"), str):
            return None, None, "LAST_NOT_ASSISTANT"
        if len(m) == 1:
            return None, None, "NO_PROMPT_MESSAGE"
        if not all(_valid(x) for x in m[:-1]):
            return None, None, "MESSAGE_FIELDS"
        prompt = _render(m[:-1], True)
        full = _render(m)
        return (full if full.startswith(prompt) else prompt + last["content"]), prompt, None
    p, r = rec.get("prompt"), rec.get("groundtruth")
    if _is_text(p) and _is_text(r):
        return f"user: {p}\nassistant: {r}", "user: {p}\nassistant:".format(p=p), None
    if _is_text(rec.get("text")):
        return rec["text"], "", None
    return None, None, "UNSUPPORTED_ROW"


def _df(spark, recs):
    data = [(i, json.dumps(r)) for i, r in enumerate(recs)]
    return spark.createDataFrame(data, "ord long, js string").select("ord", F.parse_json("js").alias("rec"))


@SETTINGS
@given(st.lists(RECORD, min_size=20, max_size=60))
def test_full_text_matches_python(spark, recs):
    got = {r.ord: (r.text, r._error) for r in sft.full_text_df(_df(spark, recs)).collect()}
    for i, rec in enumerate(recs):
        assert got[i] == py_full(rec), rec


@SETTINGS
@given(st.lists(RECORD, min_size=20, max_size=60))
def test_response_only_matches_python(spark, recs):
    got = {r.ord: (r.text, r.prompt_text, r._error) for r in sft.response_only_df(_df(spark, recs)).collect()}
    for i, rec in enumerate(recs):
        assert got[i] == py_response_only(rec), rec


def py_collate(rows, max_length, batch, side, pad=0):
    out = {}
    feats = []
    for i, (text, prompt) in enumerate(rows):
        ids = [ord(c) for c in text[:max_length]]
        p = min(len(prompt), max_length) if prompt else 0
        feats.append((i, ids, [-100 if k < p else x for k, x in enumerate(ids)]))
    for b in range(0, len(feats), batch):
        chunk = feats[b:b + batch]
        w = max(len(f[1]) for f in chunk)
        for i, ids, lab in chunk:
            fill = w - len(ids)
            if side == "right":
                out[i] = (ids + [pad] * fill, [1] * len(ids) + [0] * fill, lab + [-100] * fill)
            else:
                out[i] = ([pad] * fill + ids, [0] * fill + [1] * len(ids), [-100] * fill + lab)
            out[i] += ("NO_RESPONSE_TOKENS" if all(x == -100 for x in out[i][2]) else None,)
    return out


@SETTINGS
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 5),
       st.sampled_from(["left", "right"]))
def test_collate_matches_python(spark, rows, max_length, batch, side):
    df = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(rows)], "ord long, text string, prompt_text string")
    got = {r.ord: (r.input_ids, r.attention_mask, r.labels, r._error)
           for r in C.collate(df, "codepoint", max_length, batch, side).collect()}
    want = py_collate(rows, max_length, batch, side)
    assert got == want
