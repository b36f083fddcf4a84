"""Deterministic stand-ins for the model and the chat endpoint.

They make generation and API results reproducible, so the Spark plans around
them can be checked against SQL. Real runs pass their own factory/transport.
"""

from __future__ import annotations

import json

import numpy as np


class EchoTokenModel:
    """Token-level model: appends the code points of
    ``"  gen:<prompt length>:<seed>:<last 8 prompt chars>\\n"`` and an
    end-of-sequence id, then pads the batch to one length like ``generate``."""

    def __init__(self, eos_id: int = 0):
        self.eos_id = eos_id

    def generate(self, input_ids, attention_mask, config, seeds):
        outs = []
        for i, (ids, mask) in enumerate(zip(input_ids, attention_mask)):
            ids, mask = np.asarray(ids), np.asarray(mask)
            prompt_ids = ids[mask == 1]
            seed = "-" if seeds is None else str(seeds[i])
            tail = "".join(map(chr, prompt_ids[-8:].tolist()))
            text = f"  gen:{len(prompt_ids)}:{seed}:{tail}\n"
            new = np.fromiter((ord(c) for c in text), dtype=np.int64, count=len(text))
            outs.append(np.concatenate([ids, new, [self.eos_id]]))
        width = max((len(o) for o in outs), default=0)
        return [np.pad(o, (0, width - len(o)), constant_values=self.eos_id) for o in outs]


def echo_model_factory():
    return EchoTokenModel()


def stub_transport(url: str, body: bytes, headers: dict, timeout: float):
    """Chat endpoint stand-in keyed on the length ``n`` of the last message's content:

    * ``n % 11 == 0``: HTTP 500 with body ``x``
    * ``n % 13 == 0``: 200 without ``choices``
    * ``n % 17 == 0``: raises ``TimeoutError('timed out')``
    * otherwise: 200 with content ``echo:<n>:<model>``
    """
    payload = json.loads(body.decode("utf-8"))
    msgs = payload.get("messages") or []
    content = msgs[-1].get("content", "") if msgs and isinstance(msgs[-1], dict) else ""
    n = len(content) if isinstance(content, str) else 0
    if n % 11 == 0:
        return 500, "x"
    if n % 13 == 0:
        return 200, json.dumps({"id": "cmpl", "object": "chat.completion"})
    if n % 17 == 0:
        raise TimeoutError("timed out")
    data = {"id": "cmpl", "choices": [{"index": 0, "message": {"role": "assistant",
                                                                "content": f"echo:{n}:{payload.get('model')}"}}]}
    return 200, json.dumps(data, ensure_ascii=False)
