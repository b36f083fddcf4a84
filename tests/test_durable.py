"""Committed slices: runs that die half-way go on where they were, call by call."""

import json
import logging
import os
import subprocess
import sys
import threading
import time

import pytest

from conftest import ROOT, write
from tessera.operators import api as A
from tessera.plans import jobs, stubs
from tessera.plans.durable import WorkDir


class LoggingModel(stubs.EchoTokenModel):
    """Writes a line for every generation."""

    def __init__(self, log, fail=None):
        super().__init__()
        self.log, self.fail = log, fail

    def generate(self, input_ids, attention_mask, config, seeds):
        texts = ["".join(map(chr, i[m == 1].tolist())) for i, m in zip(map(_array, input_ids), map(_array, attention_mask))]
        if self.fail and any(self.fail in t for t in texts):
            raise RuntimeError("the model is gone")
        with open(self.log, "a") as fh:
            fh.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return super().generate(input_ids, attention_mask, config, seeds)


def _array(x):
    import numpy as np
    return np.asarray(x)


def prompts(tmp, n=40):
    return write(tmp / "p.jsonl", "\n".join(json.dumps({"id": i, "prompt": f"prompt number {i:03d}."}) for i in range(n)) + "\n")


def by_value(fn):
    """Test functions reach Python workers by value: the tests' folder isn't shipped."""
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return fn


def test_batch_inference_goes_on_after_a_failure(spark, tmp):
    p, log, work = prompts(tmp), str(tmp / "calls"), str(tmp / "work")
    args = dict(num_repeats=3, batch_size=4, seed=7, slice_batches=5, in_flight=1, work_dir=work)  # 20 rows of 60 items a slice
    whole = jobs.batch_inference(spark, p, str(tmp / "whole.jsonl"), stubs.echo_model_factory, num_repeats=3, batch_size=4, seed=7)
    want = sorted((r.ord, str(r.rec)) for r in whole.collect())
    with pytest.raises(Exception, match="the model is gone"):
        jobs.batch_inference(spark, p, str(tmp / "o.jsonl"), by_value(lambda: LoggingModel(log, "number 025")), **args)
    assert not os.path.exists(tmp / "o.jsonl")
    first = open(log).read().splitlines()
    assert sum("number 0" in t and int(t.split("number ")[1][:3]) < 20 for t in first) == 60  # the first slice is whole
    os.truncate(log, 0)
    got = jobs.batch_inference(spark, p, str(tmp / "o.jsonl"), by_value(lambda: LoggingModel(log)), **args)
    again = [int(t.split("number ")[1][:3]) for t in open(log).read().splitlines()]
    assert sorted(set(again)) == list(range(20, 40)) and len(again) == 60  # and the second is made once
    assert sorted((r.ord, str(r.rec)) for r in got.collect()) == want
    with pytest.raises(ValueError, match="another run; these differ: seed"):
        jobs.batch_inference(spark, p, str(tmp / "x.jsonl"), stubs.echo_model_factory, **{**args, "seed": 8})
    os.truncate(log, 0)
    jobs.batch_inference(spark, p, str(tmp / "o2.jsonl"), by_value(lambda: LoggingModel(log)), **args)
    assert open(log).read() == ""


KILLED = """
import os, sys, threading, time
sys.path[:0] = [{root!r}, {tests!r}]
from test_durable import SlowAfterFirst, by_value
from tessera.plans import jobs
from tessera.session import local_session
spark = local_session(cores=2, shuffle_partitions=2, app="killed")
def watch():
    while not os.path.exists({mark!r}):
        time.sleep(0.02)
    os._exit(9)
threading.Thread(target=watch, daemon=True).start()
slow = by_value(lambda: SlowAfterFirst({log!r}))
jobs.batch_inference(spark, {path!r}, {out!r}, slow, num_repeats=1, batch_size=4, slice_batches=5, in_flight=1, work_dir={work!r})
"""


class SlowAfterFirst(LoggingModel):
    def generate(self, input_ids, *rest):
        out = super().generate(input_ids, *rest)
        if "number 02" in open(self.log).read():
            time.sleep(30)  # the second slice never ends
        return out


def test_batch_inference_goes_on_in_a_new_session(spark, tmp):
    """The driver is killed with the second slice under way."""
    p, log, work, out = prompts(tmp), str(tmp / "calls"), str(tmp / "work"), str(tmp / "o.json")
    script = KILLED.format(root=ROOT, tests=os.path.join(ROOT, "tests"), mark=f"{work}/outputs/slice=0/_SUCCESS", log=log,
                           path=p, out=out, work=work)
    ended = subprocess.run([sys.executable, "-c", script], capture_output=True, timeout=300, cwd=str(tmp))
    assert ended.returncode == 9, ended.stderr.decode()[-2000:]
    assert not os.path.exists(f"{work}/outputs/slice=1/_SUCCESS")
    later = str(tmp / "later")
    got = jobs.batch_inference(spark, p, out, by_value(lambda: LoggingModel(later)), num_repeats=1, batch_size=4, slice_batches=5,
                               work_dir=work)
    assert sorted(int(t.split("number ")[1][:3]) for t in open(later).read().splitlines()) == list(range(20, 40))
    assert [r.ord for r in got.orderBy("ord").collect()] == list(range(40))


def test_slices_hold_whole_batches(spark, tmp):
    """Batches do not depend on the slices, whatever the repeats: widths show it."""
    rows = [json.dumps({"prompt": "x" * (1 + i * 7 % 19)}) for i in range(30)]
    p = write(tmp / "w.jsonl", "\n".join(rows) + "\n")
    results = []
    for k, slices in enumerate((1, 3, 1000)):
        r = jobs.batch_inference(spark, p, str(tmp / f"{k}.jsonl"), stubs.echo_model_factory, num_repeats=3, batch_size=8, seed=3,
                                 slice_batches=slices, work_dir=str(tmp / f"work{k}"))
        results.append(sorted((x.ord, str(x.rec)) for x in r.collect()))
        n = len([d for d in os.listdir(tmp / f"work{k}" / "outputs") if d.startswith("slice=")])
        assert n == {1: 4, 3: 4, 1000: 1}[slices]  # 8 rows of 3 items are the least whole batches
    assert results[0] == results[1] == results[2]


# --- calls

def counting(log, fail=()):
    def transport(url, body, headers, timeout):
        prompt = json.loads(body)["messages"][-1]["content"]
        with open(log, "a") as fh:
            fh.write(prompt + "\n")
        if any(f in prompt for f in fail):
            return 503, "busy"
        return 200, json.dumps({"choices": [{"message": {"content": "re " + prompt}}]})
    return by_value(transport)


def test_api_inference_calls_only_missing_slices(spark, tmp):
    p, log, work = prompts(tmp), str(tmp / "calls"), str(tmp / "work")
    args = dict(work_dir=work, slice_rows=5, concurrency=2, tasks=2)
    first = jobs.api_inference(spark, p, None, "http://h", "m", transport=counting(log), **args)
    want = [(r["index"], r.ok, r.response) for r in first.collect()]
    assert len(open(log).readlines()) == 40 and [w[0] for w in want] == list(range(40))
    # A crash leaves two slices without their mark: only their rows are called again.
    for k in (1, 6):
        os.remove(tmp / "work" / "responses-0" / f"slice={k}" / "_SUCCESS")
    os.truncate(log, 0)
    second = jobs.api_inference(spark, p, None, "http://h", "m", transport=counting(log), **args)
    assert [(r["index"], r.ok, r.response) for r in second.collect()] == want
    called = sorted(int(t.split("number ")[1][:3]) for t in open(log).read().splitlines())
    assert called == [*range(5, 10), *range(30, 35)]


def test_retry_failed_calls_failures_once_more(spark, tmp):
    p, log, work = prompts(tmp), str(tmp / "calls"), str(tmp / "work")
    args = dict(work_dir=work, concurrency=3, tasks=2)
    first = jobs.api_inference(spark, p, None, "http://h", "m", transport=counting(log, ["number 00", "number 031"]), **args).collect()
    assert sorted(r["index"] for r in first if not r.ok) == [*range(10), 31]
    os.truncate(log, 0)
    second = jobs.api_inference(spark, p, None, "http://h", "m", transport=counting(log, ["number 003"]), retry_failed=True, **args).collect()
    assert sorted(int(t.split("number ")[1][:3]) for t in open(log).read().splitlines()) == [*range(10), 31]
    assert [r["index"] for r in second if not r.ok] == [3] and len(second) == 40
    os.truncate(log, 0)
    third = jobs.api_inference(spark, p, str(tmp / "out.jsonl"), "http://h", "m", transport=counting(log), retry_failed=True, **args)
    assert [r.ok for r in third.collect()] == [True] * 40 and len(open(log).readlines()) == 1
    assert jobs.read_results(spark, str(tmp / "out.jsonl")).where("ok").count() == 40
    os.truncate(log, 0)
    assert len(jobs.api_inference(spark, p, None, "http://h", "m", transport=counting(log), **args).collect()) == 40
    assert open(log).read() == ""


def test_a_slow_call_idles_nobody():
    """Three calls in flight: while one hangs, the others go on to the end."""
    gate, lock, flying, most, ended = threading.Event(), threading.Lock(), [0], [0], []

    def send(i):
        with lock:
            flying[0] += 1
            most[0] = max(most[0], flying[0])
        if i == 0:
            assert gate.wait(60)
        else:
            time.sleep(0.002)
        with lock:
            flying[0] -= 1
            ended.append(i)
            if len(ended) == 199:
                gate.set()  # the slow one ends only when all others have
        return i

    frames = list(A.windowed(iter(range(200)), send, 3))
    assert sorted(i for f in frames for i in f) == list(range(200))
    assert most[0] == 3 and ended[-1] == 0
    assert len(frames) > 3 and all(len(f) <= A.EMIT_ROWS + 3 for f in frames)


def test_rows_are_taken_as_calls_end():
    """No more rows are read than calls can fly."""
    taken = []

    def rows():
        for i in range(10_000):
            taken.append(i)
            yield i

    frames = A.windowed(rows(), lambda i: i, 4)
    next(frames)
    assert len(taken) <= A.EMIT_ROWS + 4 + 4


def test_shares_use_every_call():
    assert A.shares(7, 3) == [3, 2, 2] and A.shares(2, 8) == [1, 1] and A.shares(1, 1) == [1]
    assert all(sum(A.shares(c, t)) == c for c in range(1, 20) for t in range(1, 20))


def test_calls_in_flight_over_all_lanes(spark, tmp):
    """``concurrency`` holds for the whole job, slices and tasks included."""
    p, marks = prompts(tmp, 60), str(tmp / "flying")
    os.mkdir(marks)

    def transport(url, body, headers, timeout):
        import uuid
        mine = os.path.join(marks, uuid.uuid4().hex)
        open(mine, "w").close()
        n = len(os.listdir(marks))
        time.sleep(0.02)
        os.remove(mine)
        return 200, json.dumps({"choices": [{"message": {"content": str(n)}}]})

    rows = jobs.api_inference(spark, p, None, "http://h", "m", transport=by_value(transport), concurrency=5, tasks=2, slice_rows=10).collect()
    assert max(int(r.response) for r in rows) == 5


def test_progress_is_logged_without_a_job(spark, tmp, caplog):
    p = prompts(tmp)
    with caplog.at_level(logging.INFO, "tessera"):
        jobs.api_inference(spark, p, None, "http://h", "m", transport=counting(str(tmp / "c"), ["number 00"]), tasks=1, concurrency=2)
    told = [r.getMessage() for r in caplog.records if "slice" in r.getMessage()]
    assert len(told) == 4 and "10 rows, 0 answered" in told[0] and "10 rows, 10 answered" in told[1]


def test_work_dir_keeps_to_itself(spark, tmp):
    a = WorkDir(spark, str(tmp / "w"), "x", {"n": 1})
    assert not a.has("t") and a.slices("t") == []
    WorkDir(spark, str(tmp / "w"), "x", {"n": 1})
    with pytest.raises(ValueError, match="differ: n"):
        WorkDir(spark, str(tmp / "w"), "x", {"n": 2})
    with pytest.raises(FileNotFoundError):
        jobs.batch_inference(spark, str(tmp / "none.jsonl"), str(tmp / "o"), stubs.echo_model_factory)
