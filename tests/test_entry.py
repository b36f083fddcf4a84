"""The entry stands without the corpus operators, or without a library that they need."""

import os
import subprocess
import sys

import pytest

from conftest import ROOT

BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as E
assert set(E.queries()) >= {{"sft_dataset", "batch_inference"}} and len(E.queries()) == 47, sorted(E.queries())
assert set(E.oracle_sql()) == set(E.queries())
"""


@pytest.mark.parametrize("name", ["xxhash", "tessera.llm", "corpus_pipeline"])
def test_entry_without(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name, root=ROOT)], capture_output=True, timeout=120, cwd=os.path.dirname(ROOT))
    assert done.returncode == 0, done.stderr.decode()[-1500:]
