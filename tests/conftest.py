import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session
    s = local_session(cores=4, shuffle_partitions=4, app="tessera-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return tmp_path


def write(path, content):
    data = content if isinstance(content, bytes) else content.encode("utf-8")
    with open(path, "wb") as fh:
        fh.write(data)
    return str(path)
