import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from tremor.session import build_session

    s = build_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)
