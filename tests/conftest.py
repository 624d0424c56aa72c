import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from quarrymill.session import build_session

    s = build_session("tests", "local[2]", 4, spark__driver__memory="3g", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
