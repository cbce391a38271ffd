import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from eventspark.session import get_session

    s = get_session("tests", **{"spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false", "spark__master": "local[8]", "spark__driver__memory": "4g", "spark__ui__showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
