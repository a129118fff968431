import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from gridspark.session import build_session

    session = build_session(
        "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="6g", spark__sql__ansi__enabled="true"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
