import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessera.session import build_session, expose_package  # noqa: E402

expose_package()


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
