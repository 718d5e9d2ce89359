from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import local_session

    session = local_session(4, "4g", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
