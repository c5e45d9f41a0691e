import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from cladewise.session import build_session

    session = build_session("local[4]", shuffle_partitions=4)
    yield session
    session.stop()
