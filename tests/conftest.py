import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def spark():
    from evlake.session import local_session

    session = local_session(4, memory="4g", app="evlake-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
