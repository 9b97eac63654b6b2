import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallygrain.session import build_session, ship

    s = build_session("tests", 4, 4)
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)
