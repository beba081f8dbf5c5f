import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from lakeloom.session import local_session

    return local_session(4, 4, "tests")


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"
