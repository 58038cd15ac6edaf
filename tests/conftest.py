import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pointloom.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(4, "4g", "pointloom-tests")


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
