import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from riskframe.session import drop_shared_folders, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "riskframe-tests")
    yield session
    drop_shared_folders(session)
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
