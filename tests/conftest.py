import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    return local_session(4, "3g", 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
