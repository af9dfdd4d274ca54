import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SF = os.environ.get("DOCLOOM_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from compare import session

    s = session()
    yield s
    from docloom.session import discard_tables

    discard_tables(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
