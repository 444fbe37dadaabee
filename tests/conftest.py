import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from kelpline.runtime import build_session

    return build_session("tests", 4, spark__sql__shuffle__partitions="4", spark__driver__memory="6g")


@pytest.fixture(scope="session")
def data():
    if not DATA.is_dir():
        pytest.skip("the test tables are not here")
    return str(DATA)
