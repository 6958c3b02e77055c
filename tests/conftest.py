import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from shelfmark.session import get_session

    s = get_session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__autoBroadcastJoinThreshold="256k")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    d = os.environ.get("SHELFMARK_TESTDATA", "/root/testdata/sf0.001")
    if not Path(d).exists():
        pytest.skip("no test tables here")
    return d
